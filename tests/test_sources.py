from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from urbanchange.config import Grid
from urbanchange.operators import composite, masks, mosaic
from urbanchange.sources import layers, pixels, tables


def test_csv_encodings_and_headers(spark, tmp_path):
    utf = tmp_path / "utf.csv"
    utf.write_bytes("﻿ LSOA01CD ,Name,N\nE1,Café,3\n".encode())
    latin = tmp_path / "latin.csv"
    latin.write_bytes("LSOA01CD,Name,N\nE1,Café,3\n".encode("latin-1"))
    for path in (utf, latin):
        df = tables.read_csv(spark, str(path), {"n": "int"})
        assert df.columns == ["lsoa01cd", "name", "n"]
        assert tuple(df.first()) == ("E1", "Café", 3)
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(utf), {"absent": "int"})
    tables.write_csv(df, str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out")).count() == 1


def test_geojson_round_trip(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    features = [
        {"type": "Feature", "properties": {"code": "A", "n": 1}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"code": "B", "n": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
    ]
    path = tmp_path / "layer.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    df = layers.read_geojson(spark, str(path), {"code": "string", "n": "int"})
    assert df.groupBy("code").count().orderBy("code").collect() == [("A", 1), ("B", 2)]
    layers.write_geojson_lines(df, str(tmp_path / "lines"))
    again = layers.read_geojson(spark, str(tmp_path / "lines"), {"code": "string", "n": "int"}, lines=True)
    assert sorted(map(str, again.drop("ord").collect())) == sorted(map(str, df.drop("ord").collect()))
    assert layers.with_crs(df, "EPSG:27700").first()["crs"] == "EPSG:27700"


def test_pixels_prune_and_skip(spark, tmp_path):
    df = spark.createDataFrame(
        [(2016, 1, 0, 0, 5.0), (2016, 2, 0, 0, -1.0), (2021, 1, 0, 0, float("nan"))],
        "year int, band int, row_ int, col_ int, value double",
    )
    path = pixels.write_pixels(df, str(tmp_path / "px"))
    pixels.write_pixels(df.limit(0), path)  # an existing table stays
    got = pixels.read_pixels(spark, path, bands=[1], years=[2016], nodata=-1.0)
    assert got.count() == 1
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [band" in plan
    assert pixels.read_pixels(spark, path, nodata=-1.0).where("value is null").count() == 2
    df.where("band = 2").select("row_", "value").write.parquet(str(tmp_path / "ch" / "features_band_7_fc_x.parquet"))
    read = pixels.read_change_files(spark, str(tmp_path / "ch" / "features_band_7_fc_x.parquet"))
    assert read.first()["band"] == 7
    with pytest.raises(Exception, match="no band number"):
        spark.range(1).select(pixels.band_from_name(F.lit("nothing.tiff"))).collect()


def test_small_rules(spark):
    with pytest.raises(ValueError):
        pixels.check_same_grid(Grid(2, 2), Grid(2, 3))
    with pytest.raises(RuntimeError):
        composite.require_scenes(spark.range(0), "2016")
    with pytest.raises(ValueError):
        mosaic.mosaic(spark.range(1), ["id"], ["id"], "middle")
    layer = spark.createDataFrame([("a",), ("b",)], "layer string")
    assert layers.planning_layers(layer, "a").count() == 1


def test_median_of_a_hot_pixel(spark):
    df = spark.range(3001).select(
        F.lit(1).alias("period"), F.lit(1).alias("band"), F.lit(0).alias("row_"),
        F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).cast("int").alias("col_"),
        F.col("id").cast("double").alias("value"), F.lit(4).alias("scl"),
    )
    for hot_rows in (10**6, 100):
        got = composite.median_composite(df, hot_rows=hot_rows)
        assert got.count() == 502 and got.where("col_ = 0").first()["value"] == 1249.5
    cloudy = composite.median_composite(df.withColumn("scl", F.lit(9)), hot_rows=100)
    assert cloudy.count() == 502 and cloudy.where("value is not null").count() == 0


def test_median_without_empty_pixels(spark):
    """Left out are the pixels without a clear value, nothing else."""
    nan = float("nan")
    rows = [(0, 5.0, 4), (0, 7.0, 9), (0, 9.0, 4), (0, nan, 4), (1, 3.0, 9), (2, nan, 4), (2, None, 4), (3, 2.0, None)]
    df = spark.createDataFrame(rows, "col_ int, value double, scl int").selectExpr(
        "1 period", "1 band", "0 row_", "col_", "value", "scl", "timestamp'2016-06-01' + make_interval(0, col_) ts"
    )
    for hot_rows in (10**6, 0):
        for months in (None, (6, 8)):
            every = composite.median_composite(df, hot_rows=hot_rows, months=months)
            some = composite.median_composite(df, hot_rows=hot_rows, months=months, keep_empty=False)
            want = {0: 7.0, 1: None, 2: None, 3: 2.0}
            if months:
                want.pop(3)
            assert {r["col_"]: r["value"] for r in every.collect()} == want
            got = {r["col_"]: r["value"] for r in some.collect()}
            assert got == {k: v for k, v in want.items() if v is not None}


def test_mosaic_rules_skip_missing(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 1, 2.0), (1, 0, 0, 2, 4.0), (1, 0, 0, 3, None)],
        "band int, row_ int, col_ int, tile int, value double",
    )
    got = {rule: mosaic.mosaic(df, on_overlap=rule).first()["value"] for rule in ("first", "last", "average")}
    assert got == {"first": 2.0, "last": 4.0, "average": 3.0}


def test_landcover_ties_and_scores(spark):
    df = spark.createDataFrame([(0, 0, 3), (0, 0, 1), (0, 0, 3), (0, 0, 1), (0, 1, 8)], "row_ int, col_ int, cls int")
    got = {r["col_"]: r["cls"] for r in composite.landcover_mode(df).collect()}
    assert got == {0: 1, 1: 8}


def test_pair_from_one_or_two_tables(spark):
    df = spark.createDataFrame(
        [(1, 1, 0, 0, 2.0), (2, 1, 0, 0, 5.0), (2, 1, 0, 1, 7.0)],
        "period int, band int, row_ int, col_ int, value double",
    )
    a = masks.pair(df, 1, 2)
    b = masks.join_pair(df.where("period = 1"), df.where("period = 2"))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    gap = {r["col_"]: r["diff"] for r in masks.masked_difference(a).collect()}
    assert gap == {0: 3.0, 1: None}


def test_pairs_refuse_doubles_and_unlike_grids(spark):
    df = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 0, 3.0)], "band int, row_ int, col_ int, value double")
    with pytest.raises(Exception, match="twice in one period"):
        masks.join_pair(df, df.limit(0)).collect()
    with pytest.raises(ValueError, match="grids differ"):
        masks.join_pair(df, df, grids=(Grid(2, 2), Grid(2, 3)))
