"""Incomplete images, duplicate pixels, declared CRS and burn order."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_change import image_of, pixels
from test_geometry import box, layer

from urbanchange.config import Grid
from urbanchange.functions.skew import salted_join
from urbanchange.operators import masks, patches, registry, reproject, scanfill, threshold, zones
from urbanchange.sources.layers import read_geojson


def test_patches_keep_places_when_cells_are_absent(spark):
    image = np.arange(64, dtype=float).reshape(8, 8)
    holes = F.expr("(row_ = 1 and col_ = 2) or (row_ = 0 and col_ = 0) or (row_ = 7 and col_ = 7)")
    df = pixels(spark, image).where(~holes)
    packed = patches.extract_patches(df, Grid(8, 8), 4, 4)
    for r in packed.collect():
        want = image[4 * r.pi : 4 * r.pi + 4, 4 * r.pj : 4 * r.pj + 4].ravel()
        assert len(r.patch) == 16
        for got, value in zip(r.patch, want):
            assert got == value or (got is None and value in (0.0, 10.0, 63.0))
    back = patches.reconstruct(
        patches.unpack_patches(packed, 4), pixels(spark, image).select("band", "row_", "col_"), 4, 4
    )
    restored = image_of(back, (8, 8))
    image[[0, 1, 7], [0, 2, 7]] = 0
    assert (restored == image).all()


def test_patch_scores_with_absent_cells(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(size=(8, 8)), rng.uniform(size=(8, 8))
    pairs = pixels(spark, a, "v1").join(pixels(spark, b, "v2"), ["band", "row_", "col_"])
    gaps = pairs.where("not (row_ = 2 and col_ in (1, 2, 3, 4))")
    out = patches.score_patches(gaps, Grid(8, 8), lambda p, q: np.abs(q - p), 4, 2)
    assert out.count() == 60
    got = {(r.row_, r.col_): r.value for r in out.collect()}
    diff = np.abs(b - a)
    low, high = (f(diff[r, c] for r, c in got) for f in (min, max))
    assert all(abs(v - (diff[k] - low) / (high - low)) < 1e-9 for k, v in got.items())


def test_blur_ignores_gaps(spark):
    flat = pixels(spark, np.full((6, 20), 3.0)).where("col_ % 7 <> 2")
    assert np.allclose([r.value for r in threshold.gaussian(flat, 1.5).collect()], 3.0)
    ramp = pixels(spark, np.tile(np.arange(41.0), (1, 1))).where("col_ not in (8, 9, 31, 32)")
    middle = threshold.gaussian(ramp, 1.0).where("col_ = 20").first().value
    assert abs(middle - 20) < 1e-9


def test_pair_refuses_duplicates(spark):
    df = pixels(spark, np.ones((2, 2))).withColumn("period", F.lit(1))
    assert masks.pair(df, 1, 2).count() == 4
    with pytest.raises(PySparkException):
        masks.pair(df.union(df.limit(1)), 1, 2).collect()


def test_every_method_finds_a_planted_change(spark):
    rng = np.random.default_rng(3)
    before = rng.normal(100, 1, (24, 24))
    after = rng.normal(100, 1, (24, 24))
    after[6:14, 4:16] += 60
    df = pixels(spark, before).withColumn("period", F.lit(1)).unionByName(
        pixels(spark, after).withColumn("period", F.lit(2))
    )
    for name in registry.METHODS:
        options = {"size": 4, "scorer": lambda a, b: np.abs(b - a)} if name == "user_patch" else {}
        strategy = "triangle" if name == "spatial_context" else "multiotsu"
        found = registry.binary_changes(df, 1, 2, Grid(24, 24), name, strategy, **options)
        out = image_of(found, (24, 24), "changed")
        # three classes may split the noise inside the block, and context marks its surroundings
        assert out.any() if name == "spatial_context" else out[6:14, 4:16].mean() > 0.3, name
        assert name == "spatial_context" or out.sum() < 1.6 * 96, name


def test_zones_follow_their_crs(spark):
    """Zones in the national grid on a raster in UTM cover the pixels they cover there."""
    grid = Grid(20, 20, 600_000.0, 5_700_000.0, 50.0, -50.0, "EPSG:32630")
    utm = layer(spark, [(1, [box(600_100, 5_699_300, 600_700, 5_699_800)]), (2, [box(600_500, 5_699_100, 600_900, 5_699_500)])])
    utm = utm.withColumn("crs", F.lit("EPSG:32630"))
    osgb = reproject.reproject_layer(utm, "EPSG:32630", "EPSG:27700")
    a, b = ({tuple(r) for r in scanfill.rasterize_zones(z, grid).collect()} for z in (utm, osgb))
    assert len(a) > 100 and a == b
    changes = spark.range(400).selectExpr("1 band", "cast(id div 20 as int) row_", "cast(id % 20 as int) col_", "1 changed")
    shares = [
        {r.code: r["features_band_1_m"] for r in zones.feature_matrix(changes, z, grid, [1], "m").collect()}
        for z in (utm, osgb)
    ]
    assert all(abs(shares[0][k] / shares[1][k] - 1) < 0.01 for k in ("1", "2"))  # area in the layer's own CRS
    with pytest.raises(PySparkException):
        scanfill.rasterize_zones(osgb.withColumn("crs", F.lit("EPSG:9999")), grid).collect()


def test_burn_order_from_a_file(spark, tmp_path):
    def feature(name, ring):
        return {"type": "Feature", "properties": {"code": name}, "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in ring]]}}

    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    inner = [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]
    features = [feature("b", square), feature("a", inner)]
    (tmp_path / "one.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, features)))
    for name, lines in (("one.geojson", False), ("lines.jsonl", True)):
        zones_ = read_geojson(spark, str(tmp_path / name), {"code": "string"}, lines=lines)
        owner = {(r.row_, r.col_): r.code for r in scanfill.rasterize_zones(zones_, Grid(4, 4)).collect()}
        assert owner[0, 0] == "b" and owner[1, 1] == owner[2, 2] == "a" and len(owner) == 16


def test_many_hot_keys_are_all_salted(spark):
    left = spark.range(6000).selectExpr("id % 30 as k", "id")
    right = spark.range(60).selectExpr("id % 40 as k", "id as w")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right, "k", how)
        got = salted_join(left, right, ["k"], how, hot_rows=50, buckets=16)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
