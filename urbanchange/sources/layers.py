"""Polygon layers: GeoJSON features become rows with nested rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_geojson(
    spark: SparkSession,
    path: str,
    properties: dict[str, str],
    *,
    lines: bool = False,
    crs: str | None = None,
) -> DataFrame:
    """Read polygons with the given ``properties`` (name -> type) and a ``rings`` column.

    ``lines`` reads one feature per line, which splits at any size; a plain feature
    collection is one JSON document per file. A multi-polygon gives one row per part. ``ord``
    is the order of the features: where zones overlap, the later one is burned last.
    """
    props = ",".join(f"`{n}`:{t}" for n, t in properties.items())
    feature = (
        f"geometry:struct<type:string,coordinates:string>,properties:struct<{props}>"
    )
    if lines:
        rows = spark.read.schema(feature.replace(":struct", " struct")).json(path)
        rows = rows.withColumn("ord", F.monotonically_increasing_id())
    else:
        collection = f"features array<struct<{feature}>>"
        rows = (
            spark.read.schema(collection)
            .option("multiLine", True)
            .json(path)
            .select(F.posexplode("features").alias("_at", "f"))
            .select("f.*", F.col("_at").cast("long").alias("ord"))
        )
    rings = F.when(
        F.col("geometry.type") == "MultiPolygon",
        F.from_json("geometry.coordinates", "array<array<array<array<double>>>>"),
    ).otherwise(F.array(F.from_json("geometry.coordinates", "array<array<array<double>>>")))
    return rows.select("properties.*", "ord", F.explode(rings).alias("_part")).select(
        *properties,
        "ord",
        F.transform("_part", _points).alias("rings"),
        F.lit(crs).cast("string").alias("crs"),
    )


def write_geojson_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write one GeoJSON feature per line, every non-geometry column as a property."""
    names = [c for c in df.columns if c not in ("rings", "crs", "ord")]
    coordinates = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias(
            "geometry"
        ),
        F.struct(*names).alias("properties"),
    )
    df.select(F.to_json(feature).alias("value")).write.mode(mode).text(path)


def planning_layers(layers: DataFrame, excluded: str | None = None) -> DataFrame:
    """All features of all planning layers except one excluded layer."""
    return layers if excluded is None else layers.where(F.col("layer") != excluded)


def with_crs(df: DataFrame, crs: str, override: bool = False) -> DataFrame:
    """Declare the CRS of rows that have none, or of all rows."""
    if override or "crs" not in df.columns:
        return df.withColumn("crs", F.lit(crs))
    return df.withColumn("crs", F.coalesce("crs", F.lit(crs)))
