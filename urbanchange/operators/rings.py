"""Rings and edges of polygons: repair, bounds, areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also when used per array element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, (i + 1) % F.size(ring))


def signed_area(ring: Column) -> Column:
    """Shoelace area of one ring, positive when counter-clockwise; open or closed."""

    def area(r: Column) -> Column:
        def term(p: Column, i: Column) -> Column:
            o, q = F.get(r, F.lit(0)), _next(r, i)
            return (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])

        return F.aggregate(F.transform(r, term), F.lit(0.0), lambda acc, t: acc + t) / 2.0

    return _let(ring, area)


def _repair(ring: Column) -> Column:
    """Drop null and repeated vertices and close the ring."""

    def close(r: Column) -> Column:
        first = F.get(r, F.lit(0))
        open_ = (F.size(r) > 1) & (first != F.get(r, F.size(r) - 1))
        return F.when(open_, F.concat(r, F.array(first))).otherwise(r)

    def thin(r: Column) -> Column:
        return F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, F.greatest(i - 1, F.lit(0)))))

    points = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return _let(_let(points, thin), close)


def clean_rings(df: DataFrame) -> DataFrame:
    """Close rings, drop repeated vertices and empty rings, turn shells CCW and holes CW.

    The first ring of a polygon is its shell; without a shell the polygon is dropped.
    Self-intersecting rings are not rebuilt.
    """

    def measured(ring: Column) -> Column:
        return _let(
            _repair(ring), lambda r: F.struct(r.alias("ring"), signed_area(r).alias("area"))
        )

    def solid(r: Column) -> Column:
        return (F.size(r["ring"]) >= 4) & (r["area"] != 0)

    def turned(r: Column, i: Column) -> Column:
        wrong = F.when(i == 0, r["area"] < 0).otherwise(r["area"] > 0)
        return F.when(wrong, F.reverse(r["ring"])).otherwise(r["ring"])

    def polygon(rings: Column) -> Column:
        kept = F.transform(F.filter(rings, solid), turned)
        return F.when(solid(F.get(rings, F.lit(0))), kept)

    cleaned = _let(F.transform("rings", measured), polygon)
    return df.withColumn("rings", cleaned).where(F.size("rings") > 0)


def edges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per edge: keys, x1, y1, x2, y2. Closing edges are implied."""
    ring = F.col("_ring")
    segment = F.transform(
        ring, lambda p, i: F.struct(p.alias("a"), _next(ring, i).alias("b"))
    )
    return (
        df.select(*keys, F.explode("rings").alias("_ring"))
        .select(*keys, F.explode(segment).alias("_s"))
        .select(
            *keys,
            F.col("_s.a.x").alias("x1"),
            F.col("_s.a.y").alias("y1"),
            F.col("_s.b.x").alias("x2"),
            F.col("_s.b.y").alias("y2"),
        )
        .where("x1 <> x2 or y1 <> y2")
    )


def with_bounds(df: DataFrame) -> DataFrame:
    """Bounding box of each polygon row, without a shuffle."""
    xs = F.transform(F.flatten("rings"), lambda p: p["x"])
    ys = F.transform(F.flatten("rings"), lambda p: p["y"])
    return df.select(
        "*",
        F.array_min(xs).alias("min_x"),
        F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"),
        F.array_max(ys).alias("max_y"),
    )


def layer_bounds(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bounding box of all polygons, or of each key."""
    return (
        with_bounds(df)
        .groupBy(*keys)
        .agg(
            F.min("min_x").alias("min_x"),
            F.min("min_y").alias("min_y"),
            F.max("max_x").alias("max_x"),
            F.max("max_y").alias("max_y"),
        )
    )


def polygon_area(df: DataFrame, keys: Sequence[str] = ("code",)) -> DataFrame:
    """Area per key: shells minus holes, parts of a multi-polygon added up."""
    areas = F.transform("rings", lambda r: F.abs(signed_area(r)))
    own = F.aggregate(
        F.transform(areas, lambda a, i: F.when(i == 0, a).otherwise(-a)),
        F.lit(0.0),
        lambda acc, a: acc + a,
    )
    return df.groupBy(*keys).agg(F.sum(own).alias("area"))
