"""Areas of polygon intersections as a closed-form aggregate over edge pairs.

A polygon is the signed sum of the regions below its edges. So the area two polygons share
is the signed sum, over pairs of their edges, of the integral of min(edge, edge) over the
common x range, which is a plain expression. Edges are cut at the borders of x strips, so
that only edges in one strip meet; clipping is exact and needs no geometry library.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.functions.skew import HOT_ROWS, materialize, salted_join, tasks_for
from urbanchange.operators.rings import clean_rings, edges, polygon_area, with_bounds


_BOX = ("min_x", "min_y", "max_x", "max_y")


def _checked(keys: Sequence[str]) -> list[str]:
    clash = set(keys) & {"cx", "cy", "strip", *_BOX}
    if clash:
        raise ValueError(f"reserved key names {sorted(clash)}")
    return list(keys)


def _strips(df: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Edges cut into x strips: strip, left and right end, height there, sign."""
    left = F.least("x1", "x2")
    right = F.greatest("x1", "x2")
    last = F.greatest(F.ceil(right / size) - 1, F.floor(left / size))
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    cut = (
        edges(df, keys)
        .where("x1 <> x2")
        .select(
            *keys,
            F.explode(F.sequence(F.floor(left / size), last)).alias("strip"),
            "x1",
            "y1",
            slope.alias("m"),
            left.alias("_l"),
            right.alias("_r"),
            F.when(F.col("x2") > F.col("x1"), -1.0).otherwise(1.0).alias("s"),
        )
    )
    xl = F.greatest("_l", F.col("strip") * F.lit(size))
    xr = F.least("_r", (F.col("strip") + 1) * F.lit(size))
    return (
        cut.select(*keys, "strip", "s", "m", "x1", "y1", xl.alias("xl"), xr.alias("xr"))
        .where("xl < xr")
        .select(
            *keys,
            "strip",
            "s",
            "m",
            "xl",
            "xr",
            (F.col("y1") + F.col("m") * (F.col("xl") - F.col("x1"))).alias("yl"),
        )
    )


def _cells(df: DataFrame, size: float) -> DataFrame:
    def span(axis: str):
        return F.sequence(
            F.floor(F.col(f"min_{axis}") / size), F.floor(F.col(f"max_{axis}") / size)
        )

    return df.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))


def candidate_pairs(
    a: DataFrame,
    b: DataFrame,
    a_keys: Sequence[str],
    b_keys: Sequence[str],
    size: float,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Polygon pairs whose bounding boxes share area, each once.

    Both sides are listed in square cells and joined on the cell; a pair is kept only in
    the cell of the lower left corner of the common box. Crowded cells are salted, and cells
    are dealt to as many tasks as their rows ask for.
    """
    left = _cells(a, size).select(
        *_checked(a_keys), "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in _BOX]
    )
    right = _cells(b, size).select(
        *_checked(b_keys), "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in _BOX]
    )
    low_x, low_y = F.greatest("a_min_x", "b_min_x"), F.greatest("a_min_y", "b_min_y")
    high_x, high_y = F.least("a_max_x", "b_max_x"), F.least("a_max_y", "b_max_y")
    tasks = tasks_for(right.sparkSession, right.count())
    return (
        salted_join(right, left, ["cx", "cy"], hot_rows=hot_rows, tasks=tasks)
        .where((low_x < high_x) & (low_y < high_y))
        .where((F.floor(low_x / size) == F.col("cx")) & (F.floor(low_y / size) == F.col("cy")))
        .select(
            *a_keys,
            *b_keys,
            low_x.alias("_low_x"),
            high_x.alias("_high_x"),
            low_y.alias("_low_y"),
        )
    )


def default_cell_size(zones: DataFrame) -> float:
    """Twice the mean side of the zones' bounding boxes."""
    side = (F.col("max_x") - F.col("min_x") + F.col("max_y") - F.col("min_y")) / 2.0
    mean = with_bounds(zones).agg(F.avg(side)).first()[0]
    return float(mean) * 2.0 if mean else 1.0


def _cleaned(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clean polygons, made once and in many tasks, however few the files are."""
    return materialize(clean_rings(df.repartition(tasks_for(df.sparkSession, df.count()), *keys)))


def intersection_areas(
    a: DataFrame,
    b: DataFrame,
    a_keys: Sequence[str],
    b_keys: Sequence[str],
    size: float | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Shared area of each overlapping pair of polygons of two layers.

    Clean polygons and pairs are written once, and counted; edges join them in as many tasks as that asks for.
    """
    cell = default_cell_size(a) if size is None else size
    a, b = _cleaned(a, a_keys), _cleaned(b, b_keys)
    pairs = candidate_pairs(with_bounds(a), with_bounds(b), a_keys, b_keys, cell, hot_rows)
    pairs = pairs.withColumn(
        "strip",
        F.explode(
            F.sequence(
                F.floor(F.col("_low_x") / cell),
                F.greatest(
                    F.ceil(F.col("_high_x") / cell) - 1, F.floor(F.col("_low_x") / cell)
                ),
            )
        ),
    )
    pairs = materialize(pairs.drop("_low_x", "_high_x"))
    tasks = tasks_for(pairs.sparkSession, pairs.count())
    ends = ("s", "m", "xl", "xr", "yl")
    ea = _strips(a, a_keys, cell)
    eb = _strips(b, b_keys, cell)
    ea = ea.select(*a_keys, "strip", *[F.col(c).alias(f"a_{c}") for c in ends])
    eb = eb.select(*b_keys, "strip", *[F.col(c).alias(f"b_{c}") for c in ends])
    met = salted_join(pairs, ea, [*a_keys, "strip"], hot_rows=hot_rows, tasks=tasks)
    met = salted_join(met, eb, [*b_keys, "strip"], hot_rows=hot_rows, tasks=tasks, counted=pairs)
    lo, hi = F.greatest("a_xl", "b_xl"), F.least("a_xr", "b_xr")
    met = met.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo < _hi")

    def height(side: str, x: str):
        return (
            F.col(f"{side}_yl")
            - F.col("_low_y")
            + F.col(f"{side}_m") * (F.col(x) - F.col(f"{side}_xl"))
        )

    fa0, fa1, fb0, fb1 = (
        height("a", "_lo"),
        height("a", "_hi"),
        height("b", "_lo"),
        height("b", "_hi"),
    )
    d0, d1 = fa0 - fb0, fa1 - fb1
    apart = (F.abs(d0) + F.abs(d1)) / 2.0
    crossed = (d0 * d0 + d1 * d1) / (2.0 * (F.abs(d0) + F.abs(d1)))
    gap = F.when(d0 * d1 >= 0, apart).otherwise(crossed)
    below = (F.col("_hi") - F.col("_lo")) * ((fa0 + fa1 + fb0 + fb1) / 4.0 - gap / 2.0)
    parts = met.groupBy(*a_keys, *b_keys, "strip").agg(  # where they are
        F.sum(F.col("a_s") * F.col("b_s") * below).alias("area")
    )
    parts = parts.repartition(tasks, *a_keys, *b_keys)
    return parts.groupBy(*a_keys, *b_keys).agg(F.sum("area").alias("area"))


def planning_coverage(
    zones: DataFrame,
    planning: DataFrame,
    layers: Sequence[str],
    size: float | None = None,
) -> DataFrame:
    """Per zone and planning layer, the summed intersection area in percent of the zone.

    Overlapping features of one layer count more than once, so 100 can be exceeded. A zone
    without area gives 0.
    """
    areas = intersection_areas(zones, planning, ["code"], ["layer", "feature_id"], size)
    per_layer = areas.groupBy("code").agg(
        *[F.sum(F.when(F.col("layer") == layer, F.col("area"))).alias(layer) for layer in layers]
    )
    whole = polygon_area(zones).withColumnRenamed("area", "_zone_area")
    return whole.join(per_layer, "code", "left").select(
        "code",
        *[
            F.when(
                F.col("_zone_area") > 0,
                F.coalesce(F.col(layer), F.lit(0.0)) / F.col("_zone_area") * 100.0,
            )
            .otherwise(0.0)
            .alias(layer)
            for layer in layers
        ],
    )


def clipped_layer_area(
    layer: DataFrame, zones: DataFrame, size: float | None = None
) -> DataFrame:
    """Area of each feature that is left inside each zone."""
    return intersection_areas(zones, layer, ["code"], ["layer", "feature_id"], size)
