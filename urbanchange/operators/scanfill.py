"""Which pixel centres lie in which polygon, by scanline parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanchange.config import Grid
from urbanchange.operators.reproject import in_crs
from urbanchange.operators.rings import edges


def covered_spans(zones: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """Column spans [first, past) per key and row whose pixel centres are inside.

    An edge that crosses the centre line of a row toggles "inside" for all columns to its
    right. Toggles are counted per (key, row, column) before anything is ordered, so the
    number of vertices never matters: an ordered group has at most ``width`` rows. Zones that
    name their ``crs`` are moved to the raster's.
    """
    keys = list(keys)
    zones = in_crs(zones, grid.crs)
    u1 = (F.col("y1") - F.lit(grid.y0)) / F.lit(grid.dy)
    u2 = (F.col("y2") - F.lit(grid.y0)) / F.lit(grid.dy)
    w1 = (F.col("x1") - F.lit(grid.x0)) / F.lit(grid.dx)
    w2 = (F.col("x2") - F.lit(grid.x0)) / F.lit(grid.dx)
    spanned = edges(zones, keys).select(
        *keys, u1.alias("u1"), u2.alias("u2"), w1.alias("w1"), w2.alias("w2")
    )
    top = F.greatest(F.ceil(F.least("u1", "u2") - 0.5), F.lit(0))
    bottom = F.least(F.ceil(F.greatest("u1", "u2") - 0.5) - 1, F.lit(grid.height - 1))
    rows = (
        spanned.select("*", top.cast("int").alias("_top"), bottom.cast("int").alias("_bottom"))
        .where("_top <= _bottom")
        .select(*keys, "u1", "u2", "w1", "w2", F.explode(F.sequence("_top", "_bottom")).alias("row_"))
    )
    crossing = F.col("w1") + (F.col("row_") + 0.5 - F.col("u1")) * (F.col("w2") - F.col("w1")) / (
        F.col("u2") - F.col("u1")
    )
    first = F.greatest(F.ceil(crossing - 0.5), F.lit(0))
    toggles = (
        rows.select(*keys, "row_", first.alias("first"))
        .where(F.col("first") < grid.width)
        .groupBy(*keys, "row_", F.col("first").cast("int").alias("first"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n % 2 = 1")
    )
    line = W.partitionBy(*keys, "row_").orderBy("first")
    return (
        toggles.withColumn("_i", F.row_number().over(line))
        .withColumn("past", F.lead("first", 1, grid.width).over(line))
        .where("_i % 2 = 1")
        .select(*keys, "row_", "first", "past")
    )


def span_cells(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per covered cell of each span."""
    return spans.select(
        *keys, "row_", F.explode(F.sequence(F.col("first"), F.col("past") - 1)).alias("col_")
    )


def covered_cells(zones: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """One row per key and covered cell; a cell appears once for every zone over it."""
    return span_cells(covered_spans(zones, keys, grid), keys)


def dissolved_spans(zones: DataFrame, grid: Grid) -> DataFrame:
    """Spans of the union of all zones: row_, first, past, apart from each other.

    Spans are reduced to one per start column before they are ordered along a row.
    """
    starts = (
        covered_spans(zones, ["code"], grid).groupBy("row_", "first").agg(F.max("past").alias("past"))
    )
    line = W.partitionBy("row_").orderBy("first")
    reached = F.max("past").over(line.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first") <= F.col("_reached"), 0).otherwise(1)).over(line)
    return (
        starts.withColumn("_reached", reached)
        .withColumn("_island", island)
        .groupBy("row_", "_island")
        .agg(F.min("first").alias("first"), F.max("past").alias("past"))
        .drop("_island")
    )


def rasterize_zones(zones: DataFrame, grid: Grid, code: str = "code", order: str = "ord") -> DataFrame:
    """Owner of each covered cell; where zones overlap the one burned last wins."""
    cells = covered_cells(zones, [code, order], grid)
    return cells.groupBy("row_", "col_").agg(F.max_by(code, order).alias(code))
