"""Clip tiles to a boundary and merge overlapping tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.config import Grid
from urbanchange.functions.skew import HOT_ROWS, salted_join
from urbanchange.operators.scanfill import dissolved_spans, span_cells

PIXEL = ("band", "row_", "col_")
MAX_SPANS = 200_000  # three integers each


def clip_to_boundary(
    pixels: DataFrame,
    boundary: DataFrame,
    grid: Grid,
    hot_rows: int = HOT_ROWS,
    max_spans: int = MAX_SPANS,
) -> DataFrame:
    """Keep the pixels whose centre lies in any boundary polygon.

    The boundary is a few column spans per image row. Up to ``max_spans`` of them (counted)
    are broadcast and no pixel is shuffled; beyond that cells are joined, hot ones salted.
    """
    spans = dissolved_spans(boundary, grid)
    if spans.limit(max_spans + 1).count() <= max_spans:
        spans = F.broadcast(spans.withColumnRenamed("row_", "_row"))
        within = (
            (F.col("row_") == F.col("_row"))
            & (F.col("col_") >= F.col("first"))
            & (F.col("col_") < F.col("past"))
        )
        return pixels.join(spans, within, "left_semi")
    return salted_join(pixels, span_cells(spans, []), ["row_", "col_"], "left_semi", hot_rows)


def crop_extent(pixels: DataFrame) -> DataFrame:
    """Row and column range that is left after a clip."""
    return pixels.agg(
        F.min("row_").alias("min_row"),
        F.min("col_").alias("min_col"),
        F.max("row_").alias("max_row"),
        F.max("col_").alias("max_col"),
    )


def mosaic(
    tiles: DataFrame,
    keys: Sequence[str] = PIXEL,
    order: Sequence[str] = ("tile",),
    on_overlap: str = "average",
) -> DataFrame:
    """Merge tiles; valid overlapping pixels are averaged, or the first or last tile wins."""
    valid = F.col("value").isNotNull()
    place = F.when(valid, F.struct(*order))
    rules = {
        "average": F.avg("value"),
        "first": F.min_by("value", place),
        "last": F.max_by("value", place),
    }
    if on_overlap not in rules:
        raise ValueError(f"unknown overlap rule {on_overlap!r}; known: {sorted(rules)}")
    return tiles.groupBy(*keys).agg(rules[on_overlap].alias("value"))


def clip_and_merge(
    tiles: DataFrame,
    boundary: DataFrame,
    grid: Grid,
    keys: Sequence[str] = PIXEL,
    order: Sequence[str] = ("tile",),
    average_overlaps: bool = True,
) -> DataFrame:
    """Clip the tiles of one year, then merge them into one composite."""
    return mosaic(
        clip_to_boundary(tiles, boundary, grid),
        keys,
        order,
        "average" if average_overlaps else "last",
    )
