"""Audit statistics per band and statistics per zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.config import Grid
from urbanchange.functions.ordering import exact_quantiles, grouped_quantiles
from urbanchange.functions.skew import HOT_ROWS
from urbanchange.operators.scanfill import covered_spans, span_cells

ZONAL = ("count", "min", "mean", "max", "median")


def band_statistics(
    df: DataFrame, by: Sequence[str] = ("band",), small_rows: int = HOT_ROWS
) -> DataFrame:
    """Mean, median, min, max, population std, quartiles and null percentage per band."""
    by = list(by)
    moments = df.groupBy(*by).agg(
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.stddev_pop("value").alias("std"),
        (F.lit(100.0) * (F.count(F.lit(1)) - F.count("value")) / F.count(F.lit(1))).alias(
            "null_pct"
        ),
    )
    spread = exact_quantiles(
        df, "value", {"p25": 0.25, "median": 0.5, "p75": 0.75}, by, small_rows
    )
    return moments.join(spread, by, "left").select(
        *by, "mean", "median", "min", "max", "std", "p25", "p75", "null_pct"
    )


def zonal_statistics(
    zones: DataFrame,
    pixels: DataFrame,
    grid: Grid,
    *,
    stats: Sequence[str] = ZONAL,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Statistics of one band's valid pixels per zone; a pixel counts in every zone over it.

    ``pixels`` has one row per cell. A zone without valid pixels has count 0, else null.
    """
    unknown = set(stats) - set(ZONAL)
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    valid = pixels.where(F.col("value").isNotNull()).select("row_", "col_", "value")
    spans = covered_spans(zones, ["code"], grid)
    inside = span_cells(spans, ["code"]).join(valid, ["row_", "col_"])
    known = {
        "count": F.count("value"),
        "min": F.min("value"),
        "mean": F.avg("value"),
        "max": F.max("value"),
    }
    plain = [known[s].alias(s) for s in stats if s != "median"]
    if "median" in stats:
        # The covered cells bound the pixels of a zone and are counted without a join.
        sizes = spans.groupBy("code").agg(F.sum(F.col("past") - F.col("first")).alias("rows"))
        found = grouped_quantiles(
            inside, ["code"], "value", {"median": 0.5}, hot_rows, plain, sizes
        )
    else:
        found = inside.groupBy("code").agg(*plain)
    out = zones.select("code").distinct().join(found, "code", "left")
    if "count" in stats:
        out = out.withColumn("count", F.coalesce("count", F.lit(0)))
    return out.select("code", *stats)
