"""Masks, differences and scaling of pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanchange.config import CLOUD_CLASSES, Grid
from urbanchange.functions.columns import canonical, minmax
from urbanchange.functions.skew import join_stats
from urbanchange.sources.pixels import check_same_grid

CELL = ("row_", "col_")
PIXEL = ("band", "row_", "col_")


def valid_pixels(df: DataFrame, nodata: float | None = None) -> DataFrame:
    """Add ``valid``: neither missing, NaN nor the nodata value."""
    return df.withColumn("valid", canonical(F.col("value"), nodata).isNotNull())


def valid_percentage(df: DataFrame, grid: Grid, by: Sequence[str] = ("band",)) -> DataFrame:
    """Valid pixels as a percentage of all cells of the grid."""
    return df.groupBy(*by).agg(
        (F.lit(100.0) * F.count("value") / F.lit(grid.width * grid.height)).alias("valid_pct")
    )


def mask_clouds(df: DataFrame, drop: Sequence[int] = CLOUD_CLASSES) -> DataFrame:
    """Null the value under clouds and shadows; the row stays, so the cell survives.

    An unknown scene class is not in the drop list and keeps its value.
    """
    cloudy = F.coalesce(F.col("scl").isin(list(drop)), F.lit(False))
    return df.withColumn("value", F.when(~cloudy, F.col("value")))


def pair(
    df: DataFrame, earlier, later, period: str = "period", grids: tuple[Grid, Grid] | None = None
) -> DataFrame:
    """Earlier and later value of each pixel side by side, in one shuffle and no join.

    A pixel that comes twice in one period is an error, and so are two ``grids`` of unlike shape.
    """
    if grids is not None:
        check_same_grid(*grids)

    def only(when) -> Column:
        own = F.col(period) == F.lit(when)
        twice = F.raise_error(F.lit("a pixel comes twice in one period"))
        value = F.max(F.when(own, F.col("value")))
        return F.when(F.count_if(own) > 1, twice.cast("double")).otherwise(value)

    return (
        df.where(F.col(period).isin(earlier, later))
        .groupBy(*PIXEL)
        .agg(only(earlier).alias("v1"), only(later).alias("v2"))
    )


def join_pair(
    earlier: DataFrame, later: DataFrame, grids: tuple[Grid, Grid] | None = None
) -> DataFrame:
    """The same from two pixel tables, with the same errors."""
    a = earlier.select(*PIXEL, "value", F.lit(1).alias("period"))
    b = later.select(*PIXEL, "value", F.lit(2).alias("period"))
    return pair(a.union(b), 1, 2, grids=grids)


def masked_difference(pairs: DataFrame) -> DataFrame:
    """Later minus earlier; null where either is missing."""
    return pairs.withColumn("diff", F.col("v2") - F.col("v1"))


def on_grid(df: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Complete a pixel table with null rows for the cells of the skeleton it lacks."""
    return cells.join(df, list(keys), "left")


def missing_mask(df: DataFrame, cells: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """1 where the skeleton cell has no value, else 0."""
    return on_grid(df, cells, keys).select(
        *cells.columns, F.col("value").isNull().cast("int").alias("missing")
    )


def combined_mask(pairs: DataFrame) -> DataFrame:
    """1 where either year is missing."""
    return pairs.withColumn(
        "missing",
        F.greatest(F.col("v1").isNull().cast("int"), F.col("v2").isNull().cast("int")),
    )


def apply_mask(df: DataFrame, value: str = "value", mask: str = "missing") -> DataFrame:
    """Zero the flagged pixels."""
    return df.withColumn(value, F.when(F.col(mask) == 0, F.col(value)).otherwise(F.lit(0.0)))


def zscore(df: DataFrame, groups: Sequence[str] = ("period",)) -> DataFrame:
    """Fill missing pixels with the stack minimum, then standardise the whole stack.

    Mean and spread of the filled stack follow from one pass over the moments of the
    valid pixels and the number of missing ones.
    """
    missing = (F.col("_all") - F.col("_n")) / F.col("_all")
    present = F.col("_n") / F.col("_all")
    mean = present * F.col("_avg") + missing * F.col("_lo")
    spread = present * (F.col("_var") + F.pow(F.col("_avg") - mean, 2.0)) + missing * F.pow(
        F.col("_lo") - mean, 2.0
    )
    stats = (
        df.groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("_all"),
            F.count("value").alias("_n"),
            F.avg("value").alias("_avg"),
            F.var_pop("value").alias("_var"),
            F.min("value").alias("_lo"),
        )
        .select(*groups, "_lo", mean.alias("_mean"), F.sqrt(spread).alias("_std"))
    )
    filled = F.coalesce(F.col("value"), F.col("_lo"))
    return (
        join_stats(df, stats, groups)
        .withColumn("value", (filled - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0)))
        .drop("_lo", "_mean", "_std")
    )


def no_data_mask(df: DataFrame, first_band: int = 1, by: Sequence[str] = ("period",)) -> DataFrame:
    """Cells of the first band that are missing or equal to that band's minimum."""
    band = df.where(F.col("band") == first_band)
    low = band.groupBy(*by).agg(F.min("value").alias("_lo"))
    return join_stats(band, low, by).select(
        *by,
        *CELL,
        (F.col("value").isNull() | (F.col("value") == F.col("_lo"))).alias("no_data"),
    )


def minmax01(df: DataFrame, value: str = "value", by: Sequence[str] = ("band",)) -> DataFrame:
    """Scale to [0, 1] per group; a constant map becomes null."""
    stats = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return (
        join_stats(df, stats, by)
        .withColumn(value, minmax(F.col(value), F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )
