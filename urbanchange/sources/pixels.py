"""Pixel tables: Parquet partitioned by year (or model) and band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanchange.config import Grid
from urbanchange.functions.columns import canonical


def read_pixels(
    spark: SparkSession,
    path: str,
    *,
    bands: Sequence[int] | None = None,
    years: Sequence[int] | None = None,
    nodata: float | None = None,
) -> DataFrame:
    """Read pixels, missing values as NULL; bands and years prune whole partitions."""
    df = spark.read.parquet(path)
    if bands is not None:
        df = df.where(F.col("band").isin(list(bands)))
    if years is not None:
        df = df.where(F.col("year").isin(list(years)))
    return df.withColumn("value", canonical(F.col("value"), nodata))


def write_pixels(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("year", "band"),
    *,
    skip_existing: bool = True,
) -> str:
    """Write a pixel table; an existing one is kept unless ``skip_existing`` is off."""
    mode = "ignore" if skip_existing else "overwrite"
    df.write.partitionBy(*partition_by).mode(mode).parquet(path)
    return path


def band_from_name(name: Column) -> Column:
    """Band number of a change-file name such as ``features_band_7_model``; fails if absent."""
    digits = F.regexp_extract(name, r"band_(\d+)", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("no band number in "), name)).cast("int")
    )


def read_change_files(spark: SparkSession, path: str) -> DataFrame:
    """Change maps stored as one Parquet file or folder per band, with the band from the name."""
    return spark.read.parquet(path).withColumn("band", band_from_name(F.col("_metadata.file_path")))


def year_tiles(tiles: DataFrame, year: int, suffix: str = "08-31.tif") -> DataFrame:
    """Tiles of one year by the ending of their file name."""
    return tiles.where(F.col("name").endswith(f"{year}-{suffix}")).orderBy("name")


def check_same_grid(earlier: Grid, later: Grid) -> Grid:
    """Both composites must share one shape; the earlier grid is kept."""
    if (earlier.width, earlier.height) != (later.width, later.height):
        raise ValueError(
            f"grids differ: {earlier.width}x{earlier.height} and {later.width}x{later.height}"
        )
    return earlier


def pixel_xy(grid: Grid) -> tuple[Column, Column]:
    """Map coordinates of the pixel centre."""
    x = F.lit(grid.x0) + (F.col("col_") + 0.5) * F.lit(grid.dx)
    y = F.lit(grid.y0) + (F.col("row_") + 0.5) * F.lit(grid.dy)
    return x, y
