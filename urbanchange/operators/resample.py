"""Bilinear resampling between pixel grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_WEIGHTS = 1_000_000  # weight rows of one axis up to which it is broadcast


def _axis(spark: SparkSession, source: int, target: int, name: str) -> DataFrame:
    """Weights of one axis: target index, source index, weight; two rows per target index."""
    at = F.least(
        F.greatest((F.col("id") + 0.5) * F.lit(source / target) - 0.5, F.lit(0.0)),
        F.lit(float(source - 1)),
    )
    low = F.floor("_at")
    sides = F.array(
        F.struct(low.alias("s"), (1.0 - (F.col("_at") - low)).alias("w")),
        F.struct(F.least(low + 1, F.lit(source - 1)).alias("s"), (F.col("_at") - low).alias("w")),
    )
    weights = (
        spark.range(target)
        .withColumn("_at", at)
        .select(F.col("id").cast("int").alias(f"t_{name}"), F.explode(sides).alias("_e"))
        .where("_e.w > 0")
        .select(
            f"t_{name}",
            F.col("_e.s").cast("int").alias(f"{name}_"),
            F.col("_e.w").alias(f"w_{name}"),
        )
    )
    return F.broadcast(weights) if 2 * target <= BROADCAST_WEIGHTS else weights


def resample_bilinear(
    pixels: DataFrame,
    source: tuple[int, int],
    target: tuple[int, int],
    keys: Sequence[str] = ("band",),
) -> DataFrame:
    """Resize every image to ``target`` (height, width), half-pixel centres, clamped edges.

    Rows and columns are weighted one after the other through weight tables whose size is
    known from the arguments, so the pixels themselves are shuffled only to be summed.
    """
    spark = pixels.sparkSession
    rows = _axis(spark, source[0], target[0], "row")
    cols = _axis(spark, source[1], target[1], "col")
    return (
        pixels.join(rows, "row_")
        .join(cols, "col_")
        .groupBy(*keys, F.col("t_row").alias("row_"), F.col("t_col").alias("col_"))
        .agg(F.sum(F.col("value") * F.col("w_row") * F.col("w_col")).alias("value"))
    )
