"""Agreement of two maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_agreement(
    df: DataFrame,
    predicted: str = "p",
    target: str = "t",
    by: Sequence[str] = (),
    smooth: float = 1.0,
) -> DataFrame:
    """Soft Dice loss and mean squared error per group."""
    p, t = F.col(predicted), F.col(target)
    overlap = F.lit(2.0) * F.sum(p * t) + F.lit(smooth)
    return df.groupBy(*by).agg(
        (F.lit(1.0) - overlap / (F.sum(p) + F.sum(t) + F.lit(smooth))).alias("dice_loss"),
        F.avg((p - t) * (p - t)).alias("mse"),
    )
