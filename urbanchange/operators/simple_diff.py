"""Image-algebra change map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.functions.skew import materialize
from urbanchange.operators.masks import PIXEL, minmax01, pair, zscore


def change_map(df: DataFrame, earlier, later, period: str = "period") -> DataFrame:
    """Absolute difference of the standardised composites, scaled to [0, 1] per band.

    ``df`` holds both composites, complete on the grid (missing pixels as null rows).
    """
    both = df.where(F.col(period).isin(earlier, later))
    pairs = materialize(pair(zscore(both, [period]), earlier, later, period))
    gap = pairs.select(*PIXEL, F.abs(F.col("v2") - F.col("v1")).alias("value"))
    return minmax01(gap, "value", ["band"])
