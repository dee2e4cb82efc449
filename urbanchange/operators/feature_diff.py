"""Change map from the feature channels of any extractor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.functions.skew import join_stats
from urbanchange.operators.masks import minmax01


def feature_difference(
    features: DataFrame, earlier, later, no_data: DataFrame | None = None, period: str = "period"
) -> DataFrame:
    """Standardise each date's whole feature stack, average channels, scale |difference|.

    ``features`` is (period, channel, row_, col_, value) on the target grid; ``no_data``
    lists the (row_, col_) whose features are zeroed first.
    """
    if no_data is not None:
        cells = no_data.select("row_", "col_", F.lit(True).alias("_gap")).distinct()
        features = features.join(cells, ["row_", "col_"], "left").withColumn(
            "value", F.when(F.col("_gap"), F.lit(0.0)).otherwise(F.col("value"))
        )
    stats = features.groupBy(period).agg(
        F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std")
    )
    scaled = join_stats(features, stats, [period]).withColumn(
        "_z", (F.col("value") - F.col("_mean")) / F.nullif("_std", F.lit(0.0))
    )
    gap = scaled.groupBy("row_", "col_").agg(
        F.abs(
            F.avg(F.when(F.col(period) == earlier, F.col("_z")))
            - F.avg(F.when(F.col(period) == later, F.col("_z")))
        ).alias("value")
    )
    return minmax01(gap, "value", [])
