"""Scene catalogue search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.config import Study
from urbanchange.functions.columns import window_end, window_start


def search_scenes(
    scenes: DataFrame,
    bbox: tuple[float, float, float, float],
    year: int,
    *,
    max_cloud: float | None = None,
    study: Study = Study(),
) -> DataFrame:
    """Scenes that meet ``bbox``, fall in the season of ``year`` and are clear enough."""
    clouds = study.max_cloud if max_cloud is None else max_cloud
    min_x, min_y, max_x, max_y = bbox
    start = window_start(F.lit(year), study.first_month)
    day_after = F.date_add(window_end(F.lit(year), study.last_month), 1).cast("timestamp")
    return scenes.where(
        (F.col("ts") >= start.cast("timestamp"))
        & (F.col("ts") < day_after)
        & (F.col("cloud_cover") < clouds)
        & (F.col("min_x") <= max_x)
        & (F.col("max_x") >= min_x)
        & (F.col("min_y") <= max_y)
        & (F.col("max_y") >= min_y)
    )
