"""Changed pixels per zone and the zone-by-band feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.config import Grid
from urbanchange.operators.rings import polygon_area
from urbanchange.operators.scanfill import rasterize_zones


def count_changed(
    changes: DataFrame, zone_pixels: DataFrame, zones: DataFrame, min_value: float = 0.0
) -> DataFrame:
    """Changed pixels (strictly above ``min_value``) per zone; zones without any give 0."""
    hits = (
        changes.where(F.col("changed") > min_value)
        .groupBy("row_", "col_")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(zone_pixels, ["row_", "col_"])
        .groupBy("code")
        .agg(F.sum("_n").alias("changed_px"))
    )
    return (
        zones.select("code")
        .distinct()
        .join(hits, "code", "left")
        .select("code", F.coalesce("changed_px", F.lit(0)).alias("changed_px"))
    )


def feature_matrix(
    changes: DataFrame,
    zones: DataFrame,
    grid: Grid,
    bands: Sequence[int],
    model: str = "simple_diff",
    min_value: float = 0.0,
    zone_pixels: DataFrame | None = None,
) -> DataFrame:
    """Changed pixels per zone and band as a percentage of the zone area, one column per band.

    The count is divided by the area in the zone layer's own units; the size of a pixel
    is not applied. ``changes`` has one row per changed (band, cell). Without bands only
    the codes come back.
    """
    if not bands:
        return zones.select("code").distinct()
    owners = rasterize_zones(zones, grid) if zone_pixels is None else zone_pixels
    counted = (
        changes.where(F.col("changed") > min_value)
        .select("band", "row_", "col_")
        .join(owners, ["row_", "col_"])
        .groupBy("code")
        .agg(*[F.count(F.when(F.col("band") == b, 1)).alias(f"_n{b}") for b in bands])
    )
    share = [
        (F.coalesce(F.col(f"_n{b}"), F.lit(0)) / F.col("area") * 100.0).alias(
            f"features_band_{b}_{model}"
        )
        for b in bands
    ]
    return polygon_area(zones).join(counted, "code", "left").select("code", *share)
