"""Temporal composites of scene observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.config import BAND_ASSETS, CLOUD_CLASSES, GREEN_CLASSES, LANDCOVER_CLASSES
from urbanchange.functions.columns import solar_day
from urbanchange.functions.ordering import grouped_quantiles
from urbanchange.functions.skew import HOT_ROWS
from urbanchange.operators.masks import mask_clouds


def with_asset_names(df: DataFrame) -> DataFrame:
    """Band name and asset name of a 1-based band number, from a literal map."""
    names = F.array(*[F.lit(b) for b in BAND_ASSETS])
    assets = F.array(*[F.lit(a) for a in BAND_ASSETS.values()])
    return df.withColumn("band_name", F.get(names, F.col("band") - 1)).withColumn(
        "asset", F.get(assets, F.col("band") - 1)
    )


def fuse_solar_days(
    df: DataFrame,
    keys: Sequence[str] = ("band", "row_", "col_"),
    order: Sequence[str] = ("ts", "scene_id"),
    lon: float = 0.0,
) -> DataFrame:
    """One value per pixel and local solar day: the first valid one in scene order."""
    day = solar_day(F.col("ts"), F.lit(lon))
    first = F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(*order)))
    return df.groupBy(*keys, day.alias("solar_day")).agg(first.alias("value"))


def median_composite(
    df: DataFrame,
    keys: Sequence[str] = ("period", "band", "row_", "col_"),
    drop: Sequence[int] = CLOUD_CLASSES,
    hot_rows: int = HOT_ROWS,
    months: tuple[int, int] | None = None,
    keep_empty: bool = True,
) -> DataFrame:
    """Cloud-masked median over time; pixels under constant cloud stay, as null.

    ``months`` (first and last) keeps the observations of a season, by ``ts``. Without
    ``keep_empty`` such pixels have no row and masked observations are not grouped, for
    composites that are completed on a grid anyway.
    Crowded pixels are looked for in blocks of 16 x 16 pixels, which a scene fills at once.
    """
    if months is not None:
        df = df.where(F.month("ts").isin(*range(months[0], months[1] + 1)))
    coarse = [F.shiftright(k, 4) if k in ("row_", "col_") else F.col(k) for k in keys]
    clear = mask_clouds(df, drop)
    if not keep_empty:
        clear = clear.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    return grouped_quantiles(clear, keys, "value", {"value": 0.5}, hot_rows, coarse=coarse)


def require_scenes(scenes: DataFrame, what: str) -> DataFrame:
    if scenes.isEmpty():
        raise RuntimeError(f"no scenes found for {what}")
    return scenes


def landcover_mode(df: DataFrame, keys: Sequence[str] = ("row_", "col_")) -> DataFrame:
    """Most frequent class per cell, the lowest class on a tie.

    Two map-side combined steps: counts per (cell, class), then the best class per cell.
    """
    counts = df.groupBy(*keys, "cls").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("cls", F.struct(F.col("n"), -F.col("cls")))
    return counts.groupBy(*keys).agg(best.alias("cls"))


def with_green_mask(df: DataFrame) -> DataFrame:
    """Class label and green flag (trees, grass)."""
    labels = F.array(*[F.lit(c) for c in LANDCOVER_CLASSES])
    return df.withColumn("label", F.get(labels, F.col("cls"))).withColumn(
        "green", F.col("cls").isin(list(GREEN_CLASSES))
    )
