"""Tables behind the study's maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.config import Grid
from urbanchange.operators.overlay import clipped_layer_area
from urbanchange.operators.rings import clean_rings
from urbanchange.operators.scanfill import covered_cells
from urbanchange.operators.score import DISADVANTAGED, SCORE
from urbanchange.sources.pixels import pixel_xy


def score_layer(scores: DataFrame, score: str = SCORE) -> DataFrame:
    """Fill value for flagged areas; the other areas are outlines."""
    flagged = F.coalesce(F.col(DISADVANTAGED).cast("boolean"), F.lit(False))
    return scores.withColumns(
        {"fill": F.when(flagged, F.col(score)), "outline_only": ~flagged}
    )


def change_points(changes: DataFrame, grid: Grid) -> DataFrame:
    """Map coordinates of the changed pixels."""
    x, y = pixel_xy(grid)
    return changes.where(F.col("changed") > 0).withColumns({"x": x, "y": y})


def protected_overlap(
    changes: DataFrame,
    protected: DataFrame,
    extent: DataFrame,
    grid: Grid,
) -> DataFrame:
    """Changed pixels of the extent inside and outside the protected areas, per band."""
    study = covered_cells(extent, ["code"], grid).select("row_", "col_").distinct()
    inside = (
        covered_cells(clean_rings(protected), ["feature_id"], grid)
        .select("row_", "col_")
        .distinct()
        .withColumn("_in", F.lit(True))
    )
    cells = study.join(inside, ["row_", "col_"], "left")
    hits = changes.where(F.col("changed") > 0).join(cells, ["row_", "col_"])
    return hits.groupBy("band").agg(
        F.count("_in").alias("inside"),
        (F.count(F.lit(1)) - F.count("_in")).alias("outside"),
        (F.lit(100.0) * F.count("_in") / F.count(F.lit(1))).alias("inside_pct"),
    )


def borough_layer(
    areas: DataFrame,
    planning: DataFrame,
    boroughs: Sequence,
    layers: Sequence[str],
    borough_col: str = "borough",
    probability: str = "probs",
    size: float | None = None,
) -> DataFrame:
    """Areas of the chosen boroughs with probability and clipped planning-layer areas.

    Layers that are not in the planning table give 0.
    """
    chosen = areas.where(F.col(borough_col).isin(list(boroughs)))
    wanted = planning.where(F.col("layer").isin(list(layers)))
    parts = clipped_layer_area(wanted, chosen, size)
    per_area = parts.groupBy("code").agg(
        *[F.sum(F.when(F.col("layer") == n, F.col("area"))).alias(n) for n in layers]
    )
    return chosen.join(per_area, "code", "left").select(
        borough_col,
        "code",
        probability,
        *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in layers],
    )
