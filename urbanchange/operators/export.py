"""Shareable per-area table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.config import MEASURES, Study
from urbanchange.operators.score import DISADVANTAGED, INDEX_T1, INDEX_T2, SCORE
from urbanchange.operators.table import _quartile_label

SCORE_COLUMNS = [
    Study.code,
    "LSOA11NM",
    "LAD11NM",
    *[f"t{t}_{m}" for m in MEASURES for t in (1, 2)],
    INDEX_T1,
    INDEX_T2,
    DISADVANTAGED,
    SCORE,
]


def add_binary_label(df: DataFrame, score: str = SCORE, name: str = "gentrified") -> DataFrame:
    """1 above the upper quartile of the whole table, 0 below the lower one, else null."""
    return _quartile_label(df, score, 75.0, 25.0, name)


def export_table(
    scores: DataFrame,
    features: DataFrame,
    key: str = Study.code,
    default_crs: str = Study.boundary_crs,
) -> DataFrame:
    """Listed score columns that are present, the label, and the change features."""
    wanted = [key if c == Study.code else c for c in SCORE_COLUMNS]
    kept = [c for c in wanted if c in scores.columns]
    geometry = [c for c in ("rings",) if c in scores.columns]
    out = add_binary_label(scores.select(*kept, *geometry)).join(features, key, "left")
    return out.withColumn("crs", F.lit(default_crs)) if geometry else out
