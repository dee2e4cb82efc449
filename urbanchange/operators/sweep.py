"""Sweep of the change threshold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanchange.functions.skew import materialize
from urbanchange.operators.classify import FOREST, Forest, ModelSpec, cross_validated, forest_votes
from urbanchange.operators.metrics import cv_metrics
from urbanchange.operators.rings import polygon_area

METRICS = ("f1", "balanced_accuracy", "roc_auc")


def default_thresholds(low: float = 100.0, high: float = 800.0, n: int = 30) -> list[int]:
    """Evenly spaced thresholds, rounded (half to even) to whole numbers."""
    return [round(low + i * (high - low) / (n - 1)) for i in range(n)]


def thresholds_table(
    spark: SparkSession, low: float = 100.0, high: float = 800.0, n: int = 30
) -> DataFrame:
    step = F.lit(low) + F.col("id") * F.lit((high - low) / (n - 1))
    return spark.range(n).select(
        F.col("id").cast("int").alias("i"), F.rint(step).cast("int").alias("threshold")
    )


def threshold_features(
    pairs: DataFrame,
    zone_pixels: DataFrame,
    zones: DataFrame,
    thresholds: Sequence[int],
    bands: Sequence[int],
) -> DataFrame:
    """Percent of changed pixels per zone, band and threshold, all thresholds in one pass.

    Pixels are read and joined once. A pixel counts in one bucket, the number of thresholds
    its gap exceeds; the count above a threshold is a sum over the few buckets of a zone and
    band. Columns are named features_band_<b>_<t>.
    """
    limits = sorted(thresholds)
    gap = F.abs(F.col("v2") - F.col("v1"))
    passed = F.size(F.filter(F.array(*[F.lit(t) for t in limits]), lambda t: F.col("_gap") > t))
    buckets = (
        pairs.select("band", "row_", "col_", gap.alias("_gap"))
        .where(F.col("band").isin(list(bands)) & (F.col("_gap") > limits[0]))
        .withColumn("_passed", passed)
        .join(zone_pixels, ["row_", "col_"])
        .groupBy("code", "band", "_passed")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counted = buckets.groupBy("code").agg(
        *[
            F.sum(F.when((F.col("band") == b) & (F.col("_passed") > i), F.col("_n"))).alias(f"_n_{b}_{t}")
            for b in bands
            for i, t in enumerate(limits)
        ]
    )
    return (
        polygon_area(zones)
        .join(counted, "code", "left")
        .select(
            "code",
            *[
                (F.coalesce(F.col(f"_n_{b}_{t}"), F.lit(0)) / F.col("area") * 100.0).alias(
                    f"features_band_{b}_{t}"
                )
                for b in bands
                for t in thresholds
            ],
        )
    )


def columns_by_threshold(columns: Sequence[str]) -> dict[int, list[str]]:
    """Change columns under the number that ends their name after an underscore."""
    found: dict[int, list[str]] = {}
    for name in columns:
        stem, _, number = name.rpartition("_")
        if stem and number.isdigit():
            found.setdefault(int(number), []).append(name)
    return found


def evaluate_thresholds(
    df: DataFrame,
    planning: Sequence[str],
    key: str,
    thresholds: Sequence[int] | None = None,
    spec: ModelSpec = FOREST,
    params: dict | None = None,
    folds: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Cross-validated metrics at every threshold: threshold, f1, balanced_accuracy, roc_auc.

    ``df`` has ``label`` and one set of change columns per threshold. Forests of all thresholds
    and folds are grown together.
    """
    base = materialize(df)
    change = columns_by_threshold(base.columns)
    limits = [int(t) for t in thresholds or default_thresholds()]
    for threshold in limits:
        if not change.get(threshold):
            raise ValueError(f"no change columns for threshold {threshold}")
    sets = [[*change[t], *planning] for t in limits]
    if isinstance(spec.build, Forest):
        table = forest_votes(base, sets, params or {}, key, folds, seed=seed)
    else:
        each = [cross_validated(base, s, spec, [params or {}], key, folds, seed=seed) for s in sets]
        table = reduce(DataFrame.unionByName, [t.withColumn("candidate", F.lit(i)) for i, t in enumerate(each)])
    named = F.element_at(F.array(*[F.lit(t) for t in limits]), F.col("candidate") + 1).alias("threshold")
    scored = cv_metrics(materialize(table), ["candidate"], skip_roc_auc=spec.skip_roc_auc)
    return scored.select(named, F.col("f1_weighted").alias("f1"), "balanced_accuracy", "roc_auc")


def best_threshold(points: DataFrame, metric: str = "f1") -> DataFrame:
    """The point with the largest metric; the lowest threshold on a tie."""
    best = F.max_by(
        F.struct(*points.columns), F.struct(F.col(metric), -F.col("threshold"))
    )
    return points.agg(best.alias("_b")).select("_b.*")
