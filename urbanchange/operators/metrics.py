"""Classification metrics from a prediction table (label, pred, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.functions.ordering import running_counts

METRICS = ("balanced_accuracy", "f1_weighted", "roc_auc")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class and the balanced weight n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return counts.join(F.broadcast(whole), F.lit(True), "left").select(
        label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight")
    )


def positive_weight(df: DataFrame, label: str = "label") -> float:
    """Negatives per positive; an absent class counts as one row."""
    row = df.agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("neg"),
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
    ).first()
    return (row["neg"] or 1) / (row["pos"] or 1)


def _per_class(df: DataFrame, by: list[str]) -> DataFrame:
    """True positives, actual and predicted rows per class; one row per (group, class)."""
    table = df.groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    sides = table.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said")),
                F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said")),
            )
        ).alias("e"),
        F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"),
    )
    return sides.groupBy(*by, F.col("e.c").alias("c")).agg(
        F.sum("e.actual").alias("actual"),
        F.sum("e.said").alias("said"),
        (F.sum("hit") / 2).alias("tp"),
    )


def confusion_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Balanced accuracy (mean recall of the classes present) and support-weighted F1."""
    by = list(by)
    f1 = F.when(
        F.col("actual") + F.col("said") > 0,
        2.0 * F.col("tp") / (F.col("actual") + F.col("said")),
    ).otherwise(0.0)
    return (
        _per_class(df, by)
        .groupBy(*by)
        .agg(
            F.avg(F.when(F.col("actual") > 0, F.col("tp") / F.col("actual"))).alias(
                "balanced_accuracy"
            ),
            (F.sum(F.col("actual") * f1) / F.sum("actual")).alias("f1_weighted"),
        )
    )


def balanced_accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return confusion_metrics(df, by).select(*by, "balanced_accuracy")


def f1_weighted(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return confusion_metrics(df, by).select(*by, "f1_weighted")


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half."""
    by = list(by)
    counts = df.groupBy(*by, F.col("score").cast("double").alias("score")).agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
        F.count(F.when(F.col("label") == 0, 1)).alias("neg"),
    )
    below = running_counts(counts, by, "score", "neg")
    won = F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return below.groupBy(*by).agg((won / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def cv_metrics(
    predictions: DataFrame,
    by: Sequence[str] = (),
    folds: Sequence[str] = ("repeat", "fold"),
    skip_roc_auc: bool = False,
) -> DataFrame:
    """Mean over folds of all metrics, from one out-of-fold prediction table."""
    by, folds = list(by), list(folds)
    per_fold = confusion_metrics(predictions, by + folds)
    if skip_roc_auc:
        per_fold = per_fold.withColumn("roc_auc", F.lit(float("nan")))
    else:
        per_fold = per_fold.join(roc_auc(predictions, by + folds), by + folds, "left")
    return per_fold.groupBy(*by).agg(*[F.avg(m).alias(m) for m in METRICS])
