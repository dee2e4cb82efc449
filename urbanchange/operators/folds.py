"""Stratified folds by a seeded hash order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.functions.ordering import numbered_by_hash


def stratified_folds(
    df: DataFrame,
    key: str,
    label: str = "label",
    k: int = 10,
    seed: int = 42,
    name: str = "fold",
) -> DataFrame:
    """Deal the rows of each class into ``k`` folds in the order of md5(seed, key).

    ``key`` identifies a row, so a retry or another engine gives the same folds.
    """
    digest = F.md5(F.concat_ws("_", F.lit(str(seed)), F.col(key).cast("string")))
    numbered = numbered_by_hash(df.withColumn("_md5", digest), [label], "_md5", [key], "_rn")
    return numbered.withColumn(name, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop(
        "_md5", "_rn"
    )


def repeated_folds(
    df: DataFrame, key: str, label: str = "label", k: int = 10, repeats: int = 3, seed: int = 42
) -> DataFrame:
    """One row per (row, repeat) with its fold; every repeat has its own seed."""
    parts = [
        stratified_folds(df, key, label, k, seed + r).withColumn("repeat", F.lit(r))
        for r in range(repeats)
    ]
    return reduce(DataFrame.unionByName, parts)
