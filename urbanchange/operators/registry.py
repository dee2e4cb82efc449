"""Change-detection methods by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.config import Grid
from urbanchange.functions.skew import materialize
from urbanchange.operators import context, masks, patches, simple_diff
from urbanchange.operators.components import remove_small
from urbanchange.operators.threshold import apply_strategy

MOST_BANDS = 10_000


def _pairs(df: DataFrame, earlier, later) -> DataFrame:
    """Standardised pairs, missing pixels filled."""
    both = df.where(F.col("period").isin(earlier, later))
    return materialize(masks.pair(masks.zscore(both), earlier, later))


def _simple(df: DataFrame, earlier, later, grid: Grid, **_) -> DataFrame:
    return simple_diff.change_map(df, earlier, later)


def _context(df: DataFrame, earlier, later, grid: Grid, **options) -> DataFrame:
    return masks.minmax01(context.spatial_context(_pairs(df, earlier, later), **options))


def _patch(df: DataFrame, earlier, later, grid: Grid, **options) -> DataFrame:
    return patches.score_patches(_pairs(df, earlier, later), grid, **options)


def _clusters(df: DataFrame, earlier, later, grid: Grid, **options) -> DataFrame:
    """Binary: the cluster with the larger mean difference is the changed one."""
    pairs = _pairs(df, earlier, later)
    bands = options.pop("bands", None) or _bands(pairs)
    found = materialize(context.pca_kmeans(pairs, bands, **options))
    gap = pairs.groupBy("row_", "col_").agg(
        F.avg(F.coalesce(F.abs(F.col("v2") - F.col("v1")), F.lit(0.0))).alias("gap")
    )
    means = found.join(gap, ["row_", "col_"]).groupBy("cluster").agg(F.avg("gap").alias("mean"))
    top = means.agg(F.max_by("cluster", F.struct("mean", "cluster"))).first()[0]
    changed = (F.col("cluster") == F.lit(top)).cast("double")
    return found.select(F.lit(0).alias("band"), "row_", "col_", changed.alias("value"))


def _bands(df: DataFrame) -> list:
    """All bands; one feature each for a classifier, so more than ``MOST_BANDS`` is an error."""
    rows = df.select("band").distinct().limit(MOST_BANDS + 1).collect()
    if len(rows) > MOST_BANDS:
        raise ValueError(f"more than {MOST_BANDS} bands")
    return sorted(r["band"] for r in rows)


METHODS: dict[str, Callable[..., DataFrame]] = {
    "simple_diff": _simple,
    "pca_kmeans": _clusters,
    "spatial_context": _context,
    "user_patch": _patch,
}


# Methods whose map is binary already: no threshold is sought in it.
BINARY = {"pca_kmeans"}


def get_method(name: str) -> Callable[..., DataFrame]:
    """Continuous change map function ``f(composites, earlier, later, grid, **options)``."""
    if name not in METHODS:
        raise ValueError(f"unknown change-detection method {name!r}; known: {sorted(METHODS)}")
    return METHODS[name]


def register_method(name: str, function: Callable[..., DataFrame], binary: bool = False) -> None:
    METHODS[name] = function
    (BINARY.add if binary else BINARY.discard)(name)


def binary_changes(
    df: DataFrame,
    earlier,
    later,
    grid: Grid,
    method: str = "simple_diff",
    strategy: str = "multiotsu",
    min_size: int = 4,
    **options,
) -> DataFrame:
    """Binary change map per band of one method, ready to be stored or aggregated."""
    found = materialize(get_method(method)(df, earlier, later, grid, **options))
    if method in BINARY:
        flags = found.select("band", "row_", "col_", (F.col("value") > 0).cast("int").alias("changed"))
        changes = remove_small(flags, min_size, ["band"])
    else:
        changes = apply_strategy(found, strategy, min_size)
    return changes.select(
        F.lit(method).alias("model"), "band", "row_", "col_", "changed"
    )
