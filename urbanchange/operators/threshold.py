"""Automatic thresholds of change maps from one 256-bin histogram per band."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanchange.functions.skew import join_stats, materialize, spread
from urbanchange.operators.components import remove_small, segment

BINS = 256
STRATEGIES = ("adaptive", "otsu", "multiotsu", "scaledOtsu", "otsu8", "triangle")


def histogram(df: DataFrame, by: Sequence[str] = ("band",), bins: int = BINS) -> DataFrame:
    """Counts of equal-width bins per group, with the group's range ``lo``, ``hi``."""
    by = list(by)
    valid = df.where(F.col("value").isNotNull())
    limits = valid.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    spot = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * float(bins))
    bin_ = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(spot, F.lit(bins - 1)))
    return (
        join_stats(valid, limits, by)
        .groupBy(*by, "lo", "hi", bin_.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _centre(bin_: Column, bins: int = BINS) -> Column:
    return F.col("lo") + (bin_ + 0.5) * (F.col("hi") - F.col("lo")) / float(bins)


def _cumulative(hist: DataFrame, by: list[str]) -> DataFrame:
    """Running count and running sum of bin numbers; at most 256 rows per group."""
    running = W.partitionBy(*by).orderBy("bin")
    whole = W.partitionBy(*by)
    first = F.col("bin") * F.col("n")
    return hist.select(
        *by,
        "lo",
        "hi",
        "bin",
        F.sum("n").over(running).alias("w"),
        F.sum(first).over(running).alias("s"),
        F.sum("n").over(whole).alias("wt"),
        F.sum(first).over(whole).alias("st"),
    )


def otsu_from_histogram(hist: DataFrame, by: Sequence[str] = ("band",)) -> DataFrame:
    """Threshold with the largest between-class variance, the lowest bin on a tie.

    Bin numbers stand in for bin centres: the optimum is the same, and integer sums make
    ties exact. A constant group gets its own value.
    """
    by = list(by)
    return _otsu_bins(hist, by).select(
        *by,
        F.when(F.col("lo") == F.col("hi"), F.col("lo"))
        .otherwise(_centre(F.col("bin")))
        .alias("threshold"),
    )


def _otsu_bins(hist: DataFrame, by: list[str]) -> DataFrame:
    rest = F.col("wt") - F.col("w")
    gap = F.col("s") / F.col("w") - (F.col("st") - F.col("s")) / F.nullif(rest, F.lit(0))
    score = F.col("w") * rest * gap * gap
    best = F.max_by("bin", F.struct(F.coalesce(score, F.lit(-1.0)), -F.col("bin")))
    return _cumulative(hist, by).groupBy(*by, "lo", "hi").agg(best.alias("bin"))


def multi_otsu_from_histogram(hist: DataFrame, by: Sequence[str] = ("band",)) -> DataFrame:
    """Both boundaries of three classes; ``threshold`` is the upper one.

    The running sums of a group become two 256-element arrays; one row per lower boundary
    looks for its best upper boundary inside the arrays, so boundaries are never paired by
    a join. Groups with fewer than three filled bins have no three classes: null.
    """
    by = list(by)
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    counts = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    arrays = (
        hist.groupBy(*by, "lo", "hi")
        .agg(counts.alias("_m"), F.count(F.lit(1)).alias("filled"))
        .withColumn(
            "_c",
            F.transform(
                bins, lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0).cast("long"))
            ),
        )
    )
    zero = F.lit(0).cast("long")

    def running(values: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("a"), zero.alias("t"))
        return F.aggregate(
            values,
            start,
            lambda acc, v: F.struct(
                F.concat(acc["a"], F.array(acc["t"] + v)).alias("a"), (acc["t"] + v).alias("t")
            ),
            lambda acc: acc["a"],
        )

    arrays = arrays.select(
        *by,
        "lo",
        "hi",
        "filled",
        running(F.col("_c")).alias("w"),
        running(F.transform("_c", lambda n, b: n * b)).alias("s"),
    )
    arrays = arrays.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(BINS - 3))))

    def share(s: Column, w: Column) -> Column:
        return F.when(w > 0, s.cast("double") * s.cast("double") / w).otherwise(0.0)

    w_i, s_i = F.get("w", F.col("i")), F.get("s", F.col("i"))
    w_t, s_t = F.get("w", F.lit(BINS - 1)), F.get("s", F.lit(BINS - 1))

    def candidate(j: Column) -> Column:
        w_j, s_j = F.get("w", j), F.get("s", j)
        score = share(s_i, w_i) + share(s_j - s_i, w_j - w_i) + share(s_t - s_j, w_t - w_j)
        return F.struct(score.alias("score"), (-F.col("i")).alias("i"), (-j).alias("j"))

    js = F.sequence(F.col("i") + 1, F.lit(BINS - 2))
    best = arrays.select(
        *by, "lo", "hi", "filled", F.array_max(F.transform(js, candidate)).alias("best")
    )
    top = best.groupBy(*by, "lo", "hi", "filled").agg(F.max("best").alias("best"))

    def boundary(index: str) -> Column:
        return F.when(F.col("filled") >= 3, _centre(-F.col(f"best.{index}")))

    few = F.col("filled") == 3
    exact = hist.groupBy(*by).agg(
        F.sort_array(F.collect_list("bin")).alias("_bins")
    )
    return top.join(exact, by).select(
        *by,
        F.when(few, _centre(F.get("_bins", F.lit(0)))).otherwise(boundary("i")).alias("lower"),
        F.when(few, _centre(F.get("_bins", F.lit(1)))).otherwise(boundary("j")).alias("threshold"),
    )


def otsu(df: DataFrame, by: Sequence[str] = ("band",)) -> DataFrame:
    return otsu_from_histogram(histogram(df, by), by)


def multi_otsu(df: DataFrame, by: Sequence[str] = ("band",)) -> DataFrame:
    return multi_otsu_from_histogram(histogram(df, by), by)


def scaled_otsu(df: DataFrame, factor: float, by: Sequence[str] = ("band",)) -> DataFrame:
    return otsu(df, by).withColumn("threshold", F.col("threshold") * F.lit(float(factor)))


def above(df: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("band",)) -> DataFrame:
    """Binary map: 1 strictly above the group's threshold."""
    flag = F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)).cast("int")
    return (
        join_stats(df, thresholds.select(*by, "threshold"), by, "left")
        .withColumn("changed", flag)
        .drop("threshold")
    )


def histogram_8bit(df: DataFrame, by: Sequence[str] = ("band",)) -> DataFrame:
    """Counts of the 256 levels of a map with values in [0, 1]."""
    level = F.least(F.floor(F.abs("value") * 255.0), F.lit(255)).cast("int")
    return (
        df.where(F.col("value").isNotNull())
        .groupBy(*by, level.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def otsu_8bit(df: DataFrame, by: Sequence[str] = ("band",), scale: float = 1.0) -> DataFrame:
    """Otsu level of the 8-bit map, brought back to [0, 1] and scaled."""
    limits = {"lo": F.lit(0.0), "hi": F.lit(255.0)}
    levels = _otsu_bins(histogram_8bit(df, by).withColumns(limits), list(by))
    return levels.select(*by, (F.col("bin") * F.lit(scale) / 255.0).alias("threshold"))


def triangle(df: DataFrame, by: Sequence[str] = ("band",), scale: float = 0.5) -> DataFrame:
    """Triangle threshold of an 8-bit map with values in [0, 1], times ``scale``.

    The level farthest from the line between the histogram's peak and the end of its
    longer tail, one level further out; on a tie the level nearest to the tail's end.
    """
    by = list(by)
    hist = histogram_8bit(df, by)
    ends = hist.groupBy(*by).agg(
        F.min("bin").alias("_min"),
        F.max("bin").alias("_max"),
        F.max("n").alias("_peak"),
        F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("_top"),
    )
    # The scan runs from one empty level outside the data up to the peak; a longer right
    # tail is mirrored first.
    left = F.when(F.col("_min") > 0, F.col("_min") - 1).otherwise(F.col("_min"))
    right = F.when(F.col("_max") < 255, F.col("_max") + 1).otherwise(F.col("_max"))
    flipped = (F.col("_top") - left) < (right - F.col("_top"))
    ends = ends.select(
        *by,
        "_peak",
        flipped.alias("_flip"),
        F.when(flipped, 255 - right).otherwise(left).alias("_from"),
        F.when(flipped, 255 - F.col("_top")).otherwise(F.col("_top")).alias("_to"),
    )
    levels = join_stats(hist, ends, by)
    at = F.when(F.col("_flip"), 255 - F.col("bin")).otherwise(F.col("bin"))
    # Empty levels can win too, so every level of the scan gets a row; 256 per group.
    scan = ends.select("*", F.explode(F.sequence("_from", "_to")).alias("_at"))
    known = levels.select(*by, at.alias("_at"), "n")
    counted = scan.join(known, [*by, "_at"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    distance = F.when(F.col("_at") == F.col("_from"), F.lit(0).cast("long")).otherwise(
        F.col("_peak") * F.col("_at") + (F.col("_from") - F.col("_to")) * F.col("n")
    )
    best = F.max_by("_at", F.struct(distance.alias("d"), -F.col("_at")))
    picked = counted.groupBy(*by, "_flip").agg(best.alias("_best"))
    index = F.col("_best") - 1
    return picked.select(
        *by,
        (F.when(F.col("_flip"), 255 - index).otherwise(index) * F.lit(scale) / 255.0).alias(
            "threshold"
        ),
    )


def _blur_lines(df: DataFrame, by: list[str], line: str, along: str, sigma: float) -> DataFrame:
    """Gaussian blur of every image line; a group is one line, at most the image width.

    Values stand at their place along the line; where cells are absent the weights of the
    others are scaled up.
    """
    radius = int(4.0 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()

    def blur(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(along)
        at = (pdf[along] - pdf[along].iloc[0]).to_numpy()
        values, known = np.zeros(at[-1] + 1), np.zeros(at[-1] + 1)
        values[at], known[at] = pdf["value"].to_numpy(dtype=float), 1.0

        def smooth(line: np.ndarray) -> np.ndarray:
            return np.convolve(np.pad(line, radius, mode="edge"), taps, mode="valid")[at]

        blurred = smooth(values)
        return pdf.assign(value=blurred if known.all() else blurred / smooth(known))

    return spread(df, [*by, line]).groupBy(*by, line).applyInPandas(blur, df.schema)


def gaussian(df: DataFrame, sigma: float, by: Sequence[str] = ("band",)) -> DataFrame:
    """Separable Gaussian blur of images with repeated edge pixels; absent cells don't count."""
    by = list(by)
    slim = df.select(*by, "row_", "col_", F.col("value").cast("double").alias("value"))
    across = _blur_lines(slim, by, "row_", "col_", sigma)
    return _blur_lines(across, by, "col_", "row_", sigma)


def adaptive(
    df: DataFrame,
    min_size: int,
    sigmas: Sequence[float] = (101, 151, 201),
    by: Sequence[str] = ("band",),
) -> DataFrame:
    """Union over blur widths of pixels above twice the blurred map, small objects removed."""
    by = list(by)
    keys = [*by, "row_", "col_"]
    slim = materialize(df.select(*keys, F.col("value").cast("double").alias("value")))
    votes = None
    for sigma in sigmas:
        blurred = gaussian(slim, sigma, by).withColumnRenamed("value", "_blur")
        flagged = slim.join(blurred, keys).withColumn(
            "changed", (F.col("value") > 2.0 * F.col("_blur")).cast("int")
        )
        kept = remove_small(flagged.select(*keys, "changed"), min_size, by)
        votes = kept if votes is None else votes.unionByName(kept)
    return votes.groupBy(*keys).agg(F.max("changed").alias("changed"))


def apply_strategy(
    df: DataFrame,
    strategy: str = "otsu",
    min_size: int = 128,
    scale: float = 1.0,
    segmented: bool = False,
    segment_min_size: int = 10,
    by: Sequence[str] = ("band",),
) -> DataFrame:
    """Binary map (or labels) of a [0, 1] map by the named strategy.

    ``scale`` multiplies the level of ``scaledOtsu``, ``otsu8`` and (from a half) ``triangle``.
    """
    by = list(by)
    if strategy == "adaptive":
        binary = adaptive(df, min_size, by=by)
    elif strategy in STRATEGIES:
        limits = {
            "otsu": lambda: otsu(df, by),
            "multiotsu": lambda: multi_otsu(df, by),
            "scaledOtsu": lambda: scaled_otsu(df, scale, by),
            "otsu8": lambda: otsu_8bit(df, by, scale),
            "triangle": lambda: triangle(df, by, scale / 2),
        }[strategy]()
        binary = remove_small(
            above(df, limits, by).select(*by, "row_", "col_", "changed"), min_size, by
        )
    else:
        raise ValueError(f"unknown thresholding strategy {strategy!r}; known: {STRATEGIES}")
    return segment(binary, segment_min_size, by) if segmented else binary
