"""Overlapping square patches: cut, score with any function, stitch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanchange.config import Grid
from urbanchange.functions.skew import materialize, spread
from urbanchange.operators.masks import minmax01

GROUP_PIXELS = 65_536  # pixels handed to one call of the scoring group, unless one window is larger


def _origins(pos: str, n: int, size: int, stride: int):
    """Patch numbers along one axis that contain the position; only whole windows."""
    last = (n - size) // stride
    low = F.greatest(F.ceil((F.col(pos) - (size - 1)) / stride), F.lit(0))
    high = F.least(F.floor(F.col(pos) / stride), F.lit(last))
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))


def patch_pixels(df: DataFrame, grid: Grid, size: int = 256, stride: int | None = None) -> DataFrame:
    """Every pixel once per window it belongs to: pi, pj and its place pr, pc inside."""
    step = size // 2 if stride is None else stride
    if grid.height < size or grid.width < size:
        return df.limit(0).selectExpr("*", "0 as pi", "0 as pj", "0 as pr", "0 as pc")
    return (
        df.withColumn("pi", F.explode(_origins("row_", grid.height, size, step)))
        .withColumn("pj", F.explode(_origins("col_", grid.width, size, step)))
        .withColumns(
            {"pr": F.col("row_") - F.col("pi") * step, "pc": F.col("col_") - F.col("pj") * step}
        )
    )


def extract_patches(
    df: DataFrame,
    grid: Grid,
    size: int = 256,
    stride: int | None = None,
    value: str = "value",
    by: Sequence[str] = ("band",),
) -> DataFrame:
    """One row per window with its values as a row-major array of size squared.

    Places of cells that ``df`` lacks are null.
    """
    place = (F.col("pr") * size + F.col("pc")).cast("int")
    found = F.sort_array(F.collect_list(F.struct(place.alias("at"), F.col(value).alias("v"))))
    kind = df.schema[value].dataType
    none = F.lit(None).cast(kind)

    def with_gap(e: Column, i: Column) -> Column:
        """The value after as many nulls as cells are absent before it."""
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get("_cells", i - 1)["at"])
        return F.concat(F.array_repeat(none, e["at"] - before - 1), F.array(e["v"]))

    tail = F.array_repeat(none, F.lit(size * size - 1) - F.element_at("_cells", -1)["at"])
    gapless = F.concat(F.flatten(F.transform("_cells", with_gap)), tail)
    packed = patch_pixels(df, grid, size, stride).groupBy(*by, "pi", "pj").agg(found.alias("_cells"))
    whole = F.when(F.size("_cells") == size * size, F.transform("_cells", lambda e: e["v"]))
    return packed.select(*by, "pi", "pj", whole.otherwise(gapless).alias("patch"))


def reconstruct(
    patches: DataFrame,
    cells: DataFrame,
    size: int = 256,
    stride: int | None = None,
    by: Sequence[str] = ("band",),
) -> DataFrame:
    """Average the overlapping windows back into images; cells under no window become 0.

    Null values (absent cells of a window) don't count.

    ``patches`` is patch_pixels-shaped: by, pi, pj, pr, pc, value. ``cells`` lists the
    wanted (by, row_, col_).
    """
    step = size // 2 if stride is None else stride
    stitched = patches.groupBy(
        *by,
        (F.col("pi") * step + F.col("pr")).alias("row_"),
        (F.col("pj") * step + F.col("pc")).alias("col_"),
    ).agg(F.avg("value").alias("value"))
    keys = [*by, "row_", "col_"]
    return cells.join(stitched, keys, "left").select(
        *keys, F.coalesce("value", F.lit(0.0)).alias("value")
    )


def unpack_patches(packed: DataFrame, size: int, by: Sequence[str] = ("band",)) -> DataFrame:
    """Window arrays back to one row per pixel."""
    return packed.select(*by, "pi", "pj", F.posexplode("patch").alias("_i", "value")).select(
        *by,
        "pi",
        "pj",
        F.floor(F.col("_i") / size).cast("int").alias("pr"),
        (F.col("_i") % size).alias("pc"),
        "value",
    )


def mean_abs_diff(p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """The simplest scorer: a constant map of the mean absolute difference."""
    return np.full(p1.shape, np.mean(np.abs(p2 - p1)))


def _resize(score: np.ndarray, size: int) -> np.ndarray:
    """Bilinear resize of a scorer's output to the patch size."""
    if score.shape == (size, size):
        return score

    def taps(n: int):
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    r0, r1, fr = taps(score.shape[0])
    c0, c1, fc = taps(score.shape[1])
    rows = score[r0] * (1 - fr)[:, None] + score[r1] * fr[:, None]
    return rows[:, c0] * (1 - fc) + rows[:, c1] * fc


def score_patches(
    pairs: DataFrame,
    grid: Grid,
    scorer: Callable[[np.ndarray, np.ndarray], np.ndarray] = mean_abs_diff,
    size: int = 256,
    stride: int | None = None,
    by: Sequence[str] = ("band",),
) -> DataFrame:
    """Run ``scorer(p1, p2) -> map`` on every pair of windows and stitch the maps.

    ``pairs`` has v1, v2 per cell; cells that are absent or null are 0 in both windows, so they
    are no change, and absent cells get no score. A group for the scorer is one window, or
    several small ones of an image up to ``GROUP_PIXELS``; the scored maps are averaged where
    windows overlap and scaled to [0, 1] per image.
    """
    by = list(by)
    step = size // 2 if stride is None else stride
    across = max((grid.width - size) // step + 1, 1)
    per_group = max(1, GROUP_PIXELS // (size * size))
    cut = patch_pixels(pairs.select(*by, "row_", "col_", "v1", "v2"), grid, size, step).select(
        *by,
        F.floor((F.col("pi") * across + F.col("pj")) / per_group).alias("_group"),
        "pi",
        "pj",
        "pr",
        "pc",
        "v1",
        "v2",
    )
    schema = cut.select(*by, "pi", "pj", "pr", "pc").schema.add("value", "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pi", "pj", "pr", "pc"], ignore_index=True)
        window = (pdf["pi"] * across + pdf["pj"]).to_numpy()
        _, window = np.unique(window, return_inverse=True)
        place = (window, pdf["pr"].to_numpy(), pdf["pc"].to_numpy())
        both = pdf[["v1", "v2"]].to_numpy(dtype=float)
        both = np.where(np.isnan(both).any(axis=1, keepdims=True), 0.0, both)
        stack = np.zeros((2, window.max() + 1, size, size))
        stack[0][place], stack[1][place] = both[:, 0], both[:, 1]
        maps = [_resize(np.asarray(scorer(a, b), dtype=float), size) for a, b in zip(*stack)]
        return pdf[[*by, "pi", "pj", "pr", "pc"]].assign(value=np.stack(maps)[place])

    groups = [*by, "_group"]
    scored = spread(cut, groups).groupBy(*groups).applyInPandas(run, schema)
    stitched = reconstruct(scored, pairs.select(*by, "row_", "col_"), size, step, by)
    return minmax01(materialize(stitched), "value", by)
