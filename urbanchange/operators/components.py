"""Connected components of binary maps: tiles first, then the graph between tiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanchange.functions.ordering import running_counts
from urbanchange.functions.skew import materialize, salted_join, spread

TILE = 512
WIDTH_BITS = 31  # a cell's id is row * 2**31 + column: row-major, for any image size


def cell_id():
    return F.shiftleft(F.col("row_").cast("long"), WIDTH_BITS) + F.col("col_")


def _label_tiles(
    cells: np.ndarray, rows: np.ndarray, cols: np.ndarray, tile: int, full: bool
) -> np.ndarray:
    """Smallest cell id of each cell's component inside its tile, for any number of tiles."""
    order = np.argsort(cells)
    ids, r, c = cells[order], rows[order], cols[order]
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if full else [])
    a, b = [], []
    for dr, dc in steps:
        there = ((r + dr) << WIDTH_BITS) + (c + dc)
        spot = np.minimum(np.searchsorted(ids, there), len(ids) - 1)
        same = ((r + dr) // tile == r // tile) & ((c + dc) // tile == c // tile)
        hit = (ids[spot] == there) & same
        a.append(np.nonzero(hit)[0])
        b.append(spot[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(ids))
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    out = np.empty_like(ids)
    out[order] = ids[root]
    return out


def _local(ones: DataFrame, by: list[str], tile: int, full: bool) -> DataFrame:
    """Tile-local labels. Small tiles share a Python call, in blocks of up to ``TILE`` squared pixels."""
    block = tile * max(1, TILE // tile)
    schema = ones.select(*by, "row_", "col_").schema.add("local", "long")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row_"].to_numpy(np.int64), pdf["col_"].to_numpy(np.int64)
        found = _label_tiles((r << WIDTH_BITS) + c, r, c, tile, full)
        return pdf[[*by, "row_", "col_"]].assign(local=found)

    tiled = ones.select(*by, "row_", "col_").withColumns(
        {
            "_tr": F.floor(F.col("row_") / block).cast("int"),
            "_tc": F.floor(F.col("col_") / block).cast("int"),
        }
    )
    groups = [*by, "_tr", "_tc"]
    return spread(tiled, groups).groupBy(*groups).applyInPandas(label, schema)


def _links(local: DataFrame, by: list[str], tile: int, full: bool) -> DataFrame:
    """Pairs of local components that touch across a tile border."""
    last, first = tile - 1, 0
    r, c = F.pmod("row_", F.lit(tile)), F.pmod("col_", F.lit(tile))
    rim = local.where((r == last) | (r == first) | (c == last) | (c == first))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if full else [])
    moved = rim.select(
        *by,
        F.col("local").alias("a"),
        F.col("row_").alias("_r"),
        F.col("col_").alias("_c"),
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i, j in steps])
        ).alias("_d"),
    ).select(
        *by,
        "a",
        (F.col("_r") + F.col("_d.dr")).alias("row_"),
        (F.col("_c") + F.col("_d.dc")).alias("col_"),
    )
    met = moved.join(rim.withColumnRenamed("local", "b"), [*by, "row_", "col_"])
    return met.where("a <> b").select(*by, "a", "b").distinct()


def _merge(links: DataFrame, by: list[str], hot_rows: int) -> DataFrame:
    """Smallest id of each node's component, by min-propagation with pointer jumping.

    Every round lowers a node to the smallest root among its neighbours, lowers the node's
    old root likewise, and then jumps to the root's root, so chains shrink by half.
    """
    both = links.unionByName(links.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct())
    crowded = both.count() > hot_rows  # otherwise no key can be hot

    def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        if crowded:
            return salted_join(left, right, [*by, key], hot_rows=hot_rows)
        return left.join(right, [*by, key])

    roots = both.groupBy(*by, "a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
    roots = materialize(roots)
    while True:
        near = (
            lookup(both, roots.select(*by, F.col("a").alias("b"), "root"), "b")
            .groupBy(*by, "a")
            .agg(F.min("root").alias("_near"))
        )
        seen = roots.join(near, [*by, "a"]).select(
            *by, "a", "root", F.least("root", "_near").alias("_low")
        )
        pushed = seen.select(
            *by,
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("_low"), F.col("root").alias("old")),
                    F.struct(
                        F.col("root").alias("a"), F.col("_low"), F.lit(None).cast("long").alias("old")
                    ),
                )
            ).alias("_e"),
        ).select(*by, "_e.*")
        lowered = materialize(
            pushed.groupBy(*by, "a").agg(F.min("_low").alias("next"), F.max("old").alias("old"))
        )
        jumps = lowered.select(*by, F.col("a").alias("next"), F.col("next").alias("_to"))
        new = materialize(
            lookup(lowered, jumps, "next").select(
                *by, "a", F.least("next", "_to").alias("root"), "old"
            )
        )
        settled = new.where("root <> old").isEmpty()
        roots = new.drop("old")
        if settled:
            return roots


def label_components(
    df: DataFrame,
    by: Sequence[str] = ("band",),
    *,
    full: bool,
    tile: int = TILE,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Component root (its first cell in row-major order) and size of every changed pixel.

    A tile holds at most ``tile`` squared pixels and is labelled in memory, small ones with
    their neighbours in one call. Only tile-border
    contacts enter the graph between tiles, and a pixel joins its component through its
    tile-local label, so a component that covers most of the map is no hot key.
    """
    by = list(by)
    ones = df.where(F.col("changed") > 0)
    local = materialize(_local(ones, by, tile, full))
    counts = local.groupBy(*by, "local").agg(F.count(F.lit(1)).alias("_px"))
    links = materialize(_links(local, by, tile, full))
    if links.isEmpty():
        named = counts.select(*by, "local", F.col("local").alias("root"), F.col("_px").alias("size"))
    else:
        roots = _merge(links, by, hot_rows)
        joined = counts.join(roots.withColumnRenamed("a", "local"), [*by, "local"], "left").select(
            *by, "local", "_px", F.coalesce("root", "local").alias("root")
        )
        sizes = joined.groupBy(*by, "root").agg(F.sum("_px").alias("size"))
        named = salted_join(joined, sizes, [*by, "root"], hot_rows=hot_rows).select(
            *by, "local", "root", "size"
        )
    return local.join(named, [*by, "local"]).select(*by, "row_", "col_", "root", "size")


def _placed(keys: Sequence[str]) -> Column:
    """Changed, with a full key. All other pixels go past the labelling, without a join."""
    whole = [F.col(k).isNotNull() for k in keys]
    return reduce(Column.__and__, whole, F.coalesce(F.col("changed") > 0, F.lit(False)))


def remove_small(
    df: DataFrame, min_size: int, by: Sequence[str] = ("band",), tile: int = TILE
) -> DataFrame:
    """Clear changed pixels in 4-connected objects of fewer than ``min_size`` pixels."""
    keys = [*by, "row_", "col_"]
    base = materialize(df.select(*keys, "changed"))
    found = label_components(base.where(_placed(keys)), by, full=False, tile=tile)
    return (
        base.where(~_placed(keys))
        .select(*keys, F.lit(0).alias("changed"))
        .unionByName(found.select(*keys, (F.col("size") >= min_size).cast("int").alias("changed")))
    )


def segment(
    df: DataFrame, min_size: int = 10, by: Sequence[str] = ("band",), tile: int = TILE
) -> DataFrame:
    """8-connected component labels, numbered from 1 per map in row-major order.

    Objects below ``min_size`` are cleared after numbering, so numbers may have gaps.
    """
    by = list(by)
    keys = [*by, "row_", "col_"]
    base = materialize(df.select(*keys, "changed"))
    found = materialize(label_components(base.where(_placed(keys)), by, full=True, tile=tile))
    heads = (
        found.where(cell_id() == F.col("root"))
        .select(*by, F.col("root"), F.lit(1).cast("long").alias("n"))
    )
    numbers = running_counts(heads, by, "root").select(
        *by, "root", (F.col("before") + 1).alias("label")
    )
    labelled = salted_join(found.where(F.col("size") >= min_size), numbers, [*by, "root"])
    cleared = base.where(~_placed(keys)).select(*keys).unionByName(
        found.where(F.col("size") < min_size).select(*keys)
    )
    return cleared.select(*keys, F.lit(0).cast("long").alias("label")).unionByName(
        labelled.select(*keys, F.col("label").cast("long").alias("label"))
    )
