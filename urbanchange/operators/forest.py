"""Balanced random forests, all models and trees grown together, level by level.

Predictors are cut once into at most 256 bins. Every tree draws its own rows: a Poisson count per
(tree, row) from a hash, with a mean that brings each class to the size of the smaller one. A
level is grown from sums of weights per (tree, node, predictor, bin, class); a node tries the
first few of its predictors in a hashed order that are not constant in it, and is split until it
is pure or nothing tells its rows apart. There is no limit of depth.

Up to `WHOLE_BLOCKS` blocks of rows, a unit of work is a share of a model's trees with all rows: their
bins of the model's own predictors, a byte each. It grows a chunk of trees at a time to the end, lets
them vote, and sends one vote a row. Beyond, a unit is a block of rows with a chunk of trees, and every
level is one aggregation: the units send sums that exist, Spark adds them by (tree, node, predictor,
bin), and each node's split is chosen where its sums meet; the driver holds the splits. Both ways give
the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanchange.functions.skew import materialize
from urbanchange.operators.linear import Split, class_weights

BINS = 256
BLOCK_ROWS = 1 << 16  # rows of a block
WHOLE_BLOCKS = 8  # blocks whose rows a task may hold in the bins of one model
CHUNK = 1 << 19  # (tree, row) pairs of a chunk, about
UNITS = 512  # shares of trees, at most, unless there are more models


class Model(NamedTuple):
    """A forest to fit: the split that it learns from and the places of its predictors in ``x``."""

    split: Split
    columns: list[int]


class Level(NamedTuple):
    """Splits of the nodes of one depth; ``child`` is the left child's place in the next level,
    -1 at a leaf, and ``value`` the share of class 1."""

    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    value: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers: three rounds of multiply and shift."""
    x = np.asarray(x, np.uint64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def drawn(trees: np.ndarray, rows: np.ndarray, means: np.ndarray, seed: int) -> np.ndarray:
    """Poisson counts by (tree, row hash), with the mean of the row."""
    salt = mixed(trees.astype(np.uint64) * np.uint64(2) + np.uint64(2 * seed + 1))
    u = mixed(salt[:, None] ^ rows[None, :]) / 2.0**64
    counts, term = np.zeros(u.shape, np.int32), np.exp(-means)
    below = term.copy()
    top = u.max(initial=0.0)
    for k in range(1, 20):
        if (top < below).all():
            break
        counts += u >= below
        term = term * means / k
        below = below + term
    return counts


# -- one level ------------------------------------------------------------------------------


def cell_sums(node: np.ndarray, codes: np.ndarray, weight: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights, which are whole, per class of the (node, predictor, bin) that occur, keys ascending."""
    d = codes.shape[1]
    keys = ((node[:, None].astype(np.int64) * d + np.arange(d)[None, :]) * BINS + codes).ravel()
    if not len(keys):
        return keys, np.zeros((0, 2))
    span = int(keys.max()) + 1
    if span <= 2 * len(keys):  # full enough to be counted in place
        classes = np.repeat(label, d)
        sums = np.bincount(2 * keys + classes, np.repeat(weight, d), 2 * span).reshape(span, 2)
        found = np.flatnonzero(sums[:, 0] + sums[:, 1])
        return found, sums[found]
    # else key, weight and label are sorted as one number, which is far cheaper than an order
    low = 2 * weight.astype(np.int64) + label
    bits = int(low.max()).bit_length()
    packed = (keys << bits) | np.repeat(low, d)
    packed.sort()
    keys, low = packed >> bits, packed & ((1 << bits) - 1)
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ones = np.where(low & 1, low >> 1, 0)
    sums = np.add.reduceat(np.stack([(low >> 1) - ones, ones], axis=1), start, axis=0)
    return keys[start], sums.astype(float)


def best_splits(keys: np.ndarray, sums: np.ndarray, d: int, tried: int, uid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predictor and bin of the best split of every node (predictor -1: a leaf), and its value.

    ``keys`` are (node, predictor, bin) as one number and hold whole nodes, 0 to len(uid) - 1.
    """
    group = keys // BINS
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    run = np.cumsum(sums, axis=0)
    left = run - np.repeat(run[start] - sums[start], size, axis=0)
    total = np.add.reduceat(sums, start, axis=0)
    right = np.repeat(total, size, axis=0) - left
    n_left, n_right = left[:, 0] + left[:, 1], right[:, 0] + right[:, 1]  # two columns: sums over an axis are slow
    with np.errstate(all="ignore"):
        score = (left[:, 0] ** 2 + left[:, 1] ** 2) / n_left + (right[:, 0] ** 2 + right[:, 1] ** 2) / n_right
    score[start + size - 1] = -np.inf  # nothing lies right of the last bin
    top = np.maximum.reduceat(score, start)
    first = np.minimum.reduceat(np.where(score == np.repeat(top, size), np.arange(len(keys)), len(keys)), start)
    node, feature = group[start] // d, group[start] % d
    whole = np.zeros((len(uid), 2))
    whole[node] = total  # the same for every predictor of a node
    value = whole[:, 1] / np.maximum(whole[:, 0] + whole[:, 1], 1e-300)
    open_ = (size > 1) & (whole[node, 0] > 0) & (whole[node, 1] > 0)
    rank_key = mixed(uid[node] ^ mixed(feature + 1))
    order = np.lexsort((rank_key, node))
    order = order[open_[order]]
    ordered = node[order]
    begin = np.searchsorted(ordered, ordered, side="left")
    order = order[np.arange(len(order)) - begin < tried]
    best = np.lexsort((rank_key[order], -np.round(top[order], 9), node[order]))
    order = order[best]
    order = order[np.r_[True, node[order][1:] != node[order][:-1]]] if len(order) else order
    out_feature, out_bin = np.full(len(uid), -1), np.zeros(len(uid), int)
    out_feature[node[order]], out_bin[node[order]] = feature[order], keys[first[order]] % BINS
    return out_feature, out_bin, value


def as_level(feature: np.ndarray, bins: np.ndarray, value: np.ndarray, uid: np.ndarray) -> tuple[Level, np.ndarray]:
    """The level and the names of the nodes of the next one."""
    splits = feature >= 0
    child = np.where(splits, 2 * (np.cumsum(splits) - 1), -1)
    parents = np.repeat(uid[splits], 2)
    sides = np.tile(np.array([1, 2], np.uint64), int(splits.sum()))
    return Level(feature, bins, child, value), mixed(parents * np.uint64(3) + sides)


def moved(level: Level, node: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places in the next level of rows at ``node``, none of which is a leaf."""
    beyond = codes[np.arange(len(node)), level.feature[node]] > level.bin[node]
    return level.child[node] + beyond


def _routed(levels: Sequence[Level], tree: np.ndarray, row: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The (tree, row) pairs that have not met a leaf, with their nodes; and the values of leaves."""
    value, at, node = np.full(len(tree), np.nan), np.arange(len(tree)), tree.copy()
    for level in levels:
        leaf = level.child[node] < 0
        value[at[leaf]] = level.value[node[leaf]]
        at, node = at[~leaf], node[~leaf]
        node = moved(level, node, codes[row[at]])
    return at, node, value


def tree_names(model: int, trees: np.ndarray, seed: int) -> np.ndarray:
    return mixed(np.uint64((model << 32) + (seed << 20)) + trees.astype(np.uint64))


class Lines(NamedTuple):
    """Lines of bins as bytes one after another, and as columns of whole words, eight bins each."""

    d: int
    flat: np.ndarray
    words: list[np.ndarray]


def as_lines(codes: np.ndarray) -> Lines:
    n, d = codes.shape
    padded = np.zeros((n, -(-d // 8) * 8), np.uint8)
    padded[:, :d] = codes
    return Lines(d, np.ascontiguousarray(codes).ravel(), list(np.ascontiguousarray(padded.view(np.uint64).T)))


def to_try(lines: Lines, row: np.ndarray, start: np.ndarray, uid: np.ndarray, tried: int) -> tuple[np.ndarray, np.ndarray]:
    """The predictors that each node tries, a line per node, and whether they differ in it: those that
    do in a hashed order, then others. A node's rows lie together, from its ``start`` on."""
    changes = []
    for word in lines.words:
        here = word[row]
        here[1:] ^= here[:-1].copy()
        here[start] = 0
        changes.append(np.bitwise_or.reduceat(here, start))
    differs = np.stack(changes, axis=1).view(np.uint8)[:, : lines.d] != 0
    rank_key = mixed(uid[:, None] ^ mixed(np.arange(lines.d) + 1)[None, :])
    rank_key[~differs] = np.iinfo(np.uint64).max
    tries = np.argsort(rank_key, axis=1)[:, :tried]
    return tries, np.take_along_axis(differs, tries, axis=1)


def node_splits(
    lines: Lines, row: np.ndarray, low: np.ndarray, size: np.ndarray, total: np.ndarray, uid: np.ndarray, tried: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `best_splits` finds, and the sums left of it, where all rows of the nodes are at hand.

    The first ``size`` rows are those of the first node, and so on; ``low`` is twice the weight and
    the class of a row, ``total`` the sums of the nodes.
    """
    tries, differs = to_try(lines, row, np.cumsum(size) - size, uid, tried)
    bits = int(low.max()).bit_length()
    kind = np.uint32 if max((len(size) * BINS) << bits, int(total.sum())) < 1 << 32 else np.uint64
    at, low = row * lines.d, low.astype(kind)
    feature, bins = np.full(len(size), -1), np.zeros(len(size), int)
    left, best = np.zeros((len(size), 2)), np.full(len(size), -np.inf)
    for k in range(tries.shape[1]):
        # node, bin, weight and class of a row are sorted as one number; nodes with one bin have no split
        some = differs[:, k]
        if not some.any():
            continue
        held = np.where(some, size, 0)
        take = slice(None) if some.all() else np.flatnonzero(np.repeat(some, size))
        keys = np.repeat(np.arange(len(size), dtype=kind) * kind(BINS), held) + lines.flat[at[take] + np.repeat(tries[:, k], held)]
        keys = (keys << kind(bits)) | low[take]
        keys.sort()
        weight, cell = (keys & kind((1 << bits) - 1)) >> kind(1), keys >> kind(bits)
        sums, ones = np.cumsum(weight, dtype=kind), np.cumsum(weight * (keys & kind(1)), dtype=kind)
        step = cell[1:] ^ cell[:-1]
        cut = np.flatnonzero((step > 0) & (step < BINS))  # the next row is of the same node and another bin
        of = (cell[cut] // kind(BINS)).astype(np.int64)
        whole = np.where(some[:, None], total, 0)
        before = np.cumsum(whole, axis=0) - whole
        left1 = ones[cut] - before[of, 1]  # floats, of whole numbers
        left0 = sums[cut] - before[of, 0] - ones[cut]
        right0, right1 = total[of, 0] - left0, total[of, 1] - left1
        score = (left0**2 + left1**2) / (left0 + left1) + (right0**2 + right1**2) / (right0 + right1)
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        top = np.maximum.reduceat(score, start)
        first = np.flatnonzero(score == np.repeat(top, np.diff(np.r_[start, len(of)])))
        first = first[np.r_[True, of[first][1:] != of[first][:-1]]]
        top, mine = np.round(top, 9), of[start]
        better = top > best[mine]  # of equal ones the first tried
        first, mine = first[better], mine[better]
        best[mine], feature[mine], bins[mine] = top[better], tries[mine, k], cell[cut[first]] % kind(BINS)
        left[mine, 0], left[mine, 1] = left0[first], left1[first]
    return feature, bins, left


def grown(codes: np.ndarray, label: np.ndarray, weights: np.ndarray, names: np.ndarray, tried: int) -> list[Level]:
    """All trees of a chunk over all rows: a line of ``weights`` per tree, each with rows.

    Only rows of nodes with both classes are carried on.
    """
    lines, (tree, row) = as_lines(codes), np.nonzero(weights)
    weight, uid, levels = weights[tree, row].astype(np.int64), names, []
    whole = np.bincount(2 * tree + label[row], weight, 2 * len(names)).reshape(-1, 2)
    low = 2 * weight + label[row]
    open_ = whole.all(axis=1)
    size, place = np.bincount(tree, minlength=len(names))[open_], np.flatnonzero(open_)  # of the nodes that have rows here
    row, low = row[open_[tree]], low[open_[tree]]
    while len(uid):
        feature, bins, left = np.full(len(uid), -1), np.zeros(len(uid), int), np.zeros((len(uid), 2))
        if len(place):
            feature[place], bins[place], left[place] = node_splits(lines, row, low, size, whole[place], uid[place], tried)
        value = whole[:, 1] / np.maximum(whole[:, 0] + whole[:, 1], 1e-300)
        level, uid = as_level(feature, bins, value, uid)
        levels.append(level)
        whole = np.stack([left, whole - left], axis=1)[feature >= 0].reshape(-1, 2)
        open_ = np.r_[whole.all(axis=1), False]
        child, start = level.child[place], np.cumsum(size) - size
        beyond = lines.flat[row * lines.d + np.repeat(feature[place], size)] > np.repeat(bins[place], size)
        right = np.add.reduceat(beyond, start, dtype=int) if len(start) else size
        rows, lows, sizes, places = [], [], [], []
        for side, count in enumerate((size - right, right)):  # left children, then right ones: the rows of each lie together
            on = (child >= 0) & open_[child + side]
            go = np.flatnonzero((beyond == side) & np.repeat(on, size))
            rows.append(row[go])
            lows.append(low[go])
            sizes.append(count[on])
            places.append(child[on] + side)
        row, low, size, place = map(np.concatenate, (rows, lows, sizes, places))
    return levels


# -- blocks ---------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, d: int) -> list[np.ndarray]:
    """Per predictor the upper ends of its bins, from quantiles; few values get a bin each."""
    shares = F.lit(np.arange(1, BINS) / BINS)  # one literal; an array of 255 would be in every plan for every predictor
    ends = [F.array_distinct(F.percentile_approx(F.col("x")[j], shares, F.lit(100_000))).alias(f"e{j}") for j in range(d)]
    edges = []
    for start in range(0, d, 64):
        row = rows.agg(*ends[start : start + 64]).first()
        edges += [np.sort(np.array(e or [], float)) for e in row]
    return edges


def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1).astype(np.uint8)


class Block(NamedTuple):
    key: pa.Array
    hashes: np.ndarray
    label: np.ndarray
    folds: np.ndarray
    codes: np.ndarray


def blocks(rows: DataFrame, edges: list[np.ndarray]) -> tuple[DataFrame, int]:
    """A row per block of up to about `BLOCK_ROWS` rows, with arrays; and how many there are."""
    count = max(1, -(-rows.count() // BLOCK_ROWS))
    h = F.xxhash64("key", F.lit(7))
    dealt = rows.select("key", "label", "x", "folds", h.alias("h")).repartition(count, "h").sortWithinPartitions("h")
    kind = T.StructType(
        [T.StructField("key", T.ArrayType(rows.schema["key"].dataType)),
         *T.StructType.fromDDL("h array<long>, label array<int>, folds array<int>, codes binary")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one block
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        codes = _codes(x, edges)
        whole = lambda c: pa.array([table.column(c).to_pylist()], kind_of[c])
        folds = pa.array([table.column("folds").combine_chunks().flatten().to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [whole("key"), whole("h"), whole("label"), folds, pa.array([codes.tobytes()], pa.binary())],
            ["key", "h", "label", "folds", "codes"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kind_of = {f.name: to_arrow_type(f.dataType) for f in kind}
    return materialize(dealt.mapInArrow(run, kind)), count


def _block(batch: pa.RecordBatch, i: int) -> Block:
    key, h, label, folds = (batch.column(c)[i].values for c in ("key", "h", "label", "folds"))
    n = len(label)
    codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(n, -1)
    return Block(key, h.to_numpy().astype(np.uint64), label.to_numpy(), folds.to_numpy().reshape(n, -1), codes)


class Plan(NamedTuple):
    """What every unit knows: models, class means of the draws, trees per model, settings."""

    models: list[Model]
    means: np.ndarray
    trees: int
    seed: int

    def tried(self, model: int) -> int:
        return max(1, int(len(self.models[model].columns) ** 0.5))

    def draws(self, hashes: np.ndarray, label: np.ndarray, out: np.ndarray, model: int, trees: np.ndarray) -> np.ndarray:
        """Draws of the training rows, 0 for those held out."""
        means = self.means[model][label] * ~out
        return drawn(tree_names(model, trees, self.seed), hashes, means, self.seed)

    def train(self, block: Block, model: int, trees: np.ndarray) -> np.ndarray:
        repeat, fold = self.models[model].split
        return self.draws(block.hashes, block.label, block.folds[:, repeat] == fold, model, trees)

    def held_out(self, block: Block, model: int) -> np.ndarray:
        repeat, fold = self.models[model].split
        return np.flatnonzero(block.folds[:, repeat] == fold)


def _votes(rows: np.ndarray, codes: np.ndarray, levels: Sequence[Level], trees: int) -> np.ndarray:
    """Sum over the trees of the leaf values of ``rows``."""
    tree, at = np.repeat(np.arange(trees), len(rows)), np.tile(np.arange(len(rows)), trees)
    value = _routed(levels, tree, rows[at], codes)[2]
    return np.bincount(at, value, len(rows))


def _units(table: DataFrame, plan: Plan, rows: int) -> DataFrame:
    """The blocks in the bins of each model, once for each chunk of its trees: ``model``, ``first``, ``last``.

    Copies are made one at a time; a join would hold all copies of a block at once.
    """
    step = max(1, min(plan.trees, CHUNK // max(min(rows, BLOCK_ROWS), 1)))
    chunks = len(plan.models) * -(-plan.trees // step)
    kind = T.StructType([*table.schema, *T.StructType.fromDDL("model int, first int, last int")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                codes = np.frombuffer(one.column("codes")[0].as_py(), np.uint8).reshape(len(one.column("label")[0]), -1)
                for m, model in enumerate(plan.models):
                    own = {"codes": pa.array([codes[:, model.columns].tobytes()], pa.binary())}
                    for first in range(0, plan.trees, step):
                        places = {"model": m, "first": first, "last": min(first + step, plan.trees)}
                        own |= {name: pa.array([v], pa.int32()) for name, v in places.items()}
                        yield pa.RecordBatch.from_arrays([own[f] if f in own else one.column(f) for f in kind.names], kind.names)

    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    laid = table.mapInArrow(run, kind)
    return laid.repartition(min(n, max(1, chunks)), F.xxhash64("model", "first", F.element_at("h", 1)))


def _scores(plan: Plan, key_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("key", key_type), *T.StructType.fromDDL("model int, label int, votes double")])


def _scored(key: pa.Array, label: np.ndarray, model: int, votes: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(key), model, np.int32), label.astype(np.int32), votes]
    return pa.RecordBatch.from_arrays([key, *map(pa.array, columns)], ["key", "model", "label", "votes"])


def held_out_votes(rows: DataFrame, models: Sequence[Model], d: int, trees: int = 500, seed: int = 42) -> DataFrame:
    """Mean vote for class 1 of every row in each model that held it out.

    ``rows`` are those of `linear.fold_rows`. Columns: ``key``, ``model``, ``label``, ``score``.
    """
    weights = class_weights(rows, [m.split for m in models])
    # balanced weights are total / (2 n); a class drawn to the smaller one's size has mean least / n
    plan = Plan(list(models), weights / weights.max(axis=1, keepdims=True), trees, seed)
    edges, kind = bin_edges(rows, d), _scores(plan, rows.schema["key"].dataType)
    if rows.count() <= WHOLE_BLOCKS * BLOCK_ROWS:
        units, parts = _model_rows(rows, edges, plan)
        found = units.mapInArrow(_finish(plan, parts), kind)
    else:
        table = blocks(rows, edges)[0]
        levels = table.sparkSession.sparkContext.broadcast(_grow_by_levels(table, plan))
        found = _units(table, plan, BLOCK_ROWS).mapInArrow(_vote(plan, levels), kind)
    # the order of the sums is open: without rounding, like votes might not tie
    return found.groupBy("key", "model", "label").agg(F.round(F.sum("votes") / trees, 12).alias("score"))


class ForestModel(NamedTuple):
    """All trees of one forest and the bins that they were grown on."""

    edges: list[np.ndarray]
    levels: list[Level]
    trees: int

    def predict(self, df: DataFrame, predictors: Sequence[str]) -> DataFrame:
        """The rows with ``pred`` and the mean vote for class 1 as ``score`` and ``probability``."""
        names = ["pred", "score", "probability"]
        shared, own = df.sparkSession.sparkContext.broadcast(self), df.columns
        fed = df.withColumn("_x", F.array(*[F.col(c).cast("double") for c in predictors]))
        kind = T.StructType([*df.schema, *T.StructType.fromDDL("pred int, score double, probability double")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, levels, trees = shared.value
            for batch in batches:
                n = batch.num_rows
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                # rows with like bins get like votes
                codes, where = np.unique(_codes(x, edges), axis=0, return_inverse=True)
                n = len(codes)
                votes = np.zeros(n)
                step = max(1, CHUNK // max(n, 1))
                for a in range(0, trees, step):
                    tree = np.repeat(np.arange(a, min(a + step, trees)), n)
                    at = np.tile(np.arange(n), len(tree) // max(n, 1))
                    if n:
                        votes += np.bincount(at, _routed(levels, tree, at, codes)[2], n)
                score = votes[where.ravel()] / trees
                made = [pa.array((score > 0.5).astype(np.int32)), pa.array(score), pa.array(score)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *made], [*own, *names])

        return fed.mapInArrow(run, kind)


def fit(rows: DataFrame, d: int, trees: int = 500, seed: int = 42) -> ForestModel:
    """A forest on all rows of `linear.fold_rows`."""
    split = Split(0, -1)
    weights = class_weights(rows, [split])
    plan = Plan([Model(split, list(range(d)))], weights / weights.max(axis=1, keepdims=True), trees, seed)
    edges = bin_edges(rows, d)
    table = blocks(rows, edges)[0]
    kinds = distinct_codes(table, d)
    levels = _grow_by_levels(table, plan) if kinds is None else _grow_by_kinds(table, plan, kinds)
    return ForestModel(edges, levels, trees)


def distinct_codes(table: DataFrame, d: int) -> np.ndarray | None:
    """The different lines of bins in order, or None if they are more than a block's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lines = np.unique(np.frombuffer(batch.column("codes")[i].as_py(), f"V{d}"))
                yield pa.RecordBatch.from_arrays([pa.array(lines.tolist(), pa.binary())], ["line"])

    found = table.mapInArrow(run, "line binary").distinct().limit(BLOCK_ROWS + 1).toArrow()["line"].to_pylist()
    if len(found) > BLOCK_ROWS:
        return None
    return np.frombuffer(b"".join(sorted(found)), np.uint8).reshape(-1, d)


def joined(chunks: Sequence[Sequence[Level]]) -> list[Level]:
    """Levels of one forest from those of chunks of its trees, in their order."""
    levels = []
    for k in range(max(map(len, chunks), default=0)):
        here = [c[k] for c in chunks if len(c) > k]
        after = [len(c[k + 1].feature) if len(c) > k + 1 else 0 for c in chunks if len(c) > k]
        first = np.cumsum([0, *after[:-1]])
        child = [np.where(v.child < 0, -1, v.child + f) for v, f in zip(here, first)]
        levels.append(Level(*map(np.concatenate, ([v.feature for v in here], [v.bin for v in here], child, [v.value for v in here]))))
    return levels


def _grow_by_kinds(table: DataFrame, plan: Plan, kinds: np.ndarray) -> list[Level]:
    """All trees of the one model from draws summed per (tree, line of bins, class), in one pass.

    Rows with like bins go the same way in every tree, so a tree is grown from their sums.
    """
    spark, d = table.sparkSession, kinds.shape[1]
    shared = spark.sparkContext.broadcast(kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = [k.tobytes() for k in shared.value]
        place = {k: i for i, k in enumerate(lines)}
        for block, model, trees in _each(batches):
            some, where = np.unique(np.ascontiguousarray(block.codes).view(f"V{d}").ravel(), return_inverse=True)
            kind = np.array([place[k.tobytes()] for k in some])
            draws = plan.train(block, model, trees)
            cell = 2 * where + block.label
            sums = np.stack([np.bincount(cell, w, 2 * len(some)) for w in draws]).reshape(len(trees), -1, 2)
            tree, at = np.nonzero(sums.any(axis=2))
            columns = [trees[tree].astype(np.int32), kind[at].astype(np.int32), sums[tree, at, 0], sums[tree, at, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "kind", "w0", "w1"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # whole trees, each at most two rows a line of bins
        if not held:
            return
        part = pa.Table.from_batches(held)
        tree, kind, *sums = (part.column(c).to_numpy() for c in ("tree", "kind", "w0", "w1"))
        for each in np.unique(tree):
            mine = np.flatnonzero(tree == each)
            codes = np.repeat(shared.value[kind[mine]], 2, axis=0)
            weights = np.stack([w[mine] for w in sums], axis=1).reshape(1, -1)
            label = np.tile(np.array([0, 1]), len(mine))
            own = tree_names(0, np.array([each]), plan.seed)
            for depth, level in enumerate(grown(codes, label, weights, own, plan.tried(0))):
                n = len(level.feature)
                columns = [np.full(n, each), np.full(n, depth), np.arange(n), level.feature, level.bin, level.child]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c.astype(np.int32)) for c in columns), pa.array(level.value)],
                    ["tree", "depth", "node", "feature", "bin", "child", "value"],
                )

    sums = _units(table, plan, BLOCK_ROWS).mapInArrow(count, "tree int, kind int, w0 double, w1 double")
    sums = sums.groupBy("tree", "kind").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    sums = sums.repartition(plan.trees, "tree")
    kind = "tree int, depth int, node int, feature int, bin int, child int, value double"
    got = sums.mapInArrow(grow, kind).toArrow().sort_by([(c, "ascending") for c in ("tree", "depth", "node")])
    shared.unpersist()
    tree, depth, feature, bins, child, value = (got.column(c).to_numpy() for c in ("tree", "depth", "feature", "bin", "child", "value"))
    chunks = []
    for each in range(plan.trees):
        lo, hi = np.searchsorted(tree, [each, each + 1])
        cuts = np.searchsorted(depth[lo:hi], np.arange(1, depth[lo:hi].max() + 1)) if hi > lo else []
        parts = [np.split(c[lo:hi], cuts) for c in (feature, bins, child, value)]
        empty = [Level(np.array([-1]), np.array([0]), np.array([-1]), np.array([0.0]))]  # a tree without rows
        chunks.append([Level(*p) for p in zip(*parts)] if hi > lo else empty)
    return joined(chunks)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, int, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = _block(batch, i)
            model, first, last = (batch.column(c)[i].as_py() for c in ("model", "first", "last"))
            yield block, model, np.arange(first, last)


def _model_rows(rows: DataFrame, edges: list[np.ndarray], plan: Plan) -> tuple[DataFrame, int]:
    """All rows for every share of a model's trees, a task for each; and the shares of a model.

    A row goes as its hash, a byte of class and fold, and a byte for each predictor of the model, so a
    task holds some 20 bytes a row. The number of shares does not depend on the rows.
    """
    at_once = min(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), UNITS)
    parts = min(plan.trees, max(1, -(-at_once // len(plan.models))))
    kind = T.StructType(
        [T.StructField("unit", T.IntegerType()), T.StructField("key", T.ArrayType(rows.schema["key"].dataType)),
         *T.StructType.fromDDL("h binary, marks binary, codes binary")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, folds = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("x", "folds"))
            codes, h = _codes(x, edges), batch.column("h").to_numpy().tobytes()
            label = batch.column("label").to_numpy()
            for m, (split, columns) in enumerate(plan.models):
                held = folds[:, split.repeat] == split.fold
                keys = batch.column("key").take(pa.array(np.flatnonzero(held)))
                keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                packed = [h, (label + 2 * held).astype(np.uint8).tobytes(), codes[:, columns].tobytes()]
                for unit in range(m * parts, (m + 1) * parts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([unit], pa.int32()), keys, *(pa.array([b], pa.binary()) for b in packed)], kind.names
                    )

    hashed = rows.select("key", "label", "x", "folds", F.xxhash64("key", F.lit(7)).alias("h"))
    units = len(plan.models) * parts
    return hashed.mapInArrow(run, kind).repartitionById(units, "unit"), parts


def _finish(plan: Plan, parts: int):
    """Grow a model's share of trees over all rows, a chunk at a time, and let them vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # the rows of one unit
        if not held:
            return
        table = pa.Table.from_batches(held)
        model, part = divmod(table.column("unit")[0].as_py(), parts)
        h, marks, codes = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("h", np.uint64), ("marks", np.uint8), ("codes", np.uint8))
        )
        label, out, codes = (marks & 1).astype(int), marks > 1, codes.reshape(len(h), -1)
        rows, votes = np.flatnonzero(out), np.zeros(int(out.sum()))
        if not len(rows):
            return
        step = max(1, CHUNK // len(h))
        first, last = (plan.trees * k // parts for k in (part, part + 1))
        for a in range(first, last, step):
            trees = np.arange(a, min(a + step, last))
            draws = plan.draws(h, label, out, model, trees)
            some = draws.any(axis=1)  # a tree without rows has no vote but the root's, none
            if some.any():
                levels = grown(codes, label, draws[some], tree_names(model, trees[some], plan.seed), plan.tried(model))
                votes += _votes(rows, codes, levels, int(some.sum()))
        yield _scored(table.column("key").combine_chunks().flatten(), label[rows], model, votes)

    return run


def _vote(plan: Plan, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, model, trees in _each(batches):
            rows = plan.held_out(block, model)
            if len(rows):
                # the roots of all models lie one after another
                tree = np.repeat(model * plan.trees + trees, len(rows))
                at = np.tile(np.arange(len(rows)), len(trees))
                value = _routed(shared.value, tree, rows[at], block.codes)[2]
                yield _scored(block.key.take(pa.array(rows)), block.label[rows], model, np.bincount(at, value, len(rows)))

    return run


def _grow_by_levels(table: DataFrame, plan: Plan) -> list[Level]:
    """All trees of all models, one aggregation per level."""
    spark, parts = table.sparkSession, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    uid = np.concatenate([tree_names(m, np.arange(plan.trees), plan.seed) for m in range(len(plan.models))])
    owner = np.repeat(np.arange(len(plan.models)), plan.trees)  # the model of a node
    levels: list[Level] = []
    while len(uid):
        shared = spark.sparkContext.broadcast((levels, uid, owner))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, model, trees in _each(batches):
                draws = plan.train(block, model, trees)
                tree, row = np.nonzero(draws)
                at, node, _ = _routed(shared.value[0], model * plan.trees + trees[tree], row, block.codes)
                if not len(at):
                    continue
                keys, sums = cell_sums(node, block.codes[row[at]], draws[tree[at], row[at]], block.label[row[at]])
                cells = block.codes.shape[1] * BINS
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a) for a in (keys // cells, (keys % cells).astype(np.int32), sums[:, 0], sums[:, 1])],
                    ["node", "cell", "w0", "w1"],
                )

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = None
            for batch in batches:
                part = np.stack([batch.column(c).to_numpy() for c in ("node", "cell", "w0", "w1")], axis=1)
                part = part if kept is None else np.concatenate([kept, part])
                whole = part[:, 0] != part[-1, 0]  # the last node may go on in the next batch
                kept = part[~whole]
                if whole.any():
                    yield from chosen(part[whole])
            if kept is not None and len(kept):
                yield from chosen(kept)

        def chosen(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, names, owners = shared.value
            models = owners[part[:, 0].astype(np.int64)]
            for model in np.unique(models):
                mine = part[models == model]
                nodes, place = np.unique(mine[:, 0].astype(np.int64), return_inverse=True)
                d = len(plan.models[model].columns)
                keys = place * (d * BINS) + mine[:, 1].astype(np.int64)
                feature, bins, value = best_splits(keys, mine[:, 2:], d, plan.tried(model), names[nodes])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.array(feature.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(value)],
                    ["node", "feature", "bin", "value"],
                )

        cells = _units(table, plan, BLOCK_ROWS).mapInArrow(count, "node long, cell int, w0 double, w1 double")
        sums = cells.groupBy("node", "cell").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
        sums = sums.repartition(parts, "node").sortWithinPartitions("node", "cell")
        got = sums.mapInArrow(choose, "node long, feature int, bin int, value double").toArrow()
        at = got.column("node").to_numpy()
        feature, bins, value = np.full(len(uid), -1), np.zeros(len(uid), int), np.zeros(len(uid))
        for a, c in ((feature, "feature"), (bins, "bin"), (value, "value")):
            a[at] = got.column(c).to_numpy()
        level, uid = as_level(feature, bins, value, uid)
        owner = np.repeat(owner[feature >= 0], 2)
        levels.append(level)
        shared.unpersist()
    return levels
