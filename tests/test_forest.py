"""Balanced forests: splits against a plain search, both ways of growing, accuracy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_linear import NAMES, table

from urbanchange.operators import forest, linear


def plain_split(codes, label, weight, features):
    """The best Gini split of one node over the given predictors."""
    best = None
    for f in features:
        for b in sorted(set(codes[:, f]))[:-1]:
            score = 0.0
            for side in (codes[:, f] <= b, codes[:, f] > b):
                w = [weight[side & (label == c)].sum() for c in (0, 1)]
                score += (w[0] ** 2 + w[1] ** 2) / sum(w)
            if best is None or score > best[0] + 1e-9:
                best = (score, f, b)
    return best


def test_splits():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 6, (80, 4)).astype(np.uint8)
    codes[:, 3] = 2
    label, weight, node = rng.integers(0, 2, 80), rng.integers(1, 4, 80).astype(float), rng.integers(0, 5, 80)
    keys, sums = forest.cell_sums(node, codes, weight, label)
    feature, bins, value = forest.best_splits(keys, sums, 4, 4, np.arange(5, dtype=np.uint64))
    for n in range(5):
        here = node == n
        best = plain_split(codes[here], label[here], weight[here], range(4))
        mine = plain_split(codes[here], label[here], weight[here], [feature[n]])
        assert mine[0] == pytest.approx(best[0]) and mine[2] == bins[n]
        assert value[n] == pytest.approx(weight[here & (label == 1)].sum() / weight[here].sum())
    # with one predictor to try it is the first in hashed order that is not constant
    one = forest.best_splits(keys, sums, 4, 1, np.arange(5, dtype=np.uint64))[0]
    assert set(one) <= {0, 1, 2} and len(set(one)) > 1


def test_draws():
    names = forest.tree_names(0, np.arange(400), 42)
    rows = forest.mixed(np.arange(500))
    counts = forest.drawn(names, rows, np.where(np.arange(500) < 100, 1.0, 0.25), 42)
    assert counts[:, :100].mean() == pytest.approx(1.0, abs=0.02) and counts[:, 100:].mean() == pytest.approx(0.25, abs=0.01)
    assert counts[:, :100].var() == pytest.approx(1.0, abs=0.04)


def test_pure_leaves():
    """Trees go on until their own rows are told apart."""
    rng = np.random.default_rng(1)
    codes, label = rng.integers(0, 200, (300, 3)).astype(np.uint8), rng.integers(0, 2, 300)
    weights = rng.poisson(1.0, (4, 300))
    levels = forest.grown(codes, label, weights, forest.tree_names(0, np.arange(4), 1), 1)
    for t in range(4):
        rows = np.flatnonzero(weights[t])
        value = forest._routed(levels, np.full(len(rows), t), rows, codes)[2]
        same = {}
        for r, v in zip(rows, value):
            same.setdefault(tuple(codes[r]), set()).add(label[r])
            assert len(same[tuple(codes[r])]) > 1 or v == label[r] or v not in (0.0, 1.0)
    assert len(levels) > 8


def test_both_ways_and_accuracy(spark, monkeypatch):
    pdf, df = table(spark)
    rows = linear.fold_rows(df, "id", NAMES, folds=3)
    models = [forest.Model(linear.Split(0, f), c) for f in range(3) for c in ([0, 1, 2], [0])]
    one = forest.held_out_votes(rows, models, 3, trees=12).toPandas().sort_values(["model", "key"])
    monkeypatch.setattr(forest, "BLOCK_ROWS", 90)
    many = forest.held_out_votes(rows, models, 3, trees=12).toPandas().sort_values(["model", "key"])
    assert len(one) == 800 and (one.score.between(0, 1)).all()
    np.testing.assert_allclose(one.score.to_numpy(), many.score.to_numpy(), atol=1e-9)
    whole = one[one.model % 2 == 0]
    hits = (whole.score > 0.5) == (whole.label == 1)
    recalls = [hits[whole.label == c].mean() for c in (0, 1)]
    assert np.mean(recalls) > 0.68 and min(recalls) > 0.6  # balanced


@pytest.mark.parametrize("heaviest", [3, 1 << 30])
def test_splits_of_rows_at_hand(heaviest):
    """Splits from sorted rows are those from sums of cells, and so are the sums left of them."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 5, (300, 11)).astype(np.uint8)
    codes[:, 4] = 1
    row, node = rng.integers(0, 300, 600), np.sort(np.r_[np.arange(40), rng.integers(0, 40, 560)])
    label, weight = rng.integers(0, 2, 300), rng.integers(1, heaviest, 600)
    codes[row[node == 7]] = codes[row[node == 7][0]]  # nothing tells these apart
    uid = forest.tree_names(0, np.arange(40), 5)
    keys, sums = forest.cell_sums(node, codes[row], weight, label[row])
    feature, bins, _ = forest.best_splits(keys, sums, 11, 3, uid)
    sides = np.zeros((2, 40, 2))
    np.add.at(sides, ((codes[row, feature[node]] > bins[node]).astype(int), node, label[row]), weight)
    mine = forest.node_splits(forest.as_lines(codes), row, 2 * weight + label[row], np.bincount(node), sides.sum(axis=0), uid, 3)
    np.testing.assert_array_equal(mine[0], feature)
    np.testing.assert_array_equal(mine[1], bins)
    np.testing.assert_array_equal(mine[2][feature >= 0], sides[0][feature >= 0])
    assert mine[0][7] == -1


def shuffled(spark):
    context = spark.sparkContext
    none = context._jvm.java.util.ArrayList()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(none, False, False, context._gateway.new_array(context._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_rows_are_sent_in_the_bins_of_a_model(spark, monkeypatch):
    """Rows go out once for each share of a model's trees, in its own bins, however small the chunks are."""
    n, d = 1500, 60
    df = spark.range(n).select("id", (F.xxhash64("id") % 2 == 0).cast("int").alias("label"), *[F.rand(j).alias(f"x{j}") for j in range(d)])
    rows = linear.fold_rows(df, "id", [f"x{j}" for j in range(d)], folds=3)
    models = [forest.Model(linear.Split(0, f), [j, j + 1]) for f in range(3) for j in range(0, d, 6)]
    monkeypatch.setattr(forest, "CHUNK", n)  # one tree
    before = shuffled(spark)
    some = forest.held_out_votes(rows, models, d, trees=16).toPandas().sort_values(["model", "key"])
    assert shuffled(spark) - before < 4_000_000  # 56 MB if every chunk is sent the whole block
    assert len(some) == n * len(models) // 3
    monkeypatch.setattr(forest, "UNITS", 120)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    more = forest.held_out_votes(rows, models, d, trees=16).toPandas().sort_values(["model", "key"])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    np.testing.assert_array_equal(some.score.to_numpy(), more.score.to_numpy())  # ties stay ties


def test_units_hold_the_bins_of_their_model(spark, monkeypatch):
    """Blocks go to chunks of trees in the bins of the chunk's model, every chunk once for each block."""
    pdf, df = table(spark)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 90)
    monkeypatch.setattr(forest, "CHUNK", 180)
    rows = linear.fold_rows(df, "id", NAMES, folds=3)
    plan = forest.Plan([forest.Model(linear.Split(0, 0), c) for c in ([0, 2], [1])], np.ones((2, 2)), 5, 42)
    laid, count = forest.blocks(rows, forest.bin_edges(rows, 3))
    units = forest._units(laid, plan, 90).selectExpr("model", "first", "last", "size(h) as n", "length(codes) as bins").toPandas()
    assert len(units) == count * 2 * 3 and sorted(set(zip(units["first"], units["last"]))) == [(0, 2), (2, 4), (4, 5)]
    assert (units.bins == units.n * np.where(units.model == 0, 2, 1)).all() and units.n.sum() == 400 * 6


def test_fit_and_predict(spark):
    """A forest on all rows tells most of its own rows apart, and judges new ones."""
    pdf, df = table(spark)
    made = forest.fit(linear.fold_rows(df, "id", NAMES), 3, trees=40)
    out = made.predict(df, NAMES).toPandas()
    assert list(out.columns) == ["id", "label", *NAMES, "pred", "score", "probability"]
    assert ((out.score > 0.5) == out.pred).all() and (out.pred == out.label)[out.label == 1].mean() > 0.95
    assert made.predict(df.limit(0), NAMES).count() == 0


def test_kinds_and_levels_give_the_same_trees(spark, monkeypatch):
    """Rows with like bins are summed once, over many blocks; the levels are those of a level at a time."""
    pdf, df = table(spark)
    few = df.select("id", "label", *[F.round(c, 1).alias(c) for c in NAMES])
    rows = linear.fold_rows(few, "id", NAMES)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 801)
    passes = []
    by_levels = forest._grow_by_levels
    monkeypatch.setattr(forest, "_grow_by_levels", lambda *a: passes.append(1) or by_levels(*a))
    one = forest.fit(rows, 3, trees=15)
    assert not passes  # no pass over the rows for each level
    monkeypatch.setattr(forest, "distinct_codes", lambda *a: None)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 90)
    many = forest.fit(rows, 3, trees=15)
    assert passes and len(one.levels) == len(many.levels)
    for a, b in zip(one.levels, many.levels):
        for x, y in zip(a, b):
            np.testing.assert_array_equal(x, y)
