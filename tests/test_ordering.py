from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from urbanchange.functions.ordering import (
    average_ranks,
    exact_quantiles,
    grouped_quantiles,
    numbered_by_hash,
    running_counts,
    sort_key,
    with_percentile_ranks,
)
from urbanchange.functions.skew import join_stats, salted_join


def frame(seed=0, n=4000):
    rng = np.random.default_rng(seed)
    v = np.concatenate(
        [
            rng.normal(0, 1, n // 4),
            np.round(rng.normal(0, 3, n // 4)),
            np.full(n // 3, 7.25),
            [1e300, -1e300, 0.0, -0.0, 1e-300, np.nan],
            rng.uniform(1e6, 1e6 + 1, n // 8),
        ]
    )
    g = np.where(rng.uniform(size=len(v)) < 0.6, 0, rng.integers(1, 5, len(v)))
    return pd.DataFrame({"g": g, "v": v})


def test_sort_key_orders_like_doubles(spark):
    values = [-1e300, -2.5, -1e-300, 0.0, 1e-300, 2.5, 1e300, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", sort_key(F.col("v")).alias("k")
    )
    assert [r["v"] for r in rows.orderBy("k").collect()] == values
    zero = spark.createDataFrame([(-0.0,), (0.0,)], "v double").select(sort_key(F.col("v")))
    assert zero.distinct().count() == 1


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_exact_quantiles_in_passes(spark, groups):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q1": 1.0}
    got = exact_quantiles(df, "v", probs, groups, small_rows=0).toPandas()
    clean = pdf.dropna()
    if groups:
        got = got.set_index("g").sort_index()
        for name, p in probs.items():
            want = clean.groupby("g").v.quantile(p)
            assert np.allclose(got[name], want, rtol=1e-12)
    else:
        for name, p in probs.items():
            assert np.isclose(got[name][0], clean.v.quantile(p), rtol=1e-12)


def test_exact_quantiles_shuffled_route(spark, monkeypatch):
    from urbanchange.functions import ordering

    monkeypatch.setattr(ordering, "small_side", lambda df, max_rows=0: None)
    pdf = frame(1)
    got = exact_quantiles(spark.createDataFrame(pdf), "v", {"q": 0.5}, ["g"], small_rows=0)
    want = pdf.dropna().groupby("g").v.quantile(0.5)
    assert np.allclose(got.toPandas().set_index("g").sort_index().q, want)


@pytest.mark.parametrize("hot_rows", [10**6, 500, 0])
def test_grouped_quantiles_hot_groups(spark, hot_rows):
    pdf = frame(2)
    pdf.loc[len(pdf)] = [99, np.nan]
    got = grouped_quantiles(spark.createDataFrame(pdf), ["g"], "v", {"q": 0.5}, hot_rows)
    got = got.toPandas().set_index("g").sort_index().q
    want = pdf.groupby("g").v.quantile(0.5)
    assert np.allclose(got, want, equal_nan=True)
    assert np.isnan(got[99])


@pytest.mark.parametrize("hot_rows", [10**6, 50])
def test_percentile_ranks_like_mean_ranks(spark, hot_rows):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame(
        {
            "code": [f"A{i}" for i in range(n)],
            "a": np.where(rng.uniform(size=n) < 0.4, 5.0, rng.normal(size=n).round(1)),
            "b": np.where(rng.uniform(size=n) < 0.3, np.nan, rng.normal(size=n)),
        }
    )
    pdf.loc[0, ["a", "b"]] = np.nan
    pdf = pd.concat([pdf, pdf.iloc[[5, 5, 0]]], ignore_index=True)  # identical rows stay
    df = spark.createDataFrame(pdf)
    got = with_percentile_ranks(df, ["a", "b"], hot_rows).toPandas()
    want = pdf.assign(**{c: pdf[c].rank(pct=True) * 100 for c in ("a", "b")})
    keys = ["code", "a", "b"]
    got, want = (d.sort_values(keys, ignore_index=True) for d in (got, want))
    assert len(got) == len(want)
    assert np.allclose(got[["a", "b"]].astype(float), want[["a", "b"]], equal_nan=True)


@pytest.mark.parametrize("hot_rows", [10**6, 50])
def test_percentile_ranks_by_key(spark, hot_rows):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"code": [f"A{i}" for i in range(400)], "a": rng.integers(0, 9, 400) * 1.0, "b": rng.normal(size=400)})
    pdf.loc[:3, "a"] = np.nan
    pdf.loc[0, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    got, want = (
        with_percentile_ranks(df, ["a", "b"], hot_rows, key).toPandas().sort_values("code", ignore_index=True)
        for key in ("code", None)
    )
    assert list(got.columns) == list(pdf.columns)
    assert np.allclose(got[["a", "b"]].astype(float), want[["a", "b"]].astype(float), equal_nan=True)


def test_average_ranks(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (9.0,)], "v double")
    got = {r["v"]: r["rank"] for r in average_ranks(df, [], "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 9.0: 4.0}


def test_running_counts_of_whole_numbers(spark):
    big = 2**55
    df = spark.createDataFrame([(big + 1, 2), (big, 3), (5, 1)], "v long, n long")
    got = {r["v"]: (r["before"], r["total"]) for r in running_counts(df, [], "v").collect()}
    assert got == {5: (0, 6), big: (1, 6), big + 1: (4, 6)}


def test_numbered_by_hash(spark):
    df = spark.range(500).withColumn("l", F.col("id") % 3).withColumn(
        "h", F.md5(F.col("id").cast("string"))
    )
    got = numbered_by_hash(df, ["l"], "h", ["id"], "rn").toPandas()
    for _, part in got.groupby("l"):
        order = sorted(part.id, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert list(part.sort_values("rn").id) == order


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    left = spark.range(2000).select(
        F.when(F.col("id") < 900, 1).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    right = right.unionByName(right.where("k = 1"))
    want = left.join(right, "k", how)
    got = salted_join(left, right, ["k"], how, hot_rows=100, buckets=64)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) or how == "left"
    if how == "left":
        key = lambda r: tuple(-1 if v is None else v for v in r)
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_hot_keys(spark, monkeypatch):
    from urbanchange.functions import skew

    df = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"))
    hot, few = skew.hot_keys(df, ["k"], 1000)
    assert few and [r[0] for r in hot.collect()] == [7]
    assert skew.hot_keys(df, ["k"], 4000) == (None, True)
    block = [F.shiftright("k", 10)]
    hot, few = skew.hot_keys(df, ["k"], 500, coarse=block)
    assert few and [r[0] for r in hot.collect()] == [7]
    monkeypatch.setattr(skew, "small_side", lambda d, max_rows=0: None)
    hot, few = skew.hot_keys(df, ["k"], 500)
    assert not few and [r[0] for r in hot.collect()] == [7]


def test_many_hot_groups_take_the_exact_route(spark, monkeypatch):
    from urbanchange.functions import ordering

    pdf = frame(4)
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(ordering, "hot_keys", lambda d, k, n, **_: (d.select(*k).distinct(), False))
    got = grouped_quantiles(df, ["g"], "v", {"q": 0.5}, 10, extra=[F.count("v").alias("n")])
    got = got.toPandas().set_index("g").sort_index()
    assert np.allclose(got.q, pdf.groupby("g").v.quantile(0.5))
    assert (got.n == pdf.groupby("g").v.size()).all()


def test_join_stats_without_rows_keeps_left(spark):
    left = spark.range(3)
    nothing = spark.createDataFrame([], "q double")
    assert join_stats(left, nothing, []).count() == 3
