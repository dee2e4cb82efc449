"""Weak labels: EM, held-out accuracy, edges."""

from __future__ import annotations

import numpy as np

from urbanchange.llm import quality, queries

SF_DIR = "/root/testdata/sf0.01"


def test_em_recovers_labellers():
    rng = np.random.default_rng(7)
    truth = rng.random(20_000) < 0.2
    right = np.array([0.95, 0.9, 0.8, 0.85])
    votes = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((20_000, 4)) < 0.3] = quality.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    yes, rate = quality.posteriors(patterns, counts.astype(float))
    assert np.allclose(rate[1], right, atol=0.03) and np.allclose(rate[0], 1 - right, atol=0.03)
    at = {tuple(p): y for p, y in zip(patterns.tolist(), yes)}
    assert np.mean([(at[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth)]) > 0.9


def test_held_out_accuracy(spark):
    """Labels of even ids are one of the labellers; odd ids tell how good the verdicts are."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    out = {r.doc_id: r for r in quality.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    assert len(out) == docs.count()
    odd = labels.where("doc_id % 2 = 1").distinct().collect()
    good = [out[r.doc_id].kept for r in odd if r.quality == 1 and r.toxic == 0]
    junk = [out[r.doc_id].kept for r in odd if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(junk) < 0.1


def test_without_labels(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").distinct().collect()
    out = {r.doc_id: r.kept for r in quality.classify(docs).collect()}
    assert np.mean([out[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 0]) > 0.97
    assert np.mean([out[r.doc_id] for r in labels if r.quality == 0]) < 0.25


def test_edges(spark):
    prose = "the quiet river runs to the sea and the town is near it with a bridge of stone number "
    rows = [(i, prose + str(i), 0.5) for i in range(40)]
    rows += [(100 + i, "SHOUT!! BUY!! NOW!! " * 12 + str(i), 0.5) for i in range(10)]
    rows += [(200 + i, "you are an idiot and a worthless moron of the worst kind " + str(i), 0.5) for i in range(10)]
    rows += [(1, prose + "1", 0.5), (None, prose, 0.5), (300, None, 0.5), (301, "", 0.5), (302, prose * 20_000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, junk_score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (100, 0, None), (None, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (None, labels.limit(0)):
        got = quality.classify(docs, given).collect()
        kept = {r.doc_id for r in got if r.kept}
        assert len(got) == len(rows)
        assert {*range(40), 301, None} <= kept and not kept & {*range(100, 110), *range(200, 210)}
    assert quality.classify(docs, labels).count() == len(rows)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r.junk_score for r in good.collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_query_keeps_every_row(spark):
    out = queries.op9_weak_quality(spark, "/root/testdata/sf0.001")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
