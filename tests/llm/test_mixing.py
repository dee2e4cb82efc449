"""Pfair mixing: windows, deviation, and rows."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from urbanchange.llm import mixing, queries

SF_DIR = "/root/testdata/sf0.01"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.integers(1, 40), min_size=1, max_size=8))
def test_period_meets_every_window(weights):
    period, slots = sum(weights.values()), mixing.one_period(weights)
    assert sorted(slots.values()) == list(range(period))
    for (source, i), t in slots.items():
        w = weights[source]
        assert i * period // w <= t < -(-(i + 1) * period // w)


def test_default_weights():
    w = mixing.default_weights({"a": 10_000, "b": 100, "c": 1})
    assert sum(w.values()) == mixing.PERIOD and w["a"] > w["b"] > w["c"] >= 1


def test_query(spark):
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op8_pfair_mix(spark, SF_DIR).collect()
    assert Counter(r.doc_id for r in rows if r.mix_epoch == 0) == Counter(list(docs))
    slots: dict = {}
    for r in rows:
        assert docs[r.doc_id] == r.source
        slots.setdefault(r.mix_slot, set()).add((r.source, r.mix_block))
    assert all(len(s) == 1 for s in slots.values())
    weights = mixing.default_weights(Counter(docs.values()))
    seen, total = Counter(), sum(weights.values())
    for t in range(max(slots) + 1):  # while all sources last: less than one block from the share
        assert t in slots
        seen[next(iter(slots[t]))[0]] += 1
        assert all(abs(seen[s] - w * (t + 1) / total) < 1 for s, w in weights.items())


def test_repeats_and_edges(spark):
    rows = [(i, "a", "x") for i in range(200)] + [(1000 + i, "b", "y") for i in range(20)]
    rows += [(7, None, "z")] * 3 + [(None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    got = mixing.mix(docs, weights={"a": 2, "b": 1, "": 1}, block_rows=4, epochs=3).collect()
    first = [r for r in got if r.mix_epoch == 0]
    assert len(first) == len(rows) and {r.mix_epoch for r in got} == {0, 1, 2}
    places = Counter((r.mix_slot, r.mix_place) for r in got)
    assert max(places.values()) == 1
    assert Counter(r.source for r in got)["a"] == 200  # the source that takes longest comes once
    again = mixing.mix(docs.repartition(7), weights={"a": 2, "b": 1, "": 1}, block_rows=4, epochs=3).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"a": 1})
    laid = mixing.in_order(mixing.mix(docs, weights={"a": 2, "b": 1, "": 1}), 3)
    assert laid.columns == ["doc_id", "source"]


def test_small_sources_keep_their_share(spark):
    """A source a thousand times smaller than the hottest fills its slots to the end."""
    sizes = {"a": 20_000, "b": 300, "c": 20, "d": 1}
    docs = spark.createDataFrame(
        [(1000 * k + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)], "doc_id long, source string"
    )
    for weights in (None, {"a": 5, "b": 3, "c": 1, "d": 1}):
        got = mixing.mix(docs, weights=weights).collect()
        weights = weights or mixing.default_weights(sizes)
        assert Counter(r.source for r in got if r.mix_epoch == 0) == sizes
        end, total = max(r.mix_slot for r in got) + 1, sum(weights.values())
        full = Counter(r.mix_slot for r in got)
        assert len(full) == end and set(full.values()) == {16}
        rows = Counter(r.source for r in got)
        assert all(abs(rows[s] / 16 - w * end / total) < 1 for s, w in weights.items())
    with pytest.warns(UserWarning, match="short"):
        assert mixing.mix(docs, epochs=2).where("mix_epoch > 1").count() == 0
