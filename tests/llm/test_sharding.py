"""Feistel sharding: a permutation for every size, and places that hold their law."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from urbanchange.llm import queries, sharding

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 10, 97, 1000, 4097])
def test_permutation_and_way_back(spark, rows):
    placed = spark.range(rows).withColumn("to", sharding.permuted("id", rows, 5))
    assert sorted(r["to"] for r in placed.collect()) == list(range(rows))
    split = placed.withColumns({"shard": F.col("to") % 4, "slot": F.floor(F.col("to") / 4)})
    back = sharding.row_at(split, "shard", "slot", 4, rows, 5, "from")
    assert back.where("from <> id").count() == 0


def test_seed_changes_the_order(spark):
    a, b = ([r[0] for r in spark.range(500).select(sharding.permuted("id", 500, s)).collect()] for s in (1, 2))
    assert a != b and sum(x == y for x, y in zip(a, b)) < 20


def test_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op3_feistel_shards(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    slots: dict = {}
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(docs[r.doc_id]) + 16, zlib.crc32(docs[r.doc_id]))
        assert r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = {len(s) for s in slots.values()}
    assert set(slots) <= set(range(40)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {(r.doc_id, r.shard, r.slot) for r in queries.op3_feistel_shards(spark, SF_DIR).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_edges(spark):
    rows = [(None, None, 1)] * 50 + [(1, "", 2)] * 30 + [(2, "é" * 50_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long")
    size, crc = sharding.text_facts("text")
    out = sharding.shard_rows(docs.withColumns({"size": size, "crc": crc}), 4, [F.col("doc_id")])
    got = out.collect()
    assert len(got) == 81 and {r["size"] for r in got} == {16, 100_016} and min(r.crc for r in got) == 0
    assert sorted(sum(r.shard == s for r in got) for s in range(4)) == [20, 20, 20, 21]
    assert len({(r.shard, r.slot) for r in got}) == 81
    assert sharding.shard_rows(docs.limit(0), 4, [F.col("doc_id")]).count() == 0
