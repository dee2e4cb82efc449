"""The pipeline: each stage by its own operator, and the rows of the whole."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline as pipeline
from test_decontaminate import plain
from test_simhash import plain_fingerprint, shingle_set

SF_DIR = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, Counter(r.doc_id for r in docs.select("doc_id").collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert set(after) <= set(before)
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "near-duplicates":
            assert max(Counter(texts[d] for d in after).values()) == 1
            least = {}
            for d in before:
                least[texts[d]] = min(d, least.get(texts[d], d))
            gone = set(before) - set(after)
            assert sum(least[texts[d]] == d for d in gone) < 30  # the others were exact copies
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
            bad = {d for d, v in plain([(d, texts[d]) for d in before], items).items() if v[4]}
            assert set(before) - set(after) == bad & set(before)
        if name == "mixing":
            assert set(after) == set(before)
        if name == "sharding":
            assert after == before
            rows = docs.select("shard", "slot").collect()
            sizes = Counter(r.shard for r in rows)
            assert max(sizes.values()) - min(sizes.values()) <= 1 and len(set(map(tuple, rows))) == len(rows)
        before = after


def test_run_and_empty(spark, tmp_path):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100
    for name in ("labels", "benchmark", "documents"):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (table.limit(0) if name == "documents" else table).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_the_trie_join(spark):
    """Fingerprints at three bits join texts although fewer than 0.8 of their shingles are shared."""
    rng, texts = random.Random(4), {}
    words = [f"w{i}" for i in range(4000)]
    while len(texts) < 12:
        body = [rng.choice(words) for _ in range(400)]
        other = list(body)
        for at in range(9, 400, 29):
            other[at] = rng.choice(words)
        pair = [" ".join(body), " ".join(other)]
        prints = [plain_fingerprint(t) for t in pair]
        if (prints[0] ^ prints[1]).bit_count() <= 3:
            a, b = map(shingle_set, pair)
            assert len(a & b) < 0.8 * len(a | b)
            texts |= dict(enumerate(pair, len(texts)))
    rows = [*texts.items(), (90, None), (91, ""), (92, " \n"), (93, "other words"), (94, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in dict(pipeline.STAGES)["near-duplicates"](spark, docs, SF_DIR).collect()}
    assert kept == {k for k in texts if k % 2 == 0} | {90, 91, 92, 93}
