"""Decontamination against a plain search of all windows."""

from __future__ import annotations

import hashlib
import re

import pytest

from urbanchange.llm import decontaminate, queries

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    known = {}
    for item, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            known.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, found = plain_words(text), set()
        hit = [False] * len(w)
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if ids := known.get(tuple(w[k : k + n])):
                    found |= ids
                    hit[k : k + n] = [True] * n
        ids = ",".join(sorted(found))
        out[doc] = (len(w), sum(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), any(hit))
    return out


@pytest.mark.parametrize("limit", [400_000, 300])
def test_query(spark, monkeypatch, limit):
    """Also with several automata, when the benchmark exceeds the bound of one."""
    monkeypatch.setattr(decontaminate, "WINDOWS", limit)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6_decontaminate(spark, SF_DIR).collect()}
    assert got == plain(docs, items)
    assert any(v[4] for v in got.values())


def test_edges(spark):
    q = "The quick brown fox jumps over the lazy dog today, said Ann."
    docs = spark.createDataFrame(
        [(1, "É: " + q.upper().replace(",", " --"), 7), (2, None, 7), (3, "", 7), (4, "x " * 200_000, 7),
         (None, "Zwölf größe", 7), (1, q[:40], 7), (1, q[:40], 7)],
        "doc_id long, text string, n_hit long",
    )
    items = spark.createDataFrame([(1, q), (1, q), (2, None), (3, "..."), (None, "zwölf größe")], "item_id long, text string")
    rows = decontaminate.scan(docs, items).collect()
    assert len(rows) == 7
    first = next(r for r in rows if r.n_hit == 12)
    assert first.item_ids == ["1"] and [first.text[s.start : s.end] for s in first.spans] == [q.upper().replace(",", " --")[:-1]]
    assert next(r for r in rows if r.doc_id is None).item_ids == [""]
    assert {(r.doc_id, r.n_words) for r in rows if r.doc_id in (2, 3, 4)} == {(2, 0), (3, 0), (4, 200_000)}
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == 5
    assert {r.n_hit for r in clean.collect()} == {7}
    assert decontaminate.scan(docs.limit(0), items).count() == 0
    assert decontaminate.keep_clean(docs, items.limit(0)).count() == 7
