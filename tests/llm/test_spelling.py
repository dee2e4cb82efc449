"""Spelling variants against a plain comparison of all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from urbanchange.llm import queries, spelling

SF_DIR = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(docs):
    counts = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def deletions(word):
    return {word[:k] + word[k + 1 :] for k in range(len(word))}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return abs(len(a) - len(b)) == 1 and (a in deletions(b) or b in deletions(a))


def plain_variants(counts):
    form, n_near = {}, {}
    for a in counts:
        found = [b for b in counts if abs(len(a) - len(b)) < 2 and near(a, b)]
        n_near[a] = len(found)
        best = min(found, key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best and counts[best] >= 5 * counts[a] else None
    out = {}
    for a in counts:
        root = a
        while form[root]:
            root = form[root]
        out[a] = (form[a], root, counts[a], n_near[a], counts[form[a]] if form[a] else None)
    return out


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = {r.word: tuple(r)[1:] for r in queries.op11_spelling_variants(spark, SF_DIR).collect()}
    assert got == plain_variants(plain_words(docs))
    assert any(v[0] for v in got.values())


@pytest.mark.parametrize("limit", [4, 4096])
def test_all_pairs(spark, limit):
    """Few letters and shared halves crowd the blocks; with a small limit they are laid out again."""
    rng = random.Random(11)
    words = {"abcabc" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(250)}
    words |= {"".join(rng.choice("aß") for _ in range(rng.randrange(6, 9))) for _ in range(150)}
    words |= {"".join(rng.choice("abc") for _ in range(7)) + "ending" for _ in range(80)}
    words |= {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150}
    counts = {w: 5 ** rng.randrange(1, 8) + rng.randrange(3) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: tuple(r)[1:] for r in spelling.variants(table, limit).collect()}
    assert got == plain_variants(counts)


def test_chain(spark):
    """Roots at the end of long chains."""
    words = ["aaaaaa" + "b" * k for k in range(12)]
    counts = {w: 5 ** (k + 1) for k, w in enumerate(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: r.root for r in spelling.variants(table).collect()}
    assert set(got.values()) == {words[-1]}


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 40)
    text = "Straße straße STRASSE naïveté naïvete Ωmega×÷ wörter, Wörter; über-größe größen 日本語größen x"
    rows = [(1, text, 3), (1, text, 3), (None, text, 3), (2, None, 3), (3, "", 3), (4, text * 30_000, 3), (5, "a" * 3_000_000, 3)]
    rows += [(i, text, 3) for i in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = {r.word: tuple(r)[1:] for r in spelling.group_variants(docs).collect()}
    assert got == plain_variants(plain_words([r[:2] for r in rows]))
    assert spelling.group_variants(docs.limit(0)).count() == 0
    assert spelling.group_variants(docs.where("text is null")).count() == 0
