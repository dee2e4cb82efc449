"""SimHash: fingerprints, the trie traversal and groups against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from urbanchange.llm import queries, simhash
from urbanchange.llm.common import components

SF_DIR = "/root/testdata/sf0.001"


def plain_fingerprint(text: str | None, n: int = 3) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints: dict, bits: int) -> dict:
    top = {k: k for k in prints}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    groups = plain_groups(prints, 3)
    rows = queries.op1_simhash(spark, SF_DIR).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        k: (f"{prints[k]:016x}", groups[k]) for k in prints
    }


@pytest.mark.parametrize("bits,exact,budget", [(64, 0, 3), (64, 16, 3), (24, 12, 1), (20, 4, 2)])
def test_traverse_finds_all_pairs(bits, exact, budget):
    rng = random.Random(bits + exact)
    codes = {rng.getrandbits(bits) for _ in range(40)}
    for c in list(codes):
        for _ in range(3):
            for b in rng.sample(range(bits), rng.randint(1, 4)):
                c ^= 1 << b
            codes.add(c)
    codes = np.array(sorted(c << (64 - bits) for c in codes), np.uint64)
    found = [tuple(sorted(p)) for i, j in simhash.traverse(codes, bits, exact, budget) for p in zip(i.tolist(), j.tolist())]
    want = [
        (i, j)
        for i in range(len(codes)) for j in range(i + 1, len(codes))
        if (int(codes[i]) ^ int(codes[j])).bit_count() <= budget
        and int(codes[i]) >> (64 - exact) == int(codes[j]) >> (64 - exact)
    ]
    assert sorted(found) == sorted(want)  # every pair, once


def test_hot_block_is_laid_out_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(5)
    center = rng.getrandbits(64)
    codes = {center} | {center ^ (1 << a) ^ (1 << b) for a in range(0, 60, 7) for b in range(3, 64, 9)}
    rows = spark.createDataFrame(
        [(0, c - (1 << 64) if c >> 63 else c, k) for k, c in enumerate(sorted(codes))], "layout long, code long, id long"
    )
    links = {tuple(sorted(r)) for r in simhash.trie_join(rows, 64, 3, links=True).collect()}
    known = sorted(codes)
    assert links == {
        (i, j) for i in range(len(known)) for j in range(i + 1, len(known)) if (known[i] ^ known[j]).bit_count() <= 3
    }
    tree = components(simhash.trie_join(rows, 64, 3))
    assert {r.component for r in tree.collect()} == {0}


def test_edges(spark):
    long_text = "alpha beta gamma " * 40_000
    rows = [
        (1, "One two three four", "x"), (2, "one\ttwo three FOUR", "y"), (2, "one\ttwo three FOUR", "y"),
        (3, None, None), (4, "", None), (5, "   \n", None), (None, "solo words here", "z"),
        (6, "hi", "t"), (7, long_text, "t"), (8, long_text + "delta", "t"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.hamming_groups(docs, "doc_id", "text").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.fingerprint, r.component_id) for r in got}
    assert by[1] == by[2] and by[1][1] == 1
    assert by[3] == by[4] == by[5] == (0, 3)
    assert by[None][1] is None and by[6][1] == 6
    assert by[7][1] == by[8][1] == 7
    assert simhash.hamming_groups(docs.limit(0), "doc_id", "text").count() == 0


def test_keep_one(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(12)]
    near = [" ".join(b.split()[:-6] + ["x"] * 6) for b in base[:6]]  # similarity about 0.94
    rows = [(i, t, i, i) for i, t in enumerate(base + near)]
    rows += [(0, base[0], 0, 0), (40, base[1], 1, 1), (41, None, 0, 0), (41, None, 0, 0), (None, base[2], 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, _sketch long")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect())
    assert ids == [*range(12), 41, 41]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_sketch_recall(spark):
    """Of pairs at a similarity of 0.85 and more, nearly all are found; none below 0.65."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for k in range(120):
        body = [rng.choice(words) for _ in range(300)]
        at = rng.randint(20, 250)
        close = body[:at] + ["zz"] + body[at + 1 : at + 20] + ["yy", "qq"] + body[at + 22 :]  # about 0.9
        far = list(body)
        for j in range(7, 300, 22):
            far[j] = "nn"  # about 0.6
        rows += [(3 * k, " ".join(body)), (3 * k + 1, " ".join(close)), (3 * k + 2, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert sum(3 * k + 1 in ids for k in range(120)) <= 6
    assert sum(3 * k + 2 in ids for k in range(120)) >= 110


def shingle_set(text: str) -> set:
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_brute_force(texts: dict[int, str], similarity: float = 0.8) -> set[int]:
    sets = {k: shingle_set(t) for k, t in texts.items()}
    top = {k: k for k in texts}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {k for k in keys if find(k) == k}


def test_pairs_about_the_threshold(spark):
    """Every pair at a similarity of 0.80 to 0.85 is found, none at 0.75 to 0.80, in long, short
    and repetitive texts."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    texts, near = {}, 0
    for k in range(160):
        size = rng.choice([9, 14, 60, 200, 300])
        body = [rng.choice(words) for _ in range(size)]
        shingles = size - 4
        cut = round(shingles * (0.1 + 0.04 * rng.random()))  # both lose so many of their shingles
        other = body[: size - cut] + [rng.choice(words) for _ in range(cut)]
        again = ["the", "same", "line", "of", "a", "menu"] * rng.choice([0, 0, 30])
        texts[2 * k], texts[2 * k + 1] = " ".join(body + again), " ".join(other + again)
        a, b = shingle_set(texts[2 * k]), shingle_set(texts[2 * k + 1])
        near += 0.8 <= len(a & b) / len(a | b) <= 0.85
    assert near >= 40
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == kept_by_brute_force(texts)


def test_near_pair_behind_another_leader(spark):
    """Two near copies are found although all they share stands in many other texts as well."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    texts = {}
    for _ in range(12):
        body = [rng.choice(words) for _ in range(174)]
        for tail in [20, 20] + [48] * 8:  # the two are at 0.81, the others at 0.64 to 0.71
            texts[len(texts)] = " ".join(body + [rng.choice(words) for _ in range(tail)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = kept_by_brute_force(texts)
    assert len(want) == 12 * 9
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want
