"""Filter audit: the transducer against plain counts, the orders against a plain replay."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest

from urbanchange.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    text = text or ""
    return (
        len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)
    )


def counted(texts):
    raw = [t.encode() for t in texts]
    out = audit.transduce(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64))
    return list(zip(*(out[c].tolist() for c in audit.COUNTS)))


def random_text(rng):
    letters = "aab \t\nAé#日|\x0b "
    return "".join(rng.choice(letters) for _ in range(rng.randrange(0, 80)))


@pytest.mark.parametrize("inserts", [3, 1 << 18])
def test_transducer(monkeypatch, inserts):
    monkeypatch.setattr(audit, "INSERTS", inserts)
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(400)]
    texts += ["", "x" * 300, "x" * 300 + " " + "x" * 300, "y" * 299 + " z", "a" * 9 + " " + "a" * 9 + " " + "a" * 8 + "b", " "]
    assert counted(texts) == [plain_counts(t) for t in texts]


def test_verified(monkeypatch):
    """Words that share a slot are told apart by their bytes."""
    monkeypatch.setattr(audit.Spans, "_hashes", lambda self, words: np.zeros(len(words), np.uint64))
    texts = ["a b c a b d", "a a", "longer-than-eight longer-than-eighty longer-than-eight"]
    assert counted(texts) == [plain_counts(t) for t in texts]


def plain_audit(docs, labels):
    """The filters applied one by one, in every order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids: dict[str, list] = {}
    for i, t, _ in docs:
        if i is not None:
            ids.setdefault(t or "", []).append(i)
    rows = []
    for i, t, source in docs:
        n, distinct, capitals, points, symbols = plain_counts(t)
        others = ids.get(t or "", [])
        later = bool(others) if i is None else any(j < i for j in others)
        fails = {
            "A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * points, "D": symbols > 0, "E": later
        }
        rows.append((source or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            everyone = left
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in r[1] for r in everyone) - len(gone),
                    sum(r[1] == {f} for r in everyone), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_orders(spark):
    rng = random.Random(3)
    base = [random_text(rng) for _ in range(12)] + ["word " * 60, " ".join(f"w{i}" for i in range(70)), None, ""]
    docs = [(i, rng.choice(base), rng.choice(["a", "b", None, ""])) for i in range(150)]
    docs += [(3, docs[3][1], "a"), (None, base[12], "b"), (None, base[12], "b"), (None, "alone", "a"), (None, "alone", "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, source string, mask int")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(table, said).collect()
    assert len(got) == 4 * 600  # a, b, c, and null and empty as one
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(docs, labels)
    assert audit.audit(table.limit(0), said).count() == 0
    assert audit.audit(table, said.limit(0)).where("good_lost > 0").count() == 0


def test_long_text(spark):
    long = "one two " * 2_000_000 + "Three"
    table = spark.createDataFrame([(1, long, "s"), (2, "x" * 5_000_000, "s"), (3, long, "s")], "doc_id long, text string, source string")
    rows = audit.text_counts(table, "text", ["doc_id"]).collect()
    assert {r.doc_id: (r.n_words, r.n_distinct, r.n_capitals) for r in rows} == {
        1: (4_000_001, 3, 1), 2: (1, 1, 0), 3: (4_000_001, 3, 1)
    }
