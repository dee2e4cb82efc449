"""Perplexity rules: base counts, the Kneser-Ney tables, and verdicts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from urbanchange.llm import perplexity, queries

SF_DIR = "/root/testdata/sf0.001"


def plain_facts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)
    )


def test_query_base_counts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op4_perplexity(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain_facts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert 0.6 < sum(r.kept for r in rows) / len(rows) < 0.97


def plain_symbols(text, n):
    points = [32 if 9 <= ord(c) <= 13 else 48 if "0" <= c <= "9" else ord(c) for c in text]
    return [0] * (n - 1) + [x if x < 1024 else 1 + x % 1023 for x in points]


def plain_model(texts):
    """Kneser-Ney by dictionaries: probability of the last symbol of a tuple after the others."""
    top = perplexity.ORDER + 1
    grams = {top: defaultdict(lambda: [0, set()])}
    for text in texts:
        s = plain_symbols(text, top)
        for i in range(len(text)):
            grams[top][tuple(s[i : i + top])][1].add(text)
    for n in range(top - 1, 0, -1):
        grams[n] = defaultdict(lambda: [0, set()])
        for key, (_, who) in grams[n + 1].items():
            grams[n][key[1:]][0] += 1
            grams[n][key[1:]][1] |= who
    del grams[top]
    cuts, totals, left = {}, {}, {}
    for n, own in grams.items():
        have = Counter(c for c, _ in own.values())
        d = [0.5, 0.75, 1.0]
        if min(have[k] for k in (1, 2, 3, 4)):
            y = have[1] / (have[1] + 2 * have[2])
            d = [min(max(k - (k + 1) * y * have[k + 1] / have[k], 0.05), k - 0.05) for k in (1, 2, 3)]
        cuts[n] = d
        totals[n], left[n] = Counter(), defaultdict(lambda: 1.0)
        for key, (c, _) in own.items():
            totals[n][key[:-1]] += c
        for key, (c, who) in own.items():
            if len(who) > 1:
                left[n][key[:-1]] -= (c - d[min(c, 3) - 1]) / totals[n][key[:-1]]

    def probability(key):
        n = len(key)
        if not n:
            return 1 / 1024
        lower = left[n][key[:-1]] * probability(key[1:])
        c, who = grams[n].get(key, (0, ()))
        return lower + ((c - cuts[n][min(c, 3) - 1]) / totals[n][key[:-1]] if len(who) > 1 else 0)

    return probability


def test_model_equals_plain_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "SLICE", 150)  # many files
    monkeypatch.setattr(perplexity, "CACHE", 400)
    rng = random.Random(3)
    words = "river stone Größe water 12 ruhig Стол камень town, house. 日本 語 winter \n".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(25, 60))) for _ in range(14)]
    texts += [texts[0], "#$%&|<>^~@*" * 30, "x" * 40, "unlike " + "any other text here " * 9]
    rows = [(i, t, "en" if i % 3 else "xx") for i, t in enumerate(texts)] + [(99, texts[1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = {r.doc_id: r.log_perplexity for r in perplexity.verdicts(docs).collect()}
    for lang in ("en", "xx", None):
        own = [(i, t) for i, t, x in rows if x == lang]
        p = plain_model([t for _, t in own])
        for i, text in own:
            s = plain_symbols(text, perplexity.ORDER)
            keys = [tuple(s[k : k + perplexity.ORDER]) for k in range(len(text))]
            assert math.isclose(got[i], -sum(math.log(p(k)) for k in keys) / len(keys), rel_tol=1e-9)
    p = plain_model([t for _, t, x in rows if x == "en"])
    for context in ((0,) * 4, tuple(map(ord, "tone")), (1, 2, 3, 4)):
        assert math.isclose(sum(p((*context, w)) for w in range(1024)), 1, rel_tol=1e-9)


def test_pieces_make_the_same_grams(monkeypatch):
    texts = ["abcdefghij" * 30, "", "x", "Größe und Maß\n" * 9]
    whole = Counter(k for keys, _ in perplexity.grams_of(texts, 5) for k in keys.tolist())
    for piece in (2, 7):
        monkeypatch.setattr(perplexity, "PIECE", piece)
        owners = Counter()
        pieces = Counter()
        for keys, of in perplexity.grams_of(texts, 5):
            pieces.update(keys.tolist())
            owners.update(of.tolist())
        assert pieces == whole and owners == {0: 300, 2: 1, 3: 126}


def test_bands_hold_against_copies_and_junk(spark):
    rng = random.Random(5)
    words = "river stone bridge water quiet town house garden winter light morning road letter story".split()
    prose = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(12))
    noise = lambda: " ".join("".join(rng.choice("#$%&|<>^~@*qxzkvj0") for _ in range(6)) for _ in range(90))
    copied = prose()
    rows = [(i, prose(), "en") for i in range(60)] + [(1000 + i, copied, "en") for i in range(240)]
    rows += [(2000 + i, prose(), "de") for i in range(140)] + [(3000 + i, noise(), "de") for i in range(60)]
    got = perplexity.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert not any(r.base_failed for r in got)
    assert kept == {i for i, _, _ in rows if i < 3000}


def test_edges(spark):
    rng = random.Random(8)
    words = "river stone bridge water quiet town house garden winter light morning road letter story".split()
    prose = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(12))
    good = prose()
    junk = "#$%& @@@ ~~~ ^^^ ||| <<< " * 40
    rows = [(i, prose(), "en", 1) for i in range(60)]
    rows += [(100, " ".join(f"{a}{b}" for a in "#$%&|" for b in "<>^~@*"), "en", 1), (101, junk, "en", 1)]
    rows += [(102, None, "en", 1), (103, "", None, 1), (104, good, None, 1), (104, good, None, 1), (None, "short one", "xx", 1)]
    rows += [(105, "lorem ipsum dolor " * 60_000, "la", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept long")
    out = perplexity.verdicts(docs, keep=["doc_id", "kept"])
    got = out.collect()
    assert len(got) == len(rows) and out.columns[0] == "doc_id"
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(60)) and by[104].kept
    assert not by[100].base_failed and not by[100].kept
    assert by[101].base_failed and by[102].base_failed and by[103].base_failed and by[105].base_failed
    assert by[102].log_perplexity is None and by[105].n_words == 180_000
    assert perplexity.verdicts(docs.limit(0)).count() == 0
