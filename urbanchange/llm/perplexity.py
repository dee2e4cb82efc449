"""Quality rules with an n-gram perplexity: a modified Kneser-Ney model per language.

Tokens are characters of 10 bits: code points below 1,024 stand for themselves, higher ones are
hashed to 1,023 values, digits are one token and so are blanks. A 6-gram is a 60-bit key; its
context and its suffix are shifts of it. Spark gathers the different 6-grams of all documents, and
grouped aggregates and keyed joins make continuation counts, discounts and interpolated
probabilities of orders 5 to 1, so the model grows with the corpus and passes neither through one
task per language nor through the driver. It is stored as files of sorted key arrays, which scoring
searches through a cache of bounded size.

All orders count by types, the highest too: the count of a 5-gram is the number of characters found
before it. So a text that is copied a thousand times weighs no more than once, and near copies
hardly more.

An n-gram that only one text has (copies are one text) says nothing about others: it counts for
discounts and totals, but its mass goes to the lower order. So no text vouches for itself.

A document is rejected when the mean negative log-probability of its characters leaves the band
of its language. The band is the shortest interval with half of the different texts in it, wider
by `width` times its length at either end; up to half of junk does not move it, and a group of
copies is one text. A mean over few characters varies more, so the band opens by
``NOISE / sqrt(characters)``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.functions.skew import join_lookup
from urbanchange.llm.common import by_value, free_name, new_folder, settled, small_batches, written
from urbanchange.llm.warc import opened

by_value(__name__)

BITS, ORDER = 10, 5  # a key of ORDER + 1 symbols has 60 bits
SIZE = 1 << BITS
PIECE = 1 << 20  # characters taken at once
HELD = 1 << 22  # n-grams a task holds before it hands them on
SLICE = 1 << 20  # model rows of one file
CACHE = 12 << 20  # model rows a task keeps
NOISE = 1.0  # about the standard deviation of one character's log-probability
BIN = 1000  # bins of the log-perplexity per unit
MANY = -(1 << 63), (1 << 63) - 1
LEAST = 0.05  # least length of the interval that holds half of the texts
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"]


def symbols(text: str) -> np.ndarray:
    """The tokens of a text; 0 is kept for what comes before it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    s = np.where(points < SIZE, points, 1 + points % (SIZE - 1))
    s[(points >= 9) & (points <= 13)] = 32
    s[(points >= 48) & (points <= 57)] = 48
    return s


def grams_of(texts: Sequence[str], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """n-grams of texts, and the text each belongs to; long texts come in pieces."""
    lead = n - 1
    waiting, owners, size = [], [], 0

    def made() -> tuple[np.ndarray, np.ndarray]:
        s = symbols("".join(waiting))
        keys = np.zeros(len(s) - lead, np.int64)
        for k in range(n):
            keys = keys << BITS | s[k : len(s) - lead + k]
        lengths = np.array([len(w) for w in waiting])
        of = np.repeat(np.array(owners), lengths)[lead:]
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        body = np.ones(len(s), bool)
        body[(starts[:, None] + np.arange(lead)).ravel()] = False  # the characters led in
        return keys[body[lead:]], of[body[lead:]]

    for k, text in enumerate(texts):
        for start in range(0, len(text), PIECE):
            before = text[start - lead : start] if start >= lead else "\0" * (lead - start) + text[:start]
            waiting.append(before + text[start : start + PIECE])
            owners.append(k)
            size += len(waiting[-1])
            if size >= PIECE:
                yield made()
                waiting, owners, size = [], [], 0
    if waiting:
        yield made()


def combined(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """One row per key: the least ``lo`` and the greatest ``hi``, or `MANY` if they differ."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lo, hi = np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)
    several = lo != hi
    lo[several], hi[several] = MANY
    return [keys[at], lo, hi]


def find_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """The different 6-grams of all documents: ``lang``, ``key``, and the least and greatest hash
    of a text that has it, ``lo`` and ``hi`` (`MANY` stands for any two)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        body.alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.xxhash64(body).alias("own")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, blocks in held.items():
                made = combined(*[np.concatenate(c) for c in zip(*blocks)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]).take(pa.array(np.zeros(len(made[0]), np.int8))), *map(pa.array, made)],
                    ["lang", "key", "lo", "hi"],
                )
            held.clear()

        for batch in small_batches(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            own = batch.column("own").to_numpy()
            for name in dict.fromkeys(langs):
                mine = np.flatnonzero(langs == name)
                for keys, of in grams_of([batch.column("text")[int(k)].as_py() for k in mine], ORDER + 1):
                    who = own[mine][of]
                    block = combined(keys, who, who)
                    blocks = held.setdefault(name, [])
                    blocks.append(block)
                    size += len(block[0])
                    if size > 2 * HELD:
                        for k, b in held.items():
                            held[k] = [combined(*[np.concatenate(c) for c in zip(*b)])]
                        size = sum(len(b[0][0]) for b in held.values())
                        if size > HELD:
                            yield from out()
                            size = 0
        yield from out()

    found = rows.mapInArrow(run, "lang string, key long, lo long, hi long")
    return found.groupBy("lang", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


# -- the model ------------------------------------------------------------------------------


def discounts(grams: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of a language for counts of one, two, and three or more."""
    n = grams.groupBy("lang").agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    enough = F.least("n1", "n2", "n3", "n4") > 0  # else too few n-grams to estimate them
    made = []
    for k, usual in ((1, 0.5), (2, 0.75), (3, 1.0)):
        d = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        bounded = F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), d))
        made.append(F.when(enough, bounded).otherwise(F.lit(usual)).alias(f"d{k}"))
    return n.select("lang", *made)


def one_order(grams: DataFrame, n: int, below: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Of n-grams with counts: ``p`` of those that several texts have, and ``weight``, what their
    contexts leave to the lower order ``below``."""
    taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    cut = join_lookup(grams, settled(discounts(grams)), ["lang"]).select(
        "lang", "key", F.shiftright("key", BITS).alias("context"), "c",
        F.when(F.col("lo") != F.col("hi"), F.col("c") - taken).alias("mass"),
    )
    contexts = cut.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("mass").alias("own"))
    weight = (1 - F.col("own") / F.col("total")).alias("weight")
    contexts = settled(contexts.where("own is not null").select("lang", "context", "total", weight))
    own = cut.where("mass is not null").join(contexts, ["lang", "context"])
    if below is None:
        lower = F.lit(1 / SIZE)
    else:
        own = own.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1)))
        own = own.join(below.select("lang", F.col("key").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
        lower = F.col("lower")
    p = F.col("mass") / F.col("total") + F.col("weight") * lower
    return own.select("lang", "key", p.alias("p")), contexts.select("lang", F.col("context").alias("key"), "weight")


def build_model(found: DataFrame) -> DataFrame:
    """Rows ``lang``, ``kind`` (the order, negative for contexts), ``key``, ``value``.

    A suffix and a context each have at most 1,024 n-grams, so no join has a hot key.
    """
    grams = {ORDER + 1: found}
    for n in range(ORDER, 0, -1):  # continuation counts: how many characters come before
        suffix = F.col("key").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("key")
        upper = grams[n + 1].groupBy("lang", suffix)
        grams[n] = settled(upper.agg(F.count(F.lit(1)).alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    out, below = None, None
    for n in range(1, ORDER + 1):
        own, contexts = one_order(grams[n], n, below)
        below = settled(own)
        for kind, rows, value in ((n, below, "p"), (-n, contexts, "weight")):
            rows = rows.select("lang", F.lit(kind).alias("kind"), "key", F.col(value).alias("value"))
            out = rows if out is None else out.union(rows)
    return settled(out)


class Stored:
    """Where the model lies: files sorted by language, kind and key, and the span of each."""

    def __init__(self, model: DataFrame):
        spark = model.sparkSession
        self.folder = new_folder(spark, "model")
        order = ["lang", "kind", "key"]
        files = max(1, -(-model.count() // SLICE))
        model.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(self.folder)
        spans = (
            spark.read.schema(model.schema).parquet(self.folder).groupBy(F.input_file_name().alias("file"))
            .agg(F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi"))
        )
        self.spans = sorted((tuple(r.lo), tuple(r.hi), r.file.rsplit("/", 1)[-1]) for r in spans.collect())  # one per file


class Scorer:
    """Probabilities from the stored key arrays, of which at most `CACHE` rows are held."""

    def __init__(self, stored: Stored):
        self.spans, self.cache, self.rows = stored.spans, OrderedDict(), 0
        self.store, self.root = opened(stored.folder)

    def _file(self, name: str) -> dict:
        if name in self.cache:
            self.cache.move_to_end(name)
            return self.cache[name][0]
        table = pq.read_table(f"{self.root}/{name}", filesystem=self.store, partitioning=None)
        kind, key, value = (table.column(c).to_numpy() for c in ("kind", "key", "value"))
        lang = table.column("lang").combine_chunks().dictionary_encode()
        codes, names = np.asarray(lang.indices), lang.dictionary.to_pylist()
        at = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (kind[1:] != kind[:-1])])
        ends = np.r_[at[1:], len(key)]
        parts = {(names[codes[a]], int(kind[a])): (key[a:b], value[a:b]) for a, b in zip(at, ends)}
        self.cache[name] = parts, len(key)
        self.rows += len(key)
        while self.rows > CACHE and len(self.cache) > 1:
            self.rows -= self.cache.popitem(last=False)[1][1]
        return parts

    def _find(self, lang: str, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen, out = np.zeros(len(keys), bool), np.zeros(len(keys))
        if not len(keys):
            return seen, out
        first, last = (lang, kind, int(keys.min())), (lang, kind, int(keys.max()))
        for lo, hi, name in self.spans:
            if lo <= last and hi >= first:
                have, values = self._file(name).get((lang, kind), (None, None))
                if have is not None:
                    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                    hit = have[at] == keys
                    seen |= hit
                    out[hit] = values[at[hit]]
        return seen, out

    def probability(self, lang: str, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Of the last character after the others; unseen n-grams back off."""
        if n == 0:
            return np.full(len(keys), 1 / SIZE)
        seen, p = self._find(lang, n, keys)
        if not seen.all():
            rest = keys[~seen]
            known, weight = self._find(lang, -n, rest >> BITS)
            lower = self.probability(lang, rest & ((1 << BITS * (n - 1)) - 1), n - 1)
            p[~seen] = np.where(known, weight, 1.0) * lower
        return p


# -- the documents --------------------------------------------------------------------------


FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words in windows that are found twice or more; exact, by doubling numbered windows."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    size = 1
    while size < window:
        pair = ids[:-size] * (int(ids.max()) + 1) + ids[size:]
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0
        size *= 2
    starts = np.flatnonzero(counts[ids] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def base_facts(utf8: bytes) -> tuple[int, int, int, int, int]:
    words = utf8.split()
    lines = [x for x in utf8.split(b"\n") if x.strip()]
    solid = utf8.translate(None, b" \t\n\r\x0b\x0c")
    return (
        len(words),
        len(solid.decode()),
        len(utf8) - len(utf8.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def score(docs: DataFrame, stored: Stored, text: str, lang: str, keep: Sequence[str]) -> DataFrame:
    """``keep``, the base counts and ``log_perplexity`` (null for empty texts) of every row."""
    raw, tongue = free_name(docs, "_text"), free_name(docs, "_lang")
    fields = docs.select(*keep).schema
    for name in NAMES:
        fields = fields.add(name, "double" if name == "log_perplexity" else "long")
    fed = docs.select(
        *keep,
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias(raw),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias(tongue),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(stored)
        for batch in small_batches(batches):
            texts = batch.column(raw).to_pylist()
            langs = np.array(batch.column(tongue).to_pylist(), object)
            total, n = np.zeros(len(texts)), np.zeros(len(texts))
            for name in dict.fromkeys(langs):
                mine = np.flatnonzero(langs == name)
                for keys, of in grams_of([texts[k] for k in mine], ORDER):
                    some, at = np.unique(keys, return_inverse=True)
                    lost = -np.log(scorer.probability(name, some))[at]
                    total[mine] += np.bincount(of, lost, len(mine))
                    n[mine] += np.bincount(of, minlength=len(mine))
            facts = list(zip(*(base_facts(t.encode()) for t in texts))) or [[]] * 5
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            made = [pa.array(f, pa.int64()) for f in facts] + [mean]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, [*keep, *NAMES])

    return fed.mapInArrow(run, fields)


def bands(scored: DataFrame, lang: str, own: str, width: float) -> DataFrame:
    """Per language the ``_low`` and ``_high`` log-perplexity: the shortest interval with half of
    the different texts (hash ``own``), and ``width`` times its length outwards.

    Texts that fail the base rules do not count. A language has at most some ten thousand bins.
    """
    texts = (
        scored.where(F.col("log_perplexity").isNotNull() & ~F.expr(FAILED))
        .groupBy(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_band"), F.col(own))
        .agg(F.min("log_perplexity").alias("_value"))
    )
    binned = texts.groupBy("_band", F.floor(F.col("_value") * BIN).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))

    def shortest(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_bin")
        bins, n = frame["_bin"].to_numpy(), frame["_n"].to_numpy()
        upto = np.cumsum(n)
        end = np.searchsorted(upto, upto - n + (upto[-1] + 1) // 2)
        begin = np.flatnonzero(end < len(bins))
        length = bins[end[begin]] + 1 - bins[begin]
        best = begin[np.argmin(length)]
        low, high = bins[best] / BIN, (bins[end[best]] + 1) / BIN
        reach = width * max(high - low, LEAST)
        return pd.DataFrame({"_band": frame["_band"].iloc[:1], "_low": low - reach, "_high": high + reach})

    return binned.groupBy("_band").applyInPandas(shortest, "_band string, _low double, _high double")


def verdicts(
    docs: DataFrame, text: str = "text", lang: str = "lang", keep: Sequence[str] = ("doc_id",), width: float = 3.0
) -> DataFrame:
    """``keep`` (columns of ``docs``) with base counts, ``log_perplexity``, ``base_failed``, ``kept``.

    Words are what bytes 9 to 13 and 32 separate. ``base_failed``: fewer than 20 words, or over
    30 % of them in 8-word windows found twice or more. ``kept`` further asks for a
    log-perplexity within the band of the language. A null text is an empty one and fails; a null
    language is a language of its own; repeated rows count each time; an empty table gives no
    rows. New columns replace columns of the same name.
    """
    keep = [c for c in dict.fromkeys(keep) if c not in (*NAMES, "base_failed", "kept")]
    tongue, own = free_name(docs, "_tongue"), free_name(docs, "_own")
    stored = Stored(build_model(settled(find_grams(docs, text, lang))))
    tagged = docs.withColumns({
        tongue: F.coalesce(F.col(lang).cast("string"), F.lit("")),
        own: F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))),
    })
    scored = written(score(tagged, stored, text, lang, [*keep, tongue, own]))
    limits = written(bands(scored, tongue, own, width).withColumnRenamed("_band", tongue))
    play = NOISE / F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)))
    inside = F.col("log_perplexity").between(F.col("_low") - play, F.col("_high") + play)
    return (
        join_lookup(scored, limits, [tongue], "left")
        .withColumn("base_failed", F.expr(FAILED))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
        .select(*keep, *NAMES, "base_failed", "kept")
    )
