"""Filter interaction audit: what each filter removes in every order of five filters.

One pass of a byte transducer over the texts gives word, capital, code-point and symbol counts and
the spans of words; the spans go into a hash table whose hits are verified byte by byte, which
gives the distinct words. Which filters a text fails is then a number from 0 to 31, and all
orders are read from counts per (part, number): what passes a set of filters is a sum over these,
so 120 orders cost no further look at the documents.

Filters: A fewer than 50 words; B distinct words below 65 % of the words; C capitals (A-Z) above
5 % of the code points; D holds one of ``#$%&*|``; E equal to the text of a smaller id anywhere in
the table. Words are runs of ``[^\\x20\\x09-\\x0D]``, told apart by case.

A null text is an empty one, and equal to empty ones. A null id comes after all ids; rows equal in
id and text do not fail E for each other. A null part is the empty string. Repeated labels of an
id count as given if one of them says so; a label with a null id counts nowhere. An empty table
gives no rows. Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.functions.skew import salted_join
from urbanchange.llm.common import by_value, small_batches

by_value(__name__)

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
SLICE = 4 << 20  # bytes of text that go through the transducer together
INSERTS = 1 << 18  # words that are put into the hash table together
LONG = 256  # bytes of a word from which it is kept in a set of its own

# The transducer's table. What a byte emits: part of a word, a capital, the first byte of a code
# point, a symbol of filter D. The state is "inside a word", and the byte alone decides the next
# state, so a whole buffer is stepped at once.
WORD, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8
TABLE = np.array(
    [
        WORD * (not (c == 32 or 9 <= c <= 13))
        | CAPITAL * (65 <= c <= 90)
        | POINT * (c & 0xC0 != 0x80)
        | SYMBOL * (chr(c) in "#$%&*|")
        for c in range(256)
    ],
    np.uint8,
)
BELOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # first k bytes
MIX = np.uint64(0x9E3779B97F4A7C15)


class Spans:
    """A verified hash table of the words of one buffer, each within its text.

    Open addressing with linear probing, stepped for many words at once: words on a free slot
    claim it, words whose slot holds the same bytes are repeats, all others move on.
    """

    def __init__(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, text: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # 8 bytes from each place
        self.data, self.first, self.size, self.text = data, first, size, text
        self.bits = max(4, int(2 * len(first)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64 if len(first) >> 31 else np.int32)

    def _chunk(self, words: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k+7 of words that reach there, as numbers."""
        left = np.minimum(self.size[words] - 8 * k, 8)
        return self.eight[self.first[words] + 8 * k] & BELOW[left]

    def _hashes(self, words: np.ndarray) -> np.ndarray:
        out = (self.text[words].astype(np.uint64) << np.uint64(20)) ^ self.size[words].astype(np.uint64)
        at, k = np.arange(len(words)), 0
        while len(at):
            mixed = (out[at] ^ self._chunk(words[at], k)) * MIX
            out[at] = mixed ^ (mixed >> np.uint64(29))
            k += 1
            at = at[self.size[words[at]] > 8 * k]
        return (out * MIX) >> np.uint64(64 - self.bits)

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words and owners of slots are equal, by their bytes and in one text."""
        same = (self.size[a] == self.size[b]) & (self.text[a] == self.text[b])
        at, k = np.flatnonzero(same), 0
        while len(at):
            equal = self._chunk(a[at], k) == self._chunk(b[at], k)
            same[at[~equal]] = False
            k += 1
            at = at[equal]
            at = at[self.size[a[at]] > 8 * k]
        return same

    def insert(self, words: np.ndarray) -> np.ndarray:
        """The words that were not in the table yet, once each."""
        slot, new = self._hashes(words).astype(np.int64), []
        while len(words):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = words[free]
            owner = self.slots[slot]
            won = owner == words
            new.append(words[won])
            left = ~won
            left[left] = ~self._same(words[left], owner[left])
            words, slot = words[left], (slot[left] + 1) & ((1 << self.bits) - 1)
        return np.concatenate(new) if new else words

    def distinct(self, texts: int) -> np.ndarray:
        """Distinct words of each text."""
        short = np.flatnonzero(self.size <= LONG)
        counts = np.zeros(texts, np.int64)
        for start in range(0, len(short), INSERTS):
            counts += np.bincount(self.text[self.insert(short[start : start + INSERTS])], minlength=texts)
        raw = self.data.tobytes() if len(short) < len(self.size) else b""
        spans = (
            (int(self.text[w]), raw[self.first[w] : self.first[w] + self.size[w]])
            for w in np.flatnonzero(self.size > LONG).tolist()
        )
        for text, _ in set(spans):
            counts[text] += 1
        return counts


def transduce(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the UTF-8 texts that lie one after another in ``data``, up to ``ends`` each."""
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    emits = TABLE[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = emits & WORD
    begins = inside[1:] > inside[:-1]  # from outside a word to inside it
    stops = inside[1:] < inside[:-1]
    # a text that begins right after a word starts anew: the state is reset there
    cut = starts[(starts < len(data)) & (starts > 0)]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    begins[cut] = stops[cut] = True
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    text = np.searchsorted(ends, first, side="right")

    def emitted(what: int) -> np.ndarray:
        places = np.flatnonzero(emits & what)
        return np.searchsorted(places, ends) - np.searchsorted(places, starts)

    return {
        "n_words": np.bincount(text, minlength=len(ends)),
        "n_distinct": Spans(data, first, last - first, text).distinct(len(ends)),
        "n_capitals": emitted(CAPITAL),
        "n_points": emitted(POINT),
        "n_symbols": emitted(SYMBOL),
    }


COUNTS = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]


def text_counts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with word, distinct-word, capital, code-point and symbol counts of every text."""
    names = [*keep, *COUNTS]
    fed = docs.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_utf8"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fed.drop("_utf8").schema] + [f"{c} long" for c in COUNTS])

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = np.cumsum([len(t.as_buffer() or b"") for t in batch.column("_utf8")])
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + SLICE, side="right")))
            yield batch.slice(start, stop - start)
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for part in slices(batch):
                texts = [t.as_buffer() for t in part.column("_utf8")]
                data = np.concatenate([np.frombuffer(t, np.uint8) for t in texts])
                found = transduce(data, np.cumsum([len(t) for t in texts], dtype=np.int64))
                own = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(found[c], pa.int64()) for c in COUNTS]], names)

    return fed.mapInArrow(run, schema)


def failed_filters(counts: DataFrame) -> DataFrame:
    """Add ``mask``: the sum of 1, 2, 4, 8 for failing A, B, C, D."""
    failing = [
        F.col("n_words") < 50,
        100 * F.col("n_distinct") < 65 * F.col("n_words"),
        100 * F.col("n_capitals") > 5 * F.col("n_points"),
        F.col("n_symbols") > 0,
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failing)), F.lit(0))
    return counts.withColumn("mask", mask.cast("int"))


def label_flags(labels: DataFrame, id_col: str) -> DataFrame:
    """One row per labelled id: ``good`` (quality 1) and ``toxic``."""
    said = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    return known.agg(said("quality").alias("good"), said("toxic").alias("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str, id_col: str, text: str) -> DataFrame:
    """Documents per part and failing filters: ``part``, ``mask``, ``n``, ``good``, ``toxic``.

    Equal texts are found by their digest. They fail A to D alike, so a digest's rows are
    combined by (part, flags) with their least id before its least id overall is looked up; a
    large group of copies is a few rows by then.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    ).withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    judged = failed_filters(text_counts(rows, "_text", ["_id", "part", "_digest"])).select("_id", "part", "_digest", "mask")
    flagged = salted_join(judged, label_flags(labels, id_col), ["_id"], "left")
    kind = ["_digest", "part", "mask", "good", "toxic"]
    same_id = (
        flagged.fillna(0, ["good", "toxic"])
        .groupBy(*kind, "_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    order = F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"))
    groups = same_id.groupBy(*kind).agg(
        F.sum("_n").alias("_n"), F.min(F.struct(order.alias("id"), F.col("_n").alias("n"))).alias("_least")
    )
    least = groups.groupBy("_digest").agg(F.min("_least.id").alias("_all"))
    first = F.when(F.col("_least.id") == F.col("_all"), F.col("_least.n")).otherwise(0)
    split = groups.join(least, "_digest").select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), first.alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("_n") - first).alias("n")),
        )).alias("_m"),
    )
    n = F.col("_m.n")
    return split.groupBy("part", F.col("_m.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def all_steps() -> list[tuple[str, int, int, int]]:
    """Order, step, filters before the step and the filter itself as bits; 600 of them."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [
        ("".join(order), k + 1, sum(bit[f] for f in order[:k]), bit[order[k]])
        for order in permutations(FILTERS)
        for k in range(len(FILTERS))
    ]


def audit_orders(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from documents per part and mask.

    The documents that pass a set of filters are those whose mask shares no bit with it; the 32
    such sums of a part answer every order.
    """
    numbers = ["n", "good", "toxic"]
    sets = F.array(*[F.lit(s) for s in range(MASKS)])
    passing = counts.select(
        "part", F.explode(F.filter(sets, lambda s: F.col("mask").bitwiseAND(s) == 0)).alias("_set"), *numbers
    )
    sums = passing.groupBy("part", "_set").agg(*[F.sum(c).alias(c) for c in numbers])
    by_set = F.map_from_entries(F.collect_list(F.struct("_set", F.struct(*numbers))))
    # how often a filter comes first among those that a mask fails, over all orders
    fails = [F.col("mask").bitwiseAND(1 << k) > 0 for k in range(len(FILTERS))]
    turns = F.lit(120) / F.bit_count("mask")
    fairly = counts.groupBy("part").agg(*[
        F.sum(F.when(f, F.col("n") * turns).otherwise(0)).cast("long").alias(f"_{1 << k}") for k, f in enumerate(fails)
    ])
    shares = F.create_map(*[x for k in range(len(FILTERS)) for x in (F.lit(1 << k), F.col(f"_{1 << k}"))])
    parts = sums.groupBy("part").agg(by_set.alias("_sums")).join(fairly.select("part", shares.alias("_shares")), "part")
    steps = F.array(*[
        F.struct(F.lit(o).alias("order"), F.lit(k).alias("step"), F.lit(b).alias("before"), F.lit(f).alias("own"))
        for o, k, b, f in all_steps()
    ])
    laid = parts.select("part", "_sums", "_shares", F.explode(steps).alias("_s"))

    def passed(filters, number: str = "n"):
        return F.coalesce(F.col("_sums")[filters][number], F.lit(0))

    before, own = F.col("_s.before"), F.col("_s.own")
    after = before + own
    removed = passed(before) - passed(after)
    return laid.select(
        "part", F.col("_s.order").alias("filter_order"), F.col("_s.step").alias("step"),
        passed(after).alias("kept"), removed.alias("removed"),
        (passed(F.lit(0)) - passed(own) - removed).alias("redundant"),
        (passed(MASKS - 1 - own) - passed(F.lit(MASKS - 1))).alias("unique_fails"),
        *[(passed(before, c) - passed(after, c)).alias(f"{c}_lost") for c in ("good", "toxic")],
        F.col("_shares")[own].alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``part``, ``filter_order``, ``step`` with what is kept, removed and lost there."""
    return audit_orders(mask_counts(docs, labels, part, id_col, text))


_COUNTED = """
    select doc_id, coalesce(source, '') part, coalesce(text, '') body from documents"""
ORACLE = rf"""
with counted as ({_COUNTED}),
listed as (select *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') words from counted),
least as (select body, min(doc_id) least from counted group by body),
failing as (
  select l.doc_id, l.part,
    len(words) < 50 a, 100 * len(list_distinct(words)) < 65 * len(words) b,
    100 * length(regexp_replace(l.body, '[^A-Z]', '', 'g')) > 5 * length(l.body) c,
    regexp_matches(l.body, '[#$%&*|]') d, coalesce(l.doc_id > m.least, false) e
  from listed l join least m on l.body = m.body),
said as (select doc_id, coalesce(max(cast(quality = 1 as int)), 0) good, coalesce(max(cast(toxic = 1 as int)), 0) toxic
  from labels group by doc_id),
masks as (
  select part, cast(a as int) + 2 * cast(b as int) + 4 * cast(c as int) + 8 * cast(d as int) + 16 * cast(e as int) mask,
    count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic
  from failing left join said using (doc_id) group by 1, 2),
letters as (select unnest(['A','B','C','D','E']) f, unnest([1,2,4,8,16]) bit),
orders as (
  select a.f || b.f || c.f || d.f || e.f filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] bits
  from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (
  select filter_order, step, bits[step] own, coalesce(list_sum(bits[1:step - 1]), 0) earlier
  from orders, (select unnest([1,2,3,4,5]) step)),
laid as (
  select part, filter_order, step, own, n, good, toxic, mask,
    mask & own > 0 fails, mask & cast(earlier as int) > 0 gone
  from masks, steps),
summed as (
  select part, filter_order, step, own,
    coalesce(sum(n) filter (not fails and not gone), 0) kept,
    coalesce(sum(n) filter (fails and not gone), 0) removed,
    coalesce(sum(n) filter (fails and gone), 0) redundant,
    coalesce(sum(n) filter (mask = own), 0) unique_fails,
    coalesce(sum(good) filter (fails and not gone), 0) good_lost,
    coalesce(sum(toxic) filter (fails and not gone), 0) toxic_lost
  from laid group by all)
select part, filter_order, cast(step as int) step, cast(kept as bigint) kept, cast(removed as bigint) removed,
  cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails,
  cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) shapley
from summed
"""
