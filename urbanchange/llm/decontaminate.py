"""Benchmark decontamination with one Aho-Corasick automaton over words.

The patterns are all windows of ``window`` consecutive words of every benchmark item; an item of
fewer words, but not none, is one pattern. Letters of the automaton are word numbers, so a text is
scanned once, word by word, and a match ends at a word; the matched words are mapped back to
code-point offsets of the original text.

Words: A-Z count as a-z; a word is a run of ASCII digits and letters and of all characters beyond
ASCII. A null text has no words and is clean; an item without words has no pattern. An empty
benchmark leaves all clean. Rows are never joined or grouped, so repeated ids and clashing names
don't matter; new columns replace columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanchange.llm.common import by_value, free_name, small_batches, written

by_value(__name__)

WINDOWS = 400_000  # patterns of one automaton: about 4 million nodes, 200 MB
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
    for c in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """One row per distinct window of words and item: ``pattern``, ``item``."""
    rows = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        F.col(text).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            found = []
            for item, body in zip(batch.column("item").to_pylist(), batch.column("text")):
                words = words_of(body.as_py())
                last = max(1, len(words) - window + 1) if words else 0
                found += [(b" ".join(words[i : i + window]), item) for i in range(last)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())],
                ["pattern", "item"],
            )

    return rows.mapInArrow(run, "pattern binary, item string").distinct()


class Patterns:
    """An automaton over word numbers; its values are (length, items)."""

    def __init__(self, patterns: Sequence[tuple[bytes, list[str]]]):
        self.number: dict[bytes, int] = {}
        self.items = [items for _, items in patterns]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, (pattern, _) in enumerate(patterns):
            words = pattern.split(b" ")
            key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
            self.machine.add_word(key, (len(words), k))
        self.empty = not patterns
        if not self.empty:
            self.machine.make_automaton()

    def scan(self, words: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        """Mark the words inside any match, and add the items of the matches."""
        if self.empty or not words:
            return
        number = self.number.get
        for end, (length, k) in self.machine.iter(tuple([number(w, 0) for w in words])):
            hit[end + 1 - length : end + 1] = True
            items.update(self.items[k])


def runs(hit: np.ndarray) -> np.ndarray:
    """First and last word of each run of marked words."""
    edge = np.diff(np.r_[0, hit.view(np.int8), 0])
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1)


def word_spans(text: str, pairs: np.ndarray) -> list[dict]:
    """Code-point offsets (end exclusive) of runs of words."""
    if not len(pairs):
        return []
    ends = [m.span() for m in WORD.finditer(text)]
    return [{"start": ends[a][0], "end": ends[b][1]} for a, b in pairs.tolist()]


FACTS = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
NAMES = ["n_words", "n_hit", "item_ids", "spans"]


def scan(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with what the benchmark has in it.

    ``n_words``; ``n_hit``, the words inside an occurrence of any window; ``item_ids``, the items
    with occurring windows, sorted as strings; ``spans``, the runs of hit words in code points of
    the original text. ``keep`` names the columns to carry along (all by default).

    The automaton is broadcast with at most `WINDOWS` patterns. A larger benchmark is dealt into
    that many automata by a hash of the pattern, and the texts pass one after the other; the
    words hit and the items found add up.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in NAMES]
    windows = written(item_windows(items, item_id, item_text, window))
    total = windows.select("pattern").distinct().count()
    chunks = max(1, -(-total * 5 // (WINDOWS * 4))) if total > WINDOWS else 1
    raw, marks = free_name(docs, "_utf8"), free_name(docs, "_marks")
    # the words hit so far travel as runs of word places, the items as they are
    rows = docs.select(*kept, F.col(text).cast("binary").alias(raw)).withColumns(
        {
            marks: F.lit(None).cast("array<array<int>>"),
            "item_ids": F.lit(None).cast("array<string>"),
        }
    )
    for chunk in range(chunks):
        mine = windows.where(F.pmod(F.xxhash64("pattern"), F.lit(chunks)) == chunk)
        grouped = mine.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))
        listed = [(bytes(r["pattern"]), r["items"]) for r in grouped.toLocalIterator()]
        rows = _pass(rows, listed, raw, marks, chunk == chunks - 1, kept)
        if chunk < chunks - 1:
            rows = written(rows)
    return rows


def _pass(
    rows: DataFrame, listed: list, raw: str, marks: str, last: bool, kept: Sequence[str]
) -> DataFrame:
    patterns = rows.sparkSession.sparkContext.broadcast(listed)
    facts = T.StructType.fromDDL(FACTS)
    fields = T.StructType([*rows.select(*kept).schema, *facts]) if last else rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Patterns(patterns.value)
        for batch in small_batches(batches):
            n, n_hit, found, spans, places = [], [], [], [], []
            old_marks = batch.column(marks).to_pylist()
            old_items = batch.column("item_ids").to_pylist()
            for body, was, had in zip(batch.column(raw), old_marks, old_items):
                utf8 = body.as_py()
                words = words_of(utf8)
                hit, items = np.zeros(len(words), bool), set(had or ())
                for a, b in was or ():
                    hit[a : b + 1] = True
                machine.scan(words, hit, items)
                pairs = runs(hit)
                n.append(len(words))
                n_hit.append(int(hit.sum()))
                found.append(sorted(items))
                places.append(pairs.tolist())
                if last:
                    spans.append(word_spans(utf8.decode(), pairs) if len(pairs) else [])
            carried = [batch.column(c) for c in kept]
            items_col = pa.array(found, pa.list_(pa.string()))
            if last:
                made = [pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), items_col, pa.array(spans, SPANS)]
                yield pa.RecordBatch.from_arrays(carried + made, [*kept, *NAMES])
            else:
                made = [batch.column(raw), pa.array(places, pa.list_(pa.list_(pa.int32()))), items_col]
                yield pa.RecordBatch.from_arrays(carried + made, [*kept, raw, marks, "item_ids"])

    return rows.mapInArrow(run, fields)


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with their columns."""
    flag = free_name(docs, "_n_hit")
    own = {c: free_name(docs, f"_own_{c}") for c in docs.columns if c in NAMES}
    scanned = scan(docs.withColumnsRenamed(own), items, text=text, window=window)
    clean = scanned.withColumnRenamed("n_hit", flag).where(F.col(flag) == 0)
    return clean.drop(*[c for c in NAMES if c != "n_hit"], flag).withColumnsRenamed(
        {v: k for k, v in own.items()}
    ).select(*docs.columns)
