"""Spelling variant grouping with a bit-sliced position index.

Words of the corpus are counted; frequent ones are the vocabulary. Two words are near if one
inserted, deleted or replaced code point tells them apart. Near words agree on their first or on
their last half, so words are laid out under both halves, and a block of words that share one
is searched at once: per (position, letter) there is a bitset of the words that have that letter
there, and the recurrences of a word run over its letters with whole bitsets, one set of words
without an error so far and one each with a replaced, an inserted and a deleted letter, whose
positions are shifted by one.

A crowded block is laid out again: the stretch that may hold the error is halved, until few words
are left or the stretch is one letter long, where the alphabet bounds the block. A pair that
agrees on both halves belongs to the block of the first half; the other block leaves it out, so
every pair is found exactly once and pairs need not be listed to be counted.

A word's form is its most frequent near word, if that is frequent enough; forms lead from word to
word with ever larger counts, and the last is the root, found by doubling the steps.

A null text has no words; a null id is an empty one in the seed of the planted errors. Repeated
rows count each time. Texts are taken whole; a run of letters is never cut. An empty table gives
no rows. Other columns are left aside.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.functions.skew import hot_keys, salted_join
from urbanchange.llm.common import by_value, parts, written

by_value(__name__)

LEAST_LENGTH = 6  # code points of a word
LEAST_COUNT = 5  # occurrences of a word
RATIO = 5  # times a word's count that its form has at least
PLANTED = 199  # one in so many (document, run) pairs loses a letter; 0: none
BLOCK = 4096  # words of a block that are searched without laying it out again
FLUSH = 8 << 20  # letters of different words that a task counts before it passes counts on

# In Latin-1, U+00C0 to U+00FF are the bytes of the same number; all else but A-Z, a-z is a blank.
LETTERS = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> Counter[bytes]:
    """How often each run of letters occurs, A-Z as a-z, in Latin-1."""
    # a character beyond Latin-1 becomes a question mark, which is no letter
    return Counter(text.encode("latin-1", "replace").translate(LETTERS).lower().split())


def spelled(doc: str, words: list[bytes], planted: int) -> list[bytes]:
    """The words as they count: some (document, word) pairs lose one letter."""
    if not planted:
        return words
    seed = zlib.crc32(doc.encode() + b":")
    utf8 = [w if w.isascii() else w.decode("latin-1").encode() for w in words]
    return [
        w if h % planted else w[: h % len(w)] + w[h % len(w) + 1 :]
        for w, h in zip(words, map(zlib.crc32, utf8, repeat(seed)))
    ]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", planted: int = PLANTED) -> DataFrame:
    """``word`` and ``n`` for all words of at least `LEAST_LENGTH` code points."""
    fed = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_doc"), F.col(text).alias("_text")
    ).where(F.col("_text").isNotNull())

    def passed_on(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        letters = 0
        for batch in batches:
            for doc, body in zip(batch.column("_doc"), batch.column("_text")):
                found = runs(body.as_py())
                known = len(counts)
                for word, n in zip(spelled(doc.as_py(), list(found), planted), found.values()):
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
                letters += sum(map(len, found)) if len(counts) > known else 0  # at least what is new
                if letters > FLUSH:
                    yield passed_on(counts)
                    counts, letters = Counter(), 0
        yield passed_on(counts)

    return fed.mapInArrow(run, "word string, _n long").groupBy("word").agg(F.sum("_n").alias("n"))


# -- blocks ---------------------------------------------------------------------------------

KEY = ["least", "head", "tail", "beyond", "first", "last"]


def _halved(items: DataFrame) -> DataFrame:
    """Each item under the next half from the left and from the right of its stretch.

    ``least`` is the length of the shorter word of the pairs looked for, ``head`` and ``tail``
    how many first and last letters agree, and pairs that agree on their first ``beyond``
    letters belong elsewhere.
    """
    half = F.floor((F.col("least") - F.col("head") - F.col("tail")) / 2).cast("int")
    further = F.col("head") + half
    left = F.struct(further.alias("head"), F.col("tail"), F.col("beyond"))
    right = F.struct(F.col("head"), (F.col("tail") + half).alias("tail"), F.least("beyond", further).alias("beyond"))
    both = F.filter(F.array(left, right), lambda s: s["beyond"] > s["head"])
    laid = items.select("word", "n", "least", F.explode(both).alias("_s")).select("word", "n", "least", "_s.*")
    first = F.substring(F.col("word"), F.lit(1), F.col("head"))
    last = F.substring(F.col("word"), F.length("word") - F.col("tail") + 1, F.col("tail"))
    return laid.withColumns({"first": first, "last": last})


def blocks(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """Words (``word``, ``n``) under every key (`KEY`) of which the pairs are looked for there.

    A word of length L meets words of length L and L + 1 under ``least`` = L and those of length
    L - 1 under ``least`` = L - 1. Every round halves the stretches of crowded blocks, so there
    are at most as many rounds as a word length has binary digits.
    """
    length = F.length("word")
    least = F.filter(F.array(length, length - 1), lambda m: m >= LEAST_LENGTH)
    items = words.select("word", "n", F.explode(least).alias("least")).withColumns(
        {"head": F.lit(0), "tail": F.lit(0), "beyond": F.col("least") + 1}
    )
    done = []
    while True:
        items = written(_halved(items))
        wide = items.where(F.col("least") - F.col("head") - F.col("tail") > 1)
        crowded, few = hot_keys(wide, KEY, limit)
        if crowded is None:
            done.append(items)
            break
        marked = crowded.withColumn("_crowded", F.lit(True))
        marked = items.join(marked, KEY, "left") if few else salted_join(items, marked, KEY, "left")
        marked = written(marked)
        done.append(marked.where(F.col("_crowded").isNull()).drop("_crowded"))
        items = marked.where("_crowded").drop("_crowded")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class PositionIndex:
    """Bitsets over the inner stretches of a block's words, most frequent word first."""

    def __init__(self, inner: list[str], least: int, beyond: int):
        self.least, self.beyond = least, beyond  # of the inner stretches
        self.all = (1 << len(inner)) - 1
        at: dict[tuple[int, str], list[int]] = {}
        lengths: dict[int, list[int]] = {least: [], least + 1: []}
        for k, word in enumerate(inner):
            lengths[len(word)].append(k)
            for place in enumerate(word):
                at.setdefault(place, []).append(k)
        self.at = {place: self._bits(ks, len(inner)) for place, ks in at.items()}
        self.long = {size: self._bits(ks, len(inner)) for size, ks in lengths.items()}

    @staticmethod
    def _bits(places: list[int], size: int) -> int:
        row = bytearray(size // 8 + 1)
        for k in places:
            row[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(row, "little")

    def near(self, word: str) -> int:
        """The words one error from ``word`` with ``least`` as the smaller length, as a bitset."""
        at, none = self.at.get, 0
        exact, replaced, deleted = self.all, 0, 0
        inserted = exact  # the index word has one more letter, which may be its first
        elsewhere = 0
        for i, letter in enumerate(word):
            if i == self.beyond:
                elsewhere = exact
            here = at((i, letter), none)
            deleted = (deleted & at((i - 1, letter), none)) | exact
            replaced = (replaced & here) | (exact & ~here)
            exact &= here
            inserted = (inserted & at((i + 1, letter), none)) | exact
        if self.beyond == len(word):
            elsewhere = exact
        if len(word) == self.least:
            found = (replaced & self.long[self.least]) | (inserted & self.long[self.least + 1])
        else:
            found = deleted & self.long[self.least]
        return found & ~elsewhere


def _search(rows: list[tuple[str, int]], key: tuple) -> list[tuple[str, int, int, str]]:
    """Word, number of near words, and the most frequent of them with its count."""
    least, head, tail, beyond = key[:4]
    rows.sort(key=lambda r: (-r[1], r[0]))  # the lowest bit of a set is its best word
    inner = [w[head : len(w) - tail] for w, _ in rows]
    index = PositionIndex(inner, least - head - tail, beyond - head)
    found = []
    for (word, _), stretch in zip(rows, inner):
        if near := index.near(stretch):
            best, n = rows[(near & -near).bit_length() - 1]
            found.append((word, near.bit_count(), n, best))
    return found


FOUND = "word string, near long, best_n long, best string"


def near_words(laid: DataFrame) -> DataFrame:
    """Per word and block with near words: their number and the best of them."""
    fed = laid.select(*KEY, "word", "n").repartition(parts(laid), *KEY).sortWithinPartitions(*KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []

        def batch_of(found: list) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["word", "near", "best_n", "best"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*KEY, "word", "n")]
            for *new, word, n in zip(*columns):
                if new != key:
                    if len(rows) > 1:
                        found += _search(rows, key)
                    key, rows = new, []
                rows.append((word, n))
            if found:
                yield batch_of(found)
                found = []
        if len(rows) > 1:
            yield batch_of(_search(rows, key))

    return fed.mapInArrow(run, FOUND)


def follow(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: the last word that following ``form`` leads to.

    Every round doubles the steps taken. Counts grow fivefold with a step, so a chain has no
    more than 27 steps and five rounds do. Words without a form are their own root and take no
    part in the joins.
    """
    steps = written(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = salted_join(steps, onward, ["root"], "left")
        steps = written(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moved = not steps.where("_moved").isEmpty()
        steps = steps.drop("_moved")
        if not moved:
            return steps


def variants(words: DataFrame, limit: int = BLOCK, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for different words with counts."""
    words = written(words)
    found = near_words(blocks(words, limit))
    # the least of (-count, word) is the largest count and, on a tie, the first in code points
    best = found.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("_best")
    )
    joined = words.join(best, "word", "left")
    chosen = -F.col("_best.n") >= ratio * F.col("n")
    forms = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, F.col("_best.word")).alias("form"), F.when(chosen, -F.col("_best.n")).alias("form_n"),
    ))
    return forms.join(follow(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def group_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", planted: int = PLANTED) -> DataFrame:
    """Frequent words of the texts with their form and root."""
    counted = word_counts(docs, id_col, text, planted)
    return variants(counted.where(F.col("n") >= LEAST_COUNT))
