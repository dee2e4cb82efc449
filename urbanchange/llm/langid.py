"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything but letters becomes a blank, and runs of one to four characters
are hashed into 2 ** `BITS` numbers. Document frequencies come from all training documents; the
weights are fitted to a bounded sample of them, equally many documents per language as far as
there are, by follow-the-regularised-leader with L1 and L2 penalties, epoch by epoch: every task
runs over its part of the sample from the state that all begin with, and the moves of the states
are averaged, weighted by documents. A part of the sample is kept back and sets one temperature
for all languages, at the least log loss.

The rows to learn from are a condition that the caller gives; nothing but text and language of
these rows is learned from, and a prediction sees the text alone. Texts are read whole, in pieces
whose n-grams are added up. A null text and a text without a letter are `und` with score 1; with
no row to learn from, every text is `und` with score 0. Null languages are not learned from.
Repeated rows count each time; a null id is allowed. Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanchange.llm.common import by_value, free_name, small_batches, written

by_value(__name__)

SAMPLE = 8_000  # documents the weights are fitted to
KEPT_BACK = 5  # one in so many documents of the sample is for the temperature instead
EPOCHS = 4
TASKS = 8  # that run over the sample
BITS = 15  # n-gram numbers: 2 ** BITS
ORDERS = (1, 2, 3, 4)
PIECE = 1 << 20  # characters of a text that are hashed together
ALPHA, BETA = 0.5, 1.0  # step size of a coordinate: alpha / (beta + root of squared gradients)
L1, L2 = 0.02, 0.02
TEMPERATURES = np.exp2(np.linspace(-5, 3, 257))
UNKNOWN = "und"

PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of anything but letters as one blank."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else None
    if words is None:
        words = text.encode().translate(ASCII).decode()
    words = words.split()
    return np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32) if words else np.empty(0, np.uint32)


ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a text in ascending order, and how often each occurs."""
    total = None
    points = letters_of(text)
    for start in range(0, len(points), PIECE):
        # n-grams that begin in this piece
        some = points[start : start + PIECE + ORDERS[-1] - 1]
        counts = total if total is not None else np.zeros(1 << BITS, np.int64)
        mixed = np.zeros(len(some), np.uint32)
        for k, order in enumerate(ORDERS):
            mixed = (mixed[: len(some) - k] * PRIMES[0] + some[k:]) * PRIMES[1]
            mixed ^= mixed >> np.uint32(15)
            owned = mixed[:PIECE] * PRIMES[2] + PRIMES[3] * np.uint32(order)
            counts += np.bincount(owned >> np.uint32(32 - BITS), minlength=1 << BITS)
        total = counts
    if total is None:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


def weighed(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped term frequency times inverse document frequency, of length one."""
    x = np.log1p(counts) * idf[at]
    return (x / max(np.sqrt(x @ x), 1e-12)).astype(np.float32)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """State of follow-the-regularised-leader: ``z`` and squared gradients ``n`` per coordinate.

    Coordinates are (n-gram number, language); one more number is the intercept, unpenalised.
    """

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        free = np.zeros(len(z), bool)
        free[-1] = True  # the intercept is always last
        l1 = np.where(free, 0.0, L1)[:, None]
        step = (BETA + np.sqrt(self.n[at])) / ALPHA + np.where(free, 0.0, L2)[:, None]
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / step)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One document: move along the gradient of its log loss."""
        at, x = np.r_[at, len(self.z) - 1], np.r_[x, np.float32(1)]
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error
        seen = self.n[at]
        new = seen + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(seen)) / ALPHA * w
        self.n[at] = new


class Model(NamedTuple):
    """Languages in order, inverse document frequencies, sparse weights, intercepts, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (n-gram numbers + 1, languages), the intercept last
    temperature: float

    def scores(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weighed(at, counts, self.idf) @ self.weights[at] + self.weights[-1]


def document_frequencies(rows: DataFrame) -> tuple[dict[int, int], int]:
    """In how many texts each n-gram number occurs, and the number of texts.

    A task counts into one array; at most 2 ** `BITS` sums come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts = np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in batches:
            for body in batch.column("_text"):
                found[gram_counts(body.as_py())[0]] += 1
                texts += 1
        found[-1] = texts
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at])], ["gram", "n"])

    sums = rows.select("_text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = {r["gram"]: r["n"] for r in sums.collect()}
    return counts, counts.pop(1 << BITS, 0)


def draw(rows: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """About ``sample`` rows, as near as can be equally many of every language.

    Every language may give an equal share; what small ones leave goes to the others. A hash of
    the text picks the rows, so copies are drawn together.
    """
    left, rates = sample, {}
    for rest, (lang, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        share = left / (len(counts) - rest)
        rates[lang] = min(1.0, share / n)
        left -= min(n, share)
    known = F.broadcast(rows.sparkSession.createDataFrame(list(rates.items()), "_lang string, _rate double"))
    drawn = F.pmod(F.xxhash64("_text", F.lit(13)), F.lit(1 << 30))
    return rows.join(known, "_lang").where(drawn < F.col("_rate") * (1 << 30))


EXAMPLE = "part int, label int, grams array<int>, counts array<long>"


def examples(some: DataFrame, languages: Sequence[str]) -> DataFrame:
    """The sample as numbers, in an order that its hash gives: ``part``, ``label``, n-grams.

    Part 0 is kept back. Written once and read again in every epoch.
    """
    number = {lang: k for k, lang in enumerate(languages)}
    order = F.pmod(F.xxhash64("_text", F.lit(17)), F.lit(1 << 40)).alias("_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            made = [gram_counts(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o % KEPT_BACK for o in batch.column("_order").to_pylist()], pa.int32()),
                    pa.array([number[x] for x in batch.column("_lang").to_pylist()], pa.int32()),
                    pa.array([m[0] for m in made], pa.list_(pa.int32())),
                    pa.array([m[1] for m in made], pa.list_(pa.int64())),
                ],
                ["part", "label", "grams", "counts"],
            )

    mixed = some.select("_text", "_lang", order).repartitionByRange(TASKS, "_order").sortWithinPartitions("_order", "_lang")
    return written(mixed.mapInArrow(run, EXAMPLE))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for label, at, counts in zip(batch.column("label").to_pylist(), batch.column("grams"), batch.column("counts")):
        yield label, at.values.to_numpy(), counts.values.to_numpy()


def fit_weights(train: DataFrame, idf: np.ndarray, classes: int) -> np.ndarray:
    """Weights after `EPOCHS` passes over ``train`` (label, grams, counts).

    The state is 2 ** `BITS` by languages, whatever the data. A task sends the coordinates that
    it moved, Spark adds them up, and the driver applies the sums.
    """
    spark = train.sparkSession
    shape = ((1 << BITS) + 1, classes)
    z, n = np.zeros(shape), np.zeros(shape)
    for _ in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leader, seen = Leader(*(a.copy() for a in state.value)), 0
            for batch in batches:
                for label, at, counts in _rows(batch):
                    leader.learn(at, weighed(at, counts, idf), label)
                    seen += 1
            moved = [(a - b).ravel() for a, b in zip((leader.z, leader.n), state.value)]
            at = np.flatnonzero(moved[1])
            names = ["at", "z", "n", "seen"]
            columns = [at, *(seen * m[at] for m in moved), np.full(len(at), seen, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        moves = train.mapInArrow(run, "at long, z double, n double, seen long")
        # the mean over the tasks that moved a coordinate, weighted by their documents
        mean = moves.groupBy("at").agg(*[(F.sum(c) / F.sum("seen")).alias(c) for c in ("z", "n")]).toArrow()
        at = mean.column("at").to_numpy()
        for a, c in ((z, "z"), (n, "n")):
            a.reshape(-1)[at] += mean.column(c).to_numpy()
        state.unpersist()
    every = Leader(z, n)
    return every.weights(slice(None)).astype(np.float32)


def fit_temperature(kept_back: DataFrame, model: Model) -> float:
    """The temperature with the least log loss; losses of all temperatures are summed in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses, seen = np.zeros(len(TEMPERATURES)), 0
        for batch in batches:
            for label, at, counts in _rows(batch):
                p = softmax(model.scores(at, counts) / TEMPERATURES[:, None])
                losses -= np.log(np.maximum(p[:, label], 1e-30))
                seen += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(losses)), pa.int32()), pa.array(losses), pa.array([seen] * len(losses), pa.int64())],
            ["k", "loss", "seen"],
        )

    sums = kept_back.mapInArrow(run, "k int, loss double, seen long").groupBy("k").agg(
        F.sum("loss").alias("loss"), F.sum("seen").alias("seen")
    ).collect()
    if not sums or not sums[0]["seen"]:
        return 1.0
    return float(TEMPERATURES[min(sums, key=lambda r: (r["loss"], r["k"]))["k"]])


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from the rows where ``learn`` holds; None if none has a language and a letter.

    Languages are codes of a finite list; the weights are bounded by their number times
    2 ** `BITS`.
    """
    rows = docs.where(learn).select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
    rows = rows.where(F.col("_text").isNotNull() & F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    frequencies, texts = document_frequencies(rows)
    idf = np.full(1 << BITS, np.log(1 + texts), np.float32)
    idf[list(frequencies)] = np.log((1 + texts) / (1 + np.array(list(frequencies.values())))) + 1
    languages = sorted(counts)
    some = examples(draw(rows, counts, sample), languages)
    weights = fit_weights(some.where("part > 0"), idf, len(languages))
    model = Model(languages, idf, weights, 1.0)
    return model._replace(temperature=fit_temperature(some.where("part = 0"), model))


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``lang_pred`` and ``score``, the calibrated probability of the language."""
    names = ["lang_pred", "score"]
    keep = [c for c in keep if c not in names]
    raw = free_name(docs, "_text")
    fed = docs.select(*keep, F.col(text).cast("string").alias(raw))
    schema = T.StructType([*fed.drop(raw).schema, *T.StructType.fromDDL("lang_pred string, score double")])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (2 ** BITS + 1) by languages

    def judged(body: str | None) -> tuple[str, float]:
        known = shared.value
        at, counts = gram_counts(body) if body else (np.empty(0, np.int32), None)
        if not len(at):
            return UNKNOWN, 1.0
        if known is None:
            return UNKNOWN, 0.0
        p = softmax(known.scores(at, counts) / known.temperature)
        best = int(p.argmax())
        return known.languages[best], float(p[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            made = [judged(t.as_py()) for t in batch.column(raw)]
            own = [batch.column(c) for c in keep]
            found = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays([*own, *found], [*keep, *names])

    return fed.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is never learned from: its id's checksum is divisible. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """Id, ``held_out``, ``lang_pred`` and ``score`` of every row; learned from those not held out."""
    model = train(docs, ~held_out(id_col), text, lang, sample)
    out = predict(docs, model, text, [id_col])
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
