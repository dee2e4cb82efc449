"""Quality classifier from weak labels: heuristics vote, EM weighs them, a linear scorer learns.

Two questions are asked of a document: is it junk, is it abusive? For each, overlapping heuristic
labellers vote yes, no, or not at all; a table of labels that covers some documents is one more
labeller, which mostly does not vote. Expectation-maximisation over the counts of vote patterns
(at most 3 to the power of the labellers, whatever the corpus) estimates the share of yes
documents and how each labeller votes in either class. The posterior of a pattern is a soft label.
A logistic scorer over hashed words, word beginnings and style marks is fitted to the soft labels
of about `SAMPLE` documents, picked by a hash, those that the label table covers first, by
follow-the-regularised-leader in a few passes, and judges every document. Documents on which EM is undecided don't take part in the fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import chain, repeat
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanchange.llm.common import by_value, free_name, small_batches, written
from urbanchange.llm.decontaminate import words_of

by_value(__name__)

SAMPLE = 20_000  # documents the scorer is fitted on
TASKS = 8  # of the fit
BITS = 18  # hashed features: 2 ** BITS, so a model is 2 MB
EPOCHS = 4  # of the fit
RATE, LASSO, RIDGE = 0.3, 0.05, 0.05  # step size of a coordinate and penalties
ROUNDS = 200  # of EM, an end in case it creeps
DOUBT = 0.02  # a posterior between this and one less this is no label
YES, NO, NONE = 1, 0, 2

# Words of abuse in English, in two lists; words that show a text to be English.
INSULTS = {b"idiot", b"moron", b"stupid", b"loser", b"clown", b"scum", b"fool", b"imbecile"}
ENGLISH = {b"the", b"and", b"of", b"to", b"that", b"is", b"with"}
CONTEMPT = {b"worthless", b"pathetic", b"disgusting", b"trash", b"filth", b"vermin", b"garbage"}

SYMBOLS = b"#*$%&|<>{}~^=@\\"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
BLANKS = bytes(32 if 9 <= c <= 13 else c for c in range(256))
TAILS = (b"!! ", b"?? ", b"** ", b"## ", b"$$ ", b"%% ", b"&& ")


def repeated_share(words: list[bytes], window: int = 8) -> float:
    """Share of the ``window``-word windows that occurred before."""
    if len(words) <= window:
        return 0.0
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(len(words) - window + 1, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + one[k : k + len(mixed)]
    return 1 - len(np.unique(mixed)) / len(mixed)


def style(utf8: bytes, words: list[bytes]) -> dict[str, float]:
    """Shares that tell junk from prose."""
    n = max(1, len(words))
    solid = max(1, len(utf8.translate(None, b" \t\n\r\x0b\x0c")))
    upper = len(utf8) - len(utf8.translate(None, UPPER))
    letters = upper + len(utf8) - len(utf8.translate(None, LOWER))
    spaced = utf8.translate(BLANKS) + b" "
    tails = sum(spaced.count(t) for t in TAILS)
    return {
        "symbols": (len(utf8) - len(utf8.translate(None, SYMBOLS))) / solid,
        "shout": upper / max(1, letters),
        "tails": tails / n,
        "bars": words.count(b"|") / n,
        "repeat": repeated_share(words),
        "varied": len(set(words)) / n,
        "bangs": utf8.count(b"!") / n,
        "stutter": sum(map(eq, words, words[1:])) / n,
    }


def _vote(value: float, no: float, yes: float) -> int:
    return YES if value >= yes else NO if value <= no else NONE


def junk_votes(s: dict[str, float]) -> tuple[int, ...]:
    return (
        _vote(s["symbols"], 0.01, 0.05),
        _vote(s["shout"], 0.2, 0.6),
        _vote(s["tails"], 0.02, 0.2),
        _vote(s["bars"], 0.0, 0.15),
        _vote(s["repeat"], 0.1, 0.5),
        _vote(s["bangs"], 0.05, 0.3),
        _vote(s["stutter"], 0.05, 0.3),
    )


def abuse_votes(words: set[bytes]) -> tuple[int, ...]:
    """No hit is a "no" only in a text of the language of the lists."""
    a, b = len(words & INSULTS), len(words & CONTEMPT)
    none = NO if words & ENGLISH else NONE
    return (YES if a else none, YES if b else none, YES if a + b > 1 else none if a + b == 0 else NONE)


def facts(utf8: bytes) -> tuple[tuple[int, ...], tuple[int, ...], set[bytes], dict[str, float]]:
    """Votes on junk and on abuse, the distinct words, and the style of a text."""
    marks, words = style(utf8, utf8.split()), set(words_of(utf8))
    return junk_votes(marks), abuse_votes(words), words, marks


def features(words: set[bytes], marks: dict[str, float]) -> np.ndarray:
    """Hashed numbers of the words, their first 5 bytes, and the style marks.

    A mark is hashed four times over, so that it counts for more than a word.
    """
    starts = {w[:5] for w in words if len(w) > 5}
    style_marks = (f"\n{r}{k}={min(9, int(v * 20))}".encode() for k, v in marks.items() for r in range(4))
    tokens = [*words, *style_marks]
    hashed = np.fromiter(
        chain(map(zlib.crc32, tokens), map(zlib.crc32, starts, repeat(1))), np.uint32, len(tokens) + len(starts)
    )
    return np.unique(hashed & np.uint32((1 << BITS) - 1)).astype(np.int32)


# -- expectation-maximisation ---------------------------------------------------------------


def posteriors(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(yes) of each vote pattern, and P(votes yes | class, votes) as (class, labeller).

    Patterns are rows of votes. It starts from "any yes vote is a yes". Votes are independent
    given the class, and a missing vote says nothing; counts are smoothed by half a document.
    """
    yes = np.where((patterns == YES).any(axis=1), 0.9, 0.02)
    said_yes, said_no = patterns == YES, patterns == NO
    rate = np.zeros((2, patterns.shape[1]))
    before = None
    for _ in range(ROUNDS):
        weight = np.stack([(1 - yes) * counts, yes * counts])
        share = (weight[1].sum() + 0.5) / (weight.sum() + 1)
        rate = (weight @ said_yes + 0.5) / (weight @ (said_yes | said_no) + 1)
        log = np.log(rate) @ said_yes.T + np.log(1 - rate) @ said_no.T + np.log([[1 - share], [share]])
        yes = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if before is not None and np.abs(yes - before).max(initial=0) < 1e-9:
            break
        before = yes
    return yes, rate


# -- the scorer -----------------------------------------------------------------------------


class Scorers:
    """Two logistic scorers (junk, abuse) over the same features, fitted side by side.

    Follow-the-regularised-leader per coordinate; the last number is the intercept. A soft label
    beyond doubt moves its scorer, a missing one (NaN) does not.
    """

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        step = (1 + np.sqrt(self.n[at])) / RATE + RIDGE
        return np.where(np.abs(z) <= LASSO, 0.0, (np.sign(z) * LASSO - z) / step)

    def learn(self, at: np.ndarray, yes: np.ndarray) -> None:
        at = np.r_[at, len(self.z) - 1]
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(axis=0), -50, 50)))
        g = np.where(np.isnan(yes), 0.0, p - yes)
        seen = self.n[at]
        new = seen + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(seen)) / RATE * w
        self.n[at] = new


def fit_scorers(sample: DataFrame, labels: dict[str, dict[tuple[int, ...], float]]) -> list[tuple[np.ndarray, float]]:
    """Weights and intercept of both scorers on the soft labels that are beyond doubt.

    ``sample`` has the votes, ``features`` and ``_order``. Every epoch is one pass in which each
    task runs over its rows from the common state; Spark averages the moves. Where all labels of
    a question agree, there is nothing to tell apart and every document gets that label.
    """
    spark = sample.sparkSession
    soft = []
    for k, c in enumerate(VOTES.names):
        decided = [(list(v), y) for v, y in labels[c].items() if not DOUBT <= y <= 1 - DOUBT]
        soft.append(spark.createDataFrame(decided, f"{c} array<int>, _yes{k} double"))
    rows = sample
    for c, known in zip(VOTES.names, soft):
        rows = rows.join(F.broadcast(known), c, "left")  # a row per vote pattern
    rows = written(
        rows.select("features", "_yes0", "_yes1", "_order").repartitionByRange(TASKS, "_order").sortWithinPartitions("_order")
    )
    sides = rows.agg(*[
        F.count(F.when((F.col(f"_yes{k}") > 0.5) == side, 1)).alias(f"{side}{k}") for k in (0, 1) for side in (True, False)
    ]).first()
    z, n = np.zeros(((1 << BITS) + 1, 2)), np.zeros(((1 << BITS) + 1, 2))
    for _ in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n))  # four numbers a feature

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both, seen = Scorers(*(a.copy() for a in state.value)), 0
            for batch in batches:
                yes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_yes0", "_yes1")], axis=1)
                for at, y in zip(batch.column("features"), yes.astype(float)):
                    both.learn(at.values.to_numpy(), y)
                    seen += 1
            moved = [(a - b).ravel() for a, b in zip((both.z, both.n), state.value)]
            at = np.flatnonzero(moved[1])
            columns = [at, *(seen * m[at] for m in moved), np.full(len(at), seen, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "z", "n", "seen"])

        moves = rows.mapInArrow(run, "at long, z double, n double, seen long")
        mean = moves.groupBy("at").agg(*[(F.sum(c) / F.sum("seen")).alias(c) for c in ("z", "n")]).toArrow()
        for a, c in ((z, "z"), (n, "n")):
            a.reshape(-1)[mean.column("at").to_numpy()] += mean.column(c).to_numpy()
        state.unpersist()
    w = Scorers(z, n).weights(slice(None))
    out = []
    for k in (0, 1):
        if sides[f"True{k}"] and sides[f"False{k}"]:
            out.append((w[:-1, k].copy(), float(w[-1, k])))
        else:
            out.append((np.zeros(1 << BITS), 30.0 if sides[f"True{k}"] else -30.0))
    return out


class Model(NamedTuple):
    """Weights and intercept of both scorers, and how EM says each labeller votes per class."""

    junk: tuple[np.ndarray, float]
    abuse: tuple[np.ndarray, float]
    junk_votes: np.ndarray
    abuse_votes: np.ndarray


VOTES = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("junk", "abuse")])
INTS = pa.list_(pa.int32())


def _votes(docs: DataFrame, text: str, carry: Sequence[str], hashed: bool) -> DataFrame:
    """``carry`` with the votes of every row and, if asked for, its hashed features."""
    fed = docs.select(*carry, F.col(text).cast("binary").alias("_utf8"))
    made_of = [*fed.drop("_utf8").schema, *VOTES]
    schema = T.StructType([*made_of, *([T.StructField("features", T.ArrayType(T.IntegerType()))] if hashed else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            made = [facts(t.as_py() or b"") for t in batch.column("_utf8")]
            columns = [pa.array([m[k] for m in made], INTS) for k in (0, 1)]
            if hashed:
                columns.append(pa.array([features(m[2], m[3]) for m in made], INTS))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + columns, schema.names)

    return fed.mapInArrow(run, schema)


def label_votes(labels: DataFrame, id_col: str) -> DataFrame:
    """One row per labelled id: ``_junk`` and ``_abuse`` as votes. Contrary labels count as yes."""
    vote = lambda c: F.coalesce(F.max(c).cast("int"), F.lit(NONE))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        vote(1 - F.col("quality")).alias("_junk"), vote("toxic").alias("_abuse")
    )


def _with_labels(rows: DataFrame, given: DataFrame | None, how: str) -> DataFrame:
    """``rows`` with the label table's votes, none where it says nothing."""
    if given is None:
        return rows.withColumns({"_junk": F.lit(NONE), "_abuse": F.lit(NONE)})
    joined = rows.join(given, "_id", how)
    return joined.withColumns({c: F.coalesce(c, F.lit(NONE)) for c in ("_junk", "_abuse")})


def train(docs: DataFrame, id_col: str, text: str, labels: DataFrame | None = None, sample: int = SAMPLE) -> Model:
    """EM over the votes on all documents, then both scorers on about ``sample`` of them.

    ``labels`` has ``id_col``, ``quality`` and ``toxic`` (0, 1 or null). The sample is all rows
    it may draw from if these are no more than ``sample``, else that many give or take a few
    times the root; the hash that picks them sees the id alone.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    given = None if labels is None else written(label_votes(labels, id_col))
    both = [F.concat(c, F.array(f"_{c}")).alias(c) for c in VOTES.names]
    voted = _with_labels(_votes(rows, "_text", ["_id"], False), given, "left").select(*both)
    counts = voted.groupBy(*VOTES.names).agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** labellers at most
    soft, votes = {}, {}
    for column in VOTES.names:
        sums: dict[tuple[int, ...], int] = {}
        for r in counts:
            sums[tuple(r[column])] = sums.get(tuple(r[column]), 0) + r["n"]
        patterns = np.array(list(sums), int).reshape(len(sums), -1) if sums else np.empty((0, 0), int)
        yes, votes[column] = posteriors(patterns, np.array(list(sums.values()), float))
        soft[column] = dict(zip(sums, yes.tolist()))
    total = sum(r["n"] for r in counts)
    covered = 0 if given is None else rows.join(given, "_id", "left_semi").count()
    first = min(1.0, sample / max(covered, 1))
    others = min(1.0, max(0, sample - covered) / max(total - covered, 1))
    drawn = F.pmod(F.xxhash64("_id", F.lit(9)), F.lit(1 << 30)) / (1 << 30)
    some = _with_labels(rows.where(drawn < max(first, others)), given, "left")
    labelled = (F.col("_junk") != NONE) | (F.col("_abuse") != NONE)
    some = some.where(drawn < F.when(labelled, first).otherwise(others))
    some = some.where(F.col("_text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    some = some.withColumn("_order", F.pmod(F.xxhash64("_id", "_text", F.lit(23)), F.lit(1 << 40)))
    some = _votes(some, "_text", ["_junk", "_abuse", "_order"], True).select(*both, "features", "_order")
    return Model(*fit_scorers(some, soft), votes["junk"], votes["abuse"])


def judge(
    docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",), only_kept: bool = False
) -> DataFrame:
    """``keep`` with ``junk_score``, ``abuse_score`` (probabilities) and ``kept``; with
    ``only_kept`` the kept rows alone, without the scores."""
    names = ["junk_score", "abuse_score", "kept"]
    keep = list(keep) if only_kept else [c for c in keep if c not in names]
    raw = free_name(docs, "_utf8")
    fed = docs.select(*keep, F.col(text).cast("binary").alias(raw))
    schema = fed.drop(raw).schema
    if not only_kept:
        schema = T.StructType([*schema, *T.StructType.fromDDL("junk_score double, abuse_score double, kept boolean")])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # two weight tables of 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (junk, junk_at), (abuse, abuse_at), *_ = shared.value
        for batch in small_batches(batches):
            scores = []
            for t in batch.column(raw):
                _, _, words, marks = facts(t.as_py() or b"")
                if not words:  # nothing to judge
                    scores.append((-np.inf, -np.inf))
                    continue
                at = features(words, marks)
                scores.append((junk[at].sum() + junk_at, abuse[at].sum() + abuse_at))
            scored = np.array(scores).reshape(-1, 2)
            p = np.where(np.isinf(scored), 0.0, 1 / (1 + np.exp(-np.clip(scored, -50, 50))))
            kept = (p < 0.5).all(axis=1)
            own = [batch.column(c) for c in keep]
            if only_kept:
                yield pa.RecordBatch.from_arrays(own, list(keep)).filter(pa.array(kept))
            else:
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(kept)], [*keep, *names]
                )

    return fed.mapInArrow(run, schema)


def classify(
    docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """Every row's id with its scores and whether it is kept.

    A null text, an empty one and any other without a word is kept with scores of 0, and takes no
    part in the fit; its votes count like any other's. Ids may be null (then without a label) or
    repeat; an empty table gives no rows. Where all soft labels agree, every
    document gets that label. Extra columns are left aside.
    """
    return judge(docs, train(docs, id_col, text, labels, sample), text, [id_col])


def keep_good(
    docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns."""
    return judge(docs, train(docs, id_col, text, labels, sample), text, docs.columns, only_kept=True)
