"""Mixing sources to target weights by proportionate fairness.

Time is a row of slots, one block of documents each. A source with weight ``w`` of a period of
``W`` slots releases its block ``i`` (from 0) at slot ``floor(i W / w)`` and must have it out by
``ceil((i + 1) W / w)``; the earliest deadline goes first. The weights sum to the period, so every
deadline is met, and at any slot a source is less than one block away from its share. Release
times and deadlines repeat with the period, so the order of one period is the whole schedule: a
table of ``W`` entries, fixed by the weights and not by the data. The place of every document
follows from its number within its source.
"""

from __future__ import annotations

import heapq
import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.llm.common import free_name, number_rows, parts

PERIOD = 1000
SOURCES = 10_000  # more are refused: weights need a period of at least as many slots
SPREAD = 16  # epochs of a row made in one task
NAMES = ["mix_epoch", "mix_block", "mix_slot", "mix_place"]


def default_weights(rows: Mapping[str, int], power: float = 0.7, period: int = PERIOD) -> dict[str, int]:
    """Whole weights that sum to the period, in proportion to ``rows ** power``, none below one."""
    if not rows:
        return {}
    period = max(period, len(rows))
    raw = {s: n**power for s, n in rows.items()}
    spare, total = period - len(rows), sum(raw.values())
    exact = {s: r / total * spare for s, r in raw.items()}
    weights = {s: 1 + int(x) for s, x in exact.items()}
    rest = period - sum(weights.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:rest]:
        weights[s] += 1
    return weights


def one_period(weights: Mapping[str, int]) -> dict[tuple[str, int], int]:
    """Slot of each block of a period, by earliest deadline among the released blocks."""
    period = sum(weights.values())
    released: dict[int, list[tuple[int, str, int]]] = {}
    for source, w in weights.items():
        for i in range(w):
            due = -(-(i + 1) * period // w)
            released.setdefault(i * period // w, []).append((due, source, i))
    ready: list[tuple[int, str, int]] = []
    slots = {}
    for slot in range(period):
        for block in released.get(slot, ()):
            heapq.heappush(ready, block)
        _, source, i = heapq.heappop(ready)
        slots[source, i] = slot
    return slots


def mix(
    docs: DataFrame,
    source: str = "source",
    id_col: str = "doc_id",
    weights: Mapping[str, int] | None = None,
    block_rows: int = 16,
    epochs: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """All rows with the place the mix gives them; rows of sources short of their share repeat.

    Adds ``mix_epoch``, ``mix_block`` (of the source, over epochs), ``mix_slot`` and
    ``mix_place`` (in the block). Every row comes once in epoch 0. The mix ends when the source
    that takes longest is out; until then the others start again as often as their slots ask
    for, and blocks run on over epochs, so no slot stays free. A caller may allow fewer
    ``epochs``: then slots stay free, and a warning says how many rows of which sources are
    missing. Within a source the order is a hash of the id.

    ``weights`` are whole numbers per source, all positive; a source without one, or with one
    but no rows, is an error. By default they follow the rows of the sources to the power 0.7.
    A null source counts as the empty string; repeated rows are rows of their own; an empty
    table stays empty. Columns of ``docs`` with the new names are replaced.
    """
    docs = docs.drop(*NAMES)
    key, place = free_name(docs, "_source"), free_name(docs, "_number")
    tagged = docs.withColumn(key, F.coalesce(F.col(source).cast("string"), F.lit("")))
    whole = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    order = [F.col(key), F.xxhash64(F.col(id_col), F.lit(seed)), F.xxhash64(*whole)]
    numbered, _ = number_rows(tagged, order, place)
    counted = numbered.groupBy(key).count().limit(SOURCES + 1).collect()
    if len(counted) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    rows = {r[key]: r["count"] for r in counted}
    weights = dict(default_weights(rows) if weights is None else weights)
    if rows and (set(weights) != set(rows) or min(weights.values()) < 1):
        raise ValueError("weights must be positive, one for each source that has rows")
    period, slots = max(1, sum(weights.values())), one_period(weights)
    blocks = {s: -(-n // block_rows) for s, n in rows.items()}
    at = lambda s, j: j // weights[s] * period + slots[s, j % weights[s]]
    end = max((at(s, b - 1) for s, b in blocks.items()), default=0)
    asked = {}  # rows of each source up to the end
    for s, w in weights.items():
        turns, rest = divmod(end + 1, period)
        asked[s] = (turns * w + sum(slots[s, i] < rest for i in range(w))) * block_rows
        if at(s, blocks[s] - 1) == end:  # it takes longest, and comes once
            asked[s] = rows[s]
    given = {s: n if epochs is None else min(n, max(1, epochs) * rows[s]) for s, n in asked.items()}
    short = {s: asked[s] - given[s] for s in sorted(asked) if given[s] < asked[s]}
    if short:
        warnings.warn(f"{epochs} epochs leave these sources short of rows: {short}", stacklevel=2)

    spark, first, starts = docs.sparkSession, 0, []
    for s in sorted(rows, key=lambda s: s.encode()):
        starts.append((s, first, rows[s], given[s], weights[s]))
        first += rows[s]
    per_source = F.broadcast(
        spark.createDataFrame(starts, f"{key} string, _first long, _rows long, _given long, _weight long")
    )
    table = F.broadcast(  # one period: at most as many rows as the weights sum to
        spark.createDataFrame([(s, i, t) for (s, i), t in slots.items()], f"{key} string, _turn long, _at long")
    )
    sourced = numbered.join(per_source, key).withColumn("_nth", F.col(place) - F.col("_first"))
    last = F.expr("(_given - 1 - _nth) div _rows")
    few = sourced.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.least(last, F.lit(SPREAD - 1)))))
    if any(given[s] > SPREAD * rows[s] for s in rows):  # the further epochs of small sources are dealt out
        begin = F.explode(F.sequence(F.lit(SPREAD).cast("long"), last, F.lit(SPREAD).cast("long"))).alias("_begin")
        many = sourced.where(last >= SPREAD).select("*", begin).repartition(parts(docs), place, "_begin")
        stop = F.least(last, F.col("_begin") + (SPREAD - 1))
        many = many.withColumn("mix_epoch", F.explode(F.sequence("_begin", stop))).drop("_begin")
        few = few.union(many.select(*few.columns))
    placed = (
        few.withColumn("_nth_row", F.col("_nth") + F.col("mix_epoch") * F.col("_rows"))
        .withColumn("mix_epoch", F.col("mix_epoch").cast("int"))
        .withColumn("mix_block", F.expr(f"_nth_row div {block_rows}"))
        .withColumn("mix_place", F.pmod("_nth_row", F.lit(block_rows)).cast("int"))
        .withColumn("_turn", F.pmod("mix_block", "_weight"))
        .join(table, [key, "_turn"])
        .withColumn("mix_slot", F.expr("mix_block div _weight") * period + F.col("_at"))
    )
    return placed.select(*docs.columns, *NAMES)


def in_order(mixed: DataFrame, parts: int) -> DataFrame:
    """The mixed rows without their places, laid out in the order of the mix."""
    order = ["mix_slot", "mix_place"]
    laid = mixed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return laid.drop(*NAMES)
