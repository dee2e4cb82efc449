"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

The N rows, numbered 0..N-1, are permuted on the box ``a x b`` with ``a`` just above ``sqrt N``
and ``b = ceil(N / a)``: a number is the pair (left, right), and each round adds a keyed hash of
one half to the other, modulo that half's size. The box exceeds N by less than ``a``; numbers
outside 0..N-1 walk on along their cycle until they are back. Shard and slot of a row are the
remainder and the quotient of its place by the number of shards, so both follow from the row
number alone, and `row_at` goes back from shard and slot. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanchange.llm.common import free_name, number_rows

ROUNDS = 8
# Fewer than sqrt(N) numbers lie outside 0..N-1. Up to N = 4096 no walk can be longer than this;
# above, a longer one has odds below 1e-100, and it stops the job instead of passing unseen.
WALK = 64


def box(rows: int) -> tuple[int, int]:
    a = math.isqrt(max(rows - 1, 0)) + 1
    return a, max(1, -(-rows // a))


def _shift(half: str, other: str, size: int, seed: int, sign: str) -> str:
    return f"pmod(s.{half} {sign} pmod(xxhash64(s.{other}, i, {seed}L), {size}L), {size}L)"


def _step(x: str, a: int, b: int, seed: int, inverse: bool) -> str:
    """One pass of all rounds over the number ``x``, as a fold over the round numbers."""
    sign, rounds = ("-", f"sequence({ROUNDS - 1}, 0)") if inverse else ("+", f"sequence(0, {ROUNDS - 1})")
    left = f"named_struct('l', {_shift('l', 'r', a, seed, sign)}, 'r', s.r)"
    right = f"named_struct('l', s.l, 'r', {_shift('r', 'l', b, seed, sign)})"
    return (
        f"aggregate({rounds}, named_struct('l', {x} div {b}L, 'r', pmod({x}, {b}L)), "
        f"(s, i) -> if(i % 2 = 0, {left}, {right}), s -> s.l * {b}L + s.r)"
    )


def permuted(number: str, rows: int, seed: int = 0, inverse: bool = False) -> Column:
    """The place of row ``number`` (a column name) among ``rows``; ``inverse`` goes back."""
    a, b = box(rows)
    step = _step("x", a, b, seed, inverse)
    walk = f"aggregate(sequence(1, {WALK}), `{number}`, (x, k) -> if(k > 1 and x < {rows}L, x, {step}))"
    place = F.expr(walk)
    return F.when(place < rows, place).otherwise(F.raise_error(F.lit("cycle walk did not end")))


def shard_rows(
    docs: DataFrame, shards: int, order: Sequence[Column], seed: int = 0, prefix: str = ""
) -> DataFrame:
    """All rows of ``docs`` with ``row_number``, ``shard`` and ``slot`` (names get ``prefix``).

    Row numbers follow ``order``; rows equal in it are interchangeable, so give columns that
    tell unlike rows apart. Shard sizes differ by one at most, slots are gapless from 0, and
    the same rows, order and seed give the same places on any cluster. An empty table stays
    empty, repeated rows get places of their own, and null keys come first. A column of ``docs``
    with one of the new names gives way to the new one.
    """
    names = [prefix + n for n in ("row_number", "shard", "slot")]
    docs = docs.drop(*names)
    numbered, rows = number_rows(docs, order, names[0])
    place = free_name(numbered, "_to")
    return (
        numbered.withColumn(place, permuted(names[0], max(rows, 1), seed))
        .withColumn(names[1], F.pmod(F.col(place), F.lit(shards)).cast("int"))
        .withColumn(names[2], F.expr(f"`{place}` div {shards}"))
        .drop(place)
    )


def row_at(df: DataFrame, shard: str, slot: str, shards: int, rows: int, seed: int, name: str) -> DataFrame:
    """Add the row number that sits at ``slot`` of ``shard``: the way back, without any table."""
    place = free_name(df, "_at")
    at = df.withColumn(place, F.col(slot).cast("long") * shards + F.col(shard))
    return at.withColumn(name, permuted(place, rows, seed, inverse=True)).drop(place)


def text_facts(text: str = "text") -> tuple[Column, Column]:
    """Size in UTF-8 bytes plus 16, and the unsigned CRC-32; a null text counts as empty."""
    filled = F.coalesce(F.col(text), F.lit(""))
    return (F.octet_length(filled) + 16).cast("long"), F.crc32(filled.cast("binary"))
