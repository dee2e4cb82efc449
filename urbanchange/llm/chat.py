"""Chat formatting: logged conversations that are prefixes of longer ones go, the rest is rendered.

A log often holds every snapshot of a growing conversation. Each turn gets a hash of its place,
role and text; the exclusive-or of the first k of them is the hash of the prefix of k turns. Places
come from one range-sorted numbering of all turns, so they are gapless whatever the turn numbers
are. Prefix hashes are summed in levels of `CHUNK` places, so that one endless conversation is no
task of its own. Per prefix the greatest length of a conversation that has it says whether another
goes on from there. Two independent 64-bit hashes make up a prefix hash. DataFrame functions only.

Null roles and texts differ from empty ones; all rows with a null conversation id are one
conversation of their own; a row that repeats id, turn, role and text counts once; equal turn
numbers are ordered by hash, null turns come first; an empty table gives no rows; other columns are
left aside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanchange.functions.skew import salted_join
from urbanchange.llm.common import number_rows, written

CHUNK = 256  # places that are summed together, and chunks of chunks
PART = 64  # turns rendered into one row
TURN = ["k", "known", "turn", "h1", "h2"]  # what tells two turns apart
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(talks: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    same = [F.col(role).isNull(), F.coalesce(role, F.lit("")), F.col(text).isNull(), F.coalesce(text, F.lit(""))]
    number = F.col(turn).cast("long")
    return talks.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("k"),
        F.col(conv).alias("conv"),
        number.isNotNull().alias("known"),
        F.coalesce(number, F.lit(0)).alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
        F.xxhash64(F.lit(1), *same).alias("h1"),
        F.xxhash64(F.lit(2), *same).alias("h2"),
    )


def places(turns: DataFrame) -> DataFrame:
    """The different turns, with their place ``pos`` from 1 in the conversation and its ``n`` turns."""
    narrow = turns.select(*TURN, "conv").dropDuplicates(TURN)
    numbered, _ = number_rows(narrow, [F.col(c) for c in TURN], "num")
    ends = numbered.groupBy("k").agg(F.min("num").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = salted_join(numbered, ends, ["k"])
    return written(placed.select(*TURN, "conv", (F.col("num") - F.col("first") + 1).alias("pos"), "n"))


def _before(sums: DataFrame, level: int) -> DataFrame:
    """Exclusive-or of ``x1``, ``x2`` over the lesser ``c`` of a ``k``, in windows of `CHUNK` rows."""
    inside = [F.col("k")] if not level else [F.col("k"), F.floor(F.col("c") / CHUNK)]
    lesser = Window.partitionBy(*inside).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    near = sums.select("k", "c", *[F.coalesce(F.bit_xor(x).over(lesser), F.lit(0)).alias(x) for x in ("x1", "x2")])
    if not level:
        return near
    up = F.floor(F.col("c") / CHUNK).alias("c")
    above = sums.groupBy("k", up).agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    far = _before(above, level - 1).select("k", F.col("c").alias("u"), F.col("x1").alias("f1"), F.col("x2").alias("f2"))
    both = salted_join(near.withColumn("u", F.floor(F.col("c") / CHUNK)), far, ["k", "u"])
    return both.select("k", "c", *[F.col(f"x{i}").bitwiseXOR(F.col(f"f{i}")).alias(f"x{i}") for i in (1, 2)])


def prefixes(placed: DataFrame) -> DataFrame:
    """Per turn of ``places``: the prefix hash ``p1``, ``p2`` up to it.

    Within chunks of 256 places, over 256 chunks, and over the stretches of 65,536 places, of which
    a conversation of a billion turns has 15,000.
    """
    rows = placed.select(
        "k", "conv", "pos", "n", F.floor((F.col("pos") - 1) / CHUNK).alias("c"),
        F.xxhash64("pos", "h1").alias("e1"), F.xxhash64("pos", "h2").alias("e2"),
    )
    sums = rows.groupBy("k", "c").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    running = Window.partitionBy("k", "c").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mixed = rows.withColumns({e: F.bit_xor(e).over(running) for e in ("e1", "e2")})
    return mixed.join(_before(sums, 1), ["k", "c"]).select(
        "k", "conv", "pos", "n", *[F.col(f"e{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)]
    )


def superseded(placed: DataFrame) -> DataFrame:
    """Keys of conversations that a longer one begins with, or that equal one of a lesser id."""
    hashed = written(prefixes(placed))
    known = hashed.groupBy("pos", "p1", "p2").agg(
        F.max("n").alias("longest"),
        F.min(F.when(F.col("pos") == F.col("n"), F.struct(F.col("conv").isNull().alias("z"), "conv", "k"))).alias("first"),
    )
    ends = hashed.where("pos = n").select("k", "pos", "p1", "p2")
    judged = salted_join(ends, known, ["pos", "p1", "p2"])
    return judged.where((F.col("longest") > F.col("pos")) | (F.col("first.k") != F.col("k"))).select("k")


def render(
    talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The maximal conversations in ChatML: ``conv_id``, ``part``, ``n_turns``, ``rendered``.

    A part holds `PART` turns in order, the last one what is left; mostly there is one. Markers
    inside a text are broken by a zero-width space; a null role is ``unknown``, a null text is empty.
    """
    turns = _turns(talks, conv, turn, role, text)
    placed = places(turns)
    kept = salted_join(placed, superseded(placed), ["k"], "left_anti").select(*TURN, "conv", "pos")
    whole = turns.select(*TURN, "role", "text").dropDuplicates(TURN).join(kept, TURN)
    safe = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<​|"))
    name = F.coalesce(F.lower(F.trim("role")), F.lit("unknown"))
    piece = F.concat(F.lit(OPEN), name, F.lit("\n"), safe, F.lit(CLOSE + "\n"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return (
        whole.groupBy("k", "conv", F.floor((F.col("pos") - 1) / PART).alias("part"))
        .agg(F.count(F.lit(1)).alias("n_turns"), ordered.alias("all"))
        .select(
            F.col("conv").alias(conv), "part", "n_turns",
            F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("rendered"),
        )
    )


ORACLE = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(role || chr(1) || text || chr(2), '') OVER (
           PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS prefix
  FROM turns),
known AS (
  SELECT prefix, max(n) AS longest, min(CASE WHEN pos = n THEN conv_id END) AS first_id
  FROM placed GROUP BY prefix),
maximal AS (
  SELECT conv_id FROM placed JOIN known USING (prefix)
  WHERE pos = n AND longest = pos AND first_id = conv_id)
SELECT conv_id, (pos - 1) // {PART} AS part, count(*) AS n_turns,
       string_agg('{OPEN}' || lower(trim(role)) || chr(10) || replace(text, '<|', '<' || chr(8203) || '|')
                  || '{CLOSE}' || chr(10), '' ORDER BY pos) AS rendered
FROM placed JOIN maximal USING (conv_id) GROUP BY conv_id, (pos - 1) // {PART}
"""
