"""Exact order statistics whose every sort and state is bounded, whatever the skew.

Doubles are mapped to 64-bit integers that sort alike. Counting per prefix of that
integer (22, then 21, then 21 bits) answers "how many rows come before this value" with
map-side combined aggregates and windows of at most 2**22 rows, so neither a group with
most of the rows nor a value with most of the rows ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanchange.functions.skew import HOT_ROWS, hot_keys, salted_join, small_side

_COARSE = 42
_FINE = 21
_MAX_LONG = 2**63 - 1


def sort_key(value: Column) -> Column:
    """Order-preserving BIGINT of a non-null DOUBLE."""
    bits = F.reflect(
        F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)
    ).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_MAX_LONG)))


def value_counts(
    df: DataFrame, groups: Sequence[str], value: str, weight: Column | None = None
) -> DataFrame:
    """One row per (groups, value) with its weight ``n``; null values are left out."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(n.cast("long").alias("n"))
    )


def running_counts(
    counts: DataFrame, groups: Sequence[str], value: str, weight: str = "n"
) -> DataFrame:
    """Add ``before`` (weight of smaller values) and ``total`` per group.

    ``counts`` has one row per (groups, value).
    """
    groups = list(groups)
    whole_number = isinstance(counts.schema[value].dataType, T.IntegralType)
    key = F.col(value).cast("long") if whole_number else sort_key(F.col(value))
    keyed = counts.withColumn("_key", key).select(
        *counts.columns,
        F.shiftright("_key", _COARSE).alias("_p1"),
        F.shiftright("_key", _FINE).alias("_p2"),
    )
    fine = keyed.groupBy(*groups, "_p1", "_p2").agg(F.sum(weight).alias("_w"))
    coarse = fine.groupBy(*groups, "_p1").agg(F.sum("_w").alias("_w"))
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    coarse = coarse.select(
        *groups,
        "_p1",
        (F.sum("_w").over(whole.orderBy("_p1")) - F.col("_w")).alias("_b1"),
        F.sum("_w").over(whole).alias("total"),
    )
    within = W.partitionBy(*groups, "_p1").orderBy("_p2")
    fine = fine.withColumn("_b2", F.sum("_w").over(within) - F.col("_w"))
    fine = fine.join(coarse, [*groups, "_p1"]).select(
        *groups, "_p2", (F.col("_b1") + F.col("_b2")).alias("_b"), "total"
    )
    within = W.partitionBy(*groups, "_p2").orderBy(value)
    keyed = keyed.withColumn("_b3", F.sum(weight).over(within) - F.col(weight))
    return keyed.join(fine, [*groups, "_p2"]).select(
        *counts.columns, (F.col("_b") + F.col("_b3")).alias("before"), "total"
    )


def average_ranks(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Per (groups, value): ``n`` ties, ``rank`` (ties share the mean rank) and ``total``."""
    ranked = running_counts(value_counts(df, groups, value), groups, value)
    return ranked.select(
        *groups,
        value,
        "n",
        (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"),
        "total",
    )


def _percentiles(counts: DataFrame) -> DataFrame:
    """Percentile rank ``pct`` of every (measure, v)."""
    share = (F.col("before") + (F.col("n") + 1) / F.lit(2.0)) / F.col("total") * F.lit(100.0)
    return running_counts(counts, ["measure"], "v").select("measure", "v", share.alias("pct"))


def _ranks_by_key(df: DataFrame, cols: Sequence[str], key: str, hot_rows: int) -> DataFrame:
    """Only (key, measure, value) is shuffled for the ranks; they join the rows once."""
    value = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    cells = F.array(
        *[F.struct(F.lit(i).alias("measure"), value(c).alias("v")) for i, c in enumerate(cols)]
    )
    long = df.select(
        F.col(key).alias("_key"), F.explode(F.filter(cells, lambda c: c["v"].isNotNull())).alias("_c")
    ).select("_key", "_c.measure", "_c.v")
    ranks = _percentiles(value_counts(long, ["measure"], "v"))
    wide = (
        salted_join(long, ranks, ["measure", "v"], hot_rows=hot_rows)
        .groupBy("_key")
        .agg(*[F.max(F.when(F.col("measure") == i, F.col("pct"))).alias(f"_pct{i}") for i in range(len(cols))])
    )
    position = {c: i for i, c in enumerate(cols)}
    return df.join(wide, F.col(key) == F.col("_key"), "left").select(
        *[F.col(f"_pct{position[c]}").alias(c) if c in position else F.col(c) for c in df.columns]
    )


def with_percentile_ranks(
    df: DataFrame, cols: Sequence[str], hot_rows: int = HOT_ROWS, key: str | None = None
) -> DataFrame:
    """Replace ``cols`` by their percentile rank (0-100, mean rank for ties, null stays null).

    All columns are ranked in one pass over (column, value) rows. With a ``key`` that is unique
    and not null these are (key, column, value); without one, input rows are keyed by their full
    content, identical rows are collapsed first and repeated at the end.
    """
    if key is not None:
        return _ranks_by_key(df, cols, key, hot_rows)
    clean = df.select(
        *[
            F.when(F.isnan(c), None).otherwise(F.col(c).cast("double")).alias(c)
            if c in cols
            else F.col(c)
            for c in df.columns
        ]
    )
    rows = clean.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    row = F.struct(*[F.col(c) for c in df.columns]).alias("_row")
    cells = F.array(
        *[F.struct(F.lit(i).alias("measure"), F.col(c).alias("v")) for i, c in enumerate(cols)]
    )
    long = rows.select(
        row, "_copies", F.explode(F.filter(cells, lambda c: c["v"].isNotNull())).alias("_cell")
    ).select("_row", "_copies", "_cell.measure", "_cell.v")
    counts = value_counts(long, ["measure"], "v", F.col("_copies"))
    ranks = _percentiles(counts)
    placed = salted_join(long, ranks, ["measure", "v"], hot_rows=hot_rows)
    wide = placed.groupBy("_row", "_copies").agg(
        *[
            F.max(F.when(F.col("measure") == i, F.col("pct"))).alias(f"_pct{i}")
            for i in range(len(cols))
        ]
    )
    nothing = rows.where(F.coalesce(*[F.col(c) for c in cols]).isNull()).select(
        row,
        "_copies",
        *[F.lit(None).cast("double").alias(f"_pct{i}") for i in range(len(cols))],
    )
    position = {c: i for i, c in enumerate(cols)}
    block = 10_000
    return (
        wide.unionByName(nothing)
        .withColumn(
            "_block",
            F.explode(
                F.sequence(F.lit(0), ((F.col("_copies") - 1) / block).cast("long"))
            ),
        )
        .withColumn(
            "_copy",
            F.explode(
                F.sequence(
                    F.lit(1), F.least(F.lit(block), F.col("_copies") - F.col("_block") * block)
                )
            ),
        )
        .select(
            *[
                F.col(f"_pct{position[c]}").alias(c) if c in position else F.col(f"_row.{c}")
                for c in df.columns
            ]
        )
    )


def _positions(probs: Sequence[float]) -> Column:
    """0-based ranks next to every quantile of a group with ``total`` rows."""
    last = F.col("total") - 1
    return F.array_distinct(
        F.array(
            *[f(last * F.lit(float(p))).cast("long") for p in probs for f in (F.floor, F.ceil)]
        )
    )


def _hits(counts: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """Rows of ``counts`` (columns n, start, positions) whose rank range holds a position."""
    window = W.partitionBy(*within).orderBy(order) if within else W.partitionBy(F.lit(0)).orderBy(order)
    placed = counts.withColumn("before", F.col("start") + F.sum("n").over(window) - F.col("n"))
    return placed.where(
        F.exists(
            "positions",
            lambda t: (t >= F.col("before")) & (t < F.col("before") + F.col("n")),
        )
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    groups: Sequence[str] = (),
    small_rows: int = HOT_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles of ``value``, one column per entry of ``probs``.

    Three passes, each a map-side combined count: find the coarse prefixes that hold the
    wanted ranks, then the fine prefixes inside them, then the values. Raw rows are not
    shuffled as long as the located prefixes of all groups fit a checked broadcast.
    Inputs of at most ``small_rows`` rows (counted) use the built-in ``percentile``.
    """
    groups = list(groups)
    if df.select(value).count() <= small_rows:
        clean = F.when(~F.isnan(value), F.col(value).cast("double"))
        return (
            df.groupBy(*groups)
            .agg(
                *[F.percentile(clean, float(p)).alias(name) for name, p in probs.items()],
                F.count(clean).alias("_valid"),
            )
            .where("_valid > 0")
            .drop("_valid")
        )
    base = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *groups, F.col(value).cast("double").alias("_v")
    )
    keyed = base.withColumn("_key", sort_key(F.col("_v"))).select(
        *groups,
        "_v",
        F.shiftright("_key", _COARSE).alias("_p1"),
        F.shiftright("_key", _FINE).alias("_p2"),
        F.lit(1).cast("long").alias("n"),
    )
    coarse = keyed.groupBy(*groups, "_p1").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    coarse = (
        coarse.withColumn("total", F.sum("n").over(whole))
        .withColumn("positions", _positions(list(probs.values())))
        .withColumn("start", F.lit(0).cast("long"))
    )
    first = _hits(coarse, groups, "_p1").select(
        *groups, "_p1", "total", "positions", F.col("before").alias("start")
    )
    side = small_side(first)
    if side is None:
        keyed = keyed.groupBy(*groups, "_v", "_p1", "_p2").agg(F.sum("n").alias("n"))
        side = first
    carried = ["total", "positions", "start"]
    fine = (
        keyed.join(side, [*groups, "_p1"])
        .groupBy(*groups, "_p1", "_p2", *carried)
        .agg(F.sum("n").alias("n"))
    )
    second = _hits(fine, [*groups, "_p1"], "_p2").select(
        *groups, "_p2", "total", "positions", F.col("before").alias("start")
    )
    side = small_side(second)
    exact = (
        keyed.join(second if side is None else side, [*groups, "_p2"])
        .groupBy(*groups, "_p2", "_v", *carried)
        .agg(F.sum("n").alias("n"))
    )
    third = _hits(exact, [*groups, "_p2"], "_v")

    def at(position: Column) -> Column:
        inside = (position >= F.col("before")) & (position < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.col("_v")))

    def spot(p: float) -> Column:
        return (F.col("total") - 1) * F.lit(float(p))

    picked = third.groupBy(*groups).agg(
        F.max("total").alias("_total"),
        *[
            at(f(spot(p)).cast("long")).alias(f"_{side_}_{i}")
            for i, p in enumerate(probs.values())
            for side_, f in (("lo", F.floor), ("hi", F.ceil))
        ],
    )

    def interpolate(i: int, p: float) -> Column:
        """As the built-in does it, so both routes agree to the last bit."""
        where = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{i}"), F.col(f"_hi_{i}")
        between = (F.ceil(where) - where) * low + (where - F.floor(where)) * high
        return F.when((F.floor(where) == F.ceil(where)) | (low == high), low).otherwise(between)

    return picked.select(
        *groups, *[interpolate(i, p).alias(name) for i, (name, p) in enumerate(probs.items())]
    )


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    hot_rows: int = HOT_ROWS,
    extra: Sequence[Column] = (),
    sizes: DataFrame | None = None,
    coarse: Sequence[Column] | None = None,
) -> DataFrame:
    """Quantiles of many, normally small, groups; groups without values give null.

    The built-in ``percentile`` keeps all distinct values of a group in one state, so
    groups above ``hot_rows`` take the exact multi-pass route instead. They are found by
    counting buckets of groups (``coarse``, see hot_keys), or from ``sizes`` (keys, rows)
    when bounds of the group sizes are at hand. ``extra`` are further aggregates of the
    same groups.
    """
    keys = list(keys)

    def builtin(part: DataFrame) -> DataFrame:
        clean = F.when(~F.isnan(value), F.col(value).cast("double"))
        return part.groupBy(*keys).agg(
            *[F.percentile(clean, float(p)).alias(name) for name, p in probs.items()], *extra
        )

    def in_passes(part: DataFrame) -> DataFrame:
        groups = part.groupBy(*keys).agg(*extra) if extra else part.select(*keys).distinct()
        found = exact_quantiles(part, value, probs, keys, small_rows=hot_rows)
        return groups.join(found, keys, "left")

    if sizes is not None:
        side = small_side(sizes.where(F.col("rows") > hot_rows).select(*keys))
        few = side is not None
        hot = None if few and side.isEmpty() else side
    else:
        hot, few = hot_keys(df, keys, hot_rows, coarse=coarse)
    if not few:  # too many to broadcast: all groups take the exact route
        return in_passes(df)
    if hot is None:
        return builtin(df)
    cold_part = builtin(df.join(hot, keys, "left_anti"))
    return cold_part.unionByName(in_passes(df.join(hot, keys, "left_semi")))


def numbered_by_hash(
    df: DataFrame, groups: Sequence[str], digest: str, ties: Sequence[str], name: str
) -> DataFrame:
    """Row number (from 1) per group in the order of a hex ``digest`` column.

    Rows are numbered inside 65,536 digest buckets per group and shifted by the counts of
    the buckets before, so a group of any size is spread evenly.
    """
    groups = list(groups)
    bucketed = df.withColumn("_bucket", F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"))
    counts = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    running = W.partitionBy(*groups).orderBy("_bucket")
    offsets = counts.select(
        *groups, "_bucket", (F.sum("_rows").over(running) - F.col("_rows")).alias("_offset")
    )
    within = W.partitionBy(*groups, "_bucket").orderBy(digest, *ties)
    return (
        bucketed.withColumn("_rn", F.row_number().over(within))
        .join(offsets, [*groups, "_bucket"])
        .select(*df.columns, (F.col("_offset") + F.col("_rn")).alias(name))
    )
