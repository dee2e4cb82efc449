"""Joins that survive hot keys, and broadcasts that are checked before they are made."""

from __future__ import annotations

import atexit
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 10_000  # rows a broadcast side may have
HOT_ROWS = 1_000_000  # rows from which one key is treated as hot
BUCKETS = 1 << 20  # key buckets counted before single keys are
TASK_ROWS = 1 << 16  # rows per task of joins whose output is many times their input


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder.

    The session's own part of that folder is deleted when the process ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    own = context.getCheckpointDir()
    if own not in _FOLDERS:
        _FOLDERS.add(own)
        atexit.register(_remove, context, own)
    return df.checkpoint(eager=True)


_FOLDERS: set[str] = set()  # checkpoint folders of the sessions of this process


def _remove(context, folder: str) -> None:
    """Delete a session's checkpoints, unless the session has ended before."""
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cluster groups for a Python function over all shuffle partitions.

    The number is given, so that adaptive execution, which sees few bytes, does not squeeze
    Python-bound groups into few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def tasks_for(spark, rows: int) -> int:
    """How many tasks ``rows`` rows are dealt to, at least the shuffle partitions.

    Adaptive execution goes by bytes: it would squeeze narrow rows that a join or an explode
    multiplies into a few tasks, whose memory then grows with the table.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` as a broadcast side, computed once, or None when it exceeds ``max_rows``.

    Meant for aggregates: at most ``max_rows + 1`` rows ever reach the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def join_stats(
    left: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join per-group aggregates back: broadcast when small, else a salted shuffle join."""
    side = small_side(stats)
    if side is None:
        return salted_join(left, stats, keys, how)
    if not keys:  # one row of global aggregates, or none when there was nothing to aggregate
        return left.join(side, F.lit(True), "left")
    return left.join(side, list(keys), how)


def join_lookup(
    left: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join a lookup table: broadcast when its row count is small, else a salted join."""
    if lookup.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return left.join(F.broadcast(lookup), list(keys), how)
    return salted_join(left, lookup, keys, how)


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    hot_rows: int = HOT_ROWS,
    *,
    coarse: Sequence[Column] | None = None,
) -> tuple[DataFrame | None, bool]:
    """All keys with more than ``hot_rows`` rows (None when there are none), and if they are few.

    Rows are first counted per bucket of keys, a map-side combined count of at most
    ``BUCKETS`` groups; usually no bucket is full and that is all. Only keys of full buckets
    are counted one by one. ``coarse`` gives buckets that follow the layout of the data
    better than a hash does.
    """
    keys = list(keys)
    parts = coarse or [F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))]
    names = [f"_b{i}" for i in range(len(parts))]
    bucketed = df.select(*keys, *[c.alias(n) for c, n in zip(parts, names)])
    counts = bucketed.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows"))
    most = counts.agg(F.max("_rows")).first()[0]
    if most is None or most <= hot_rows:
        return None, True
    full = small_side(counts.where(F.col("_rows") > hot_rows).select(*names))
    if full is not None:
        bucketed = bucketed.join(full, names, "left_semi")
    exact = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = exact.where(F.col("_rows") > hot_rows).select(*keys)
    side = small_side(hot)
    if side is None:
        return hot, False
    return (None if side.isEmpty() else side), True


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    buckets: int = BUCKETS,
    tasks: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which the rows of full ``left`` key buckets are spread over many tasks.

    Keys are dealt into ``buckets`` by a hash, and rows counted per bucket. A bucket with more
    than ``hot_rows`` rows gets one salt per ``hot_rows``: its left rows are spread over them,
    its right rows repeated for each. The table of salts has at most ``buckets`` rows of two
    numbers (16 MB), so its broadcast is bounded whatever the data and however many keys are
    hot; without a full bucket this is a plain join. The salt is a hash of the whole row, so a
    retried task sends every row to the same place again. ``how`` is inner, left, left_semi or
    left_anti. ``tasks`` fixes the number of tasks; ``counted`` are rows to count the keys of
    instead of those of ``left``, if that repeats them a few times each.
    """
    keys = list(keys)

    def joined(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        return a.join(b, on, how) if tasks is None else a.repartition(tasks, *on).join(b.repartition(tasks, *on), on, how)

    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    counts = (left if counted is None else counted).select(bucket).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    full = counts.where(F.col("_rows") > hot_rows).collect()  # at most ``buckets`` pairs
    if not full:
        return joined(left, right, keys)
    salts = F.broadcast(
        left.sparkSession.createDataFrame(
            [(r["_bucket"], -(-r["_rows"] // max(hot_rows, 1))) for r in full], "_bucket long, _salts int"
        )
    )

    def with_salts(df: DataFrame) -> DataFrame:
        known = df.withColumn("_bucket", bucket).join(salts, "_bucket", "left")
        return known.withColumn("_salts", F.coalesce("_salts", F.lit(1))).drop("_bucket")

    row = F.xxhash64(*[F.col(c) for c in left.columns])
    spread_ = with_salts(left).select(*left.columns, F.pmod(row, F.col("_salts")).alias("_salt"))
    copies = F.sequence(F.lit(0).cast("long"), F.col("_salts").cast("long") - 1)
    repeated = with_salts(right).select(*right.columns, F.explode(copies).alias("_salt"))
    return joined(spread_, repeated, [*keys, "_salt"]).drop("_salt")
