"""What the operators of this package share: intermediate tables, row numbers, components."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanchange.functions.skew import materialize



def by_value(module: str) -> None:
    """Pickle the functions of ``module`` by value: executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted`` with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, which bounds what a function holds when texts are long."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> tuple[DataFrame, int]:
    """Add gapless row numbers from 0 in the order given; also the number of rows.

    The rows are range-partitioned and sorted, each partition counts its own, and the few
    partition totals give every partition its first number. Rows that are equal in ``order``
    are told apart by their place in the scan, so a hot value is split over partitions too.
    ``df`` is sorted once and written once, with all its columns.
    """
    scan, place = free_name(df, "_scan"), free_name(df, "_place")
    keys = [c.asc_nulls_first() for c in order]
    tagged = df.withColumn(scan, F.monotonically_increasing_id())
    ordered = (
        tagged.repartitionByRange(parts(df), *keys, F.col(scan))
        .sortWithinPartitions(*keys, F.col(scan))
        .drop(scan)
        .withColumn(place, F.monotonically_increasing_id())
    )
    ordered = written(ordered)
    pid = F.shiftright(F.col(place), 33).cast("int")
    counts = ordered.groupBy(pid.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).collect()
    first, total = {}, 0
    for row in sorted(counts, key=lambda r: r["_p"]):  # one row per partition
        first[row["_p"]], total = total, total + row["_n"]
    spark = df.sparkSession
    starts = F.broadcast(
        spark.createDataFrame(list(first.items()) or [(0, 0)], "_p int, _first long")
    )
    low = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    numbered = (
        ordered.withColumn("_p", pid)
        .join(starts, "_p")
        .withColumn(name, F.col("_first") + low)
        .drop("_p", "_first", place)
    )
    return numbered, total


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """Connected components of an edge list (``a``, ``b``): ``node``, ``component`` (its least node).

    Large-star and small-star steps in turn, each a grouped minimum and a join, until nothing
    changes; every round is written to the shared folder by ``cut``. A node of high degree is a hot
    grouping key only for a minimum, which is combined before the shuffle; the join back is an
    ordinary equi-join of narrow rows that adaptive execution splits.
    """
    edges = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    before = None
    while True:
        # large star: every larger neighbour of a node points at the least of its neighbourhood
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m"))
        least = least.select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: every smaller neighbour of a node, and the node, point at the least of them
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        joined = large.join(least, "a")
        small = (
            joined.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
            .union(least.select("a", F.col("_m").alias("b")))
            .distinct()
        )
        edges = cut(small)
        state = tuple(
            edges.agg(
                F.count(F.lit(1)),
                F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")),
            ).first()
        )
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def shared_folder(spark) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


FOLDERS: list[str] = []  # made by this process, in order


def new_folder(spark, what: str) -> str:
    """A folder of this run in the shared folder; it goes when the session's process ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    FOLDERS.append(path)
    atexit.register(remove, spark, path)
    return path


def remove(spark, path: str) -> None:
    """Delete a folder, unless the session has ended."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception as gone:  # noqa: BLE001
        if spark._jsc is not None and not spark._jsc.sc().isStopped():
            raise gone


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; this cuts the lineage."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """Like ``written``; also has Spark delete the shuffle files that the writing made.

    For long chains of shuffles: Spark else keeps the files of all of them until the driver
    happens to collect its garbage. The session's own setting is put back.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        return written(df)
    finally:
        conf.unset(FREED) if before is None else conf.set(FREED, before)


def nullable_text(df: DataFrame, column: str) -> Column:
    """The column as a string, whatever it was; null stays null."""
    kind = df.schema[column].dataType
    return F.col(column) if isinstance(kind, T.StringType) else F.col(column).cast("string")
