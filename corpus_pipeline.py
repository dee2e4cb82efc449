"""From raw documents to shards: judge, deduplicate, decontaminate, mix, and place."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanchange.llm import decontaminate, mixing, quality, sharding, simhash
from urbanchange.llm.common import FOLDERS, new_folder, parts, remove

SHARDS = 40
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_scratch: list[str] = []  # what the last stage of this run wrote on its way


def frees_scratch(stage: Stage, first: bool) -> Stage:
    """A stage's result is written before the next stage begins, so that one may delete the
    intermediate tables of the stage before it. The first stage begins a new run: it forgets
    those of the run before, whose result may still be read; they go with the process."""

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _scratch:
            path = _scratch.pop()
            if not first:
                remove(spark, path)
        known = len(FOLDERS)
        out = stage(spark, docs, sf_dir)
        _scratch.extend(FOLDERS[known:])
        return out

    return call


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects as junk or abuse go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the least doc_id stays: fingerprints at three bits or fewer, by the trie join,
    or a five-word shingle similarity of 0.8."""
    return simhash.keep_one(docs, max_bits=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of sources below their target weight again, in mixed order."""
    return mixing.in_order(mixing.mix(docs), parts(docs))


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix, with the row."""
    size, crc = sharding.text_facts("text")
    order = [F.col("doc_id"), F.xxhash64(*docs.columns)]
    placed = sharding.shard_rows(docs, SHARDS, order, seed=42)
    return placed.withColumns({"size": size, "text_crc32": crc})


STAGES = [
    (name, frees_scratch(stage, name == "quality classifier"))
    for name, stage in [
        ("quality classifier", judge_quality),
        ("near-duplicates", drop_near_copies),
        ("benchmark decontamination", drop_benchmark),
        ("mixing", mix_sources),
        ("sharding", place_in_shards),
    ]
]

# EM, shingle lists, the automaton and the schedule have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again, the last too.

    Null and empty texts pass the first three stages: they hold no junk, no shingle and no
    benchmark window. Null ids and null sources are values like any other, repeated rows are
    near copies of each other, and columns that the stages do not name are carried along; a
    column of the name of a result is replaced by it. An empty table gives no rows.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
