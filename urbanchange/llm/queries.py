"""The queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanchange.llm import audit, chat, decontaminate, langid, mixing, perplexity, quality, secrets, sharding, simhash, spelling, urlfilter, warc
from urbanchange.llm.common import new_folder, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.hamming_groups(_table(spark, sf_dir, "documents"), "doc_id", "text").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    records = warc.resolved(written(warc.read(spark, folder, payloads=False)))
    return records.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, crc = sharding.text_facts("text")
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", size.alias("size"), crc.alias("text_crc32")
    )
    placed = sharding.shard_rows(rows, 40, [F.col(c) for c in rows.columns], seed=42)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op4_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.verdicts(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_dated_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    captures, events = urlfilter.page_captures(pages), urlfilter.page_list_events(pages)
    return urlfilter.evaluate(captures, events, "page_id", "url", "fetched")


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op7_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.joined("base_spans"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op4_perplexity": op4_perplexity,
    "op6_decontaminate": op6_decontaminate,
    "op8_pfair_mix": op8_pfair_mix,
    "op9_weak_quality": op9_weak_quality,
    "op5_dated_url_lists": op5_dated_url_lists,
    "op10_chat_snapshots": op10_chat_snapshots,
    "op2_warc_archives": op2_warc_archives,
    "op7_secret_layers": op7_secret_layers,
    "op3_feistel_shards": op3_feistel_shards,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_language_id": op13_language_id,
}
ORACLES: dict[str, str] = {
    "op5_dated_url_lists": urlfilter.ORACLE,
    "op10_chat_snapshots": chat.ORACLE,
    "op12_filter_audit": audit.ORACLE,
}
