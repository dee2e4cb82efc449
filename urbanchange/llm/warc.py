"""WARC archives from a page table: a deterministic sharded writer, and a reader.

Rows are numbered in the order of id and payload digest; the shard boundaries are the rows at
equal steps of that order, so they don't depend on the cluster. A shard is written in order by
one task; it begins a new file when the compressed size of the current one reaches the limit.
Files are written under a temporary name and renamed when complete; a repeated task makes the
same bytes under the same names. The manifest, a table that Spark commits after all tasks have
ended, lists what counts; the reader opens nothing else.

Every record is a gzip member with headers, length, block and payload digest made anew from the
payload. Of equal payloads of ``min_bytes`` or more the first in order is a response and the
others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanchange.functions.skew import salted_join
from urbanchange.llm.common import by_value, number_rows, remove

by_value(__name__)

SHARDS = 64
FILE_BYTES = 64 << 20  # compressed size at which a file is closed
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time
MANIFEST = "shard int, seq int, file string, records long, bytes long, sha1 string"
RECORD = (
    "record_id string, record_type string, page_id string, url string, refers_to_id string, "
    "payload_bytes long, payload_digest string, payload binary"
)


# -- records --------------------------------------------------------------------------------


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(row: int, digest: str) -> str:
    """The id of the record of a row, by its place in the order and its payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row}:{digest}')}>"


def one_line(value: str) -> str:
    """A header value: line breaks would end the header."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(row: int, page: str | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response, or with ``first`` (the row of the response) a revisit without payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if first is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(row, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if page is not None:
        head.append(f"X-Row-Id: {one_line(page)}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time, so equal data make equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Roller:
    """Writes members to files of a shard and hands out their manifest rows."""

    def __init__(self, store: fs.FileSystem, root: str, shard: int, limit: int):
        self.store, self.root, self.shard, self.limit, self.seq, self.out = store, root, shard, limit, 0, None

    def add(self, data: bytes) -> tuple | None:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{uuid.uuid4().hex}.tmp"
            self.out = self.store.open_output_stream(self.temporary, compression=None)
            self.records, self.size, self.sum = 0, 0, hashlib.sha1()
        self.out.write(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        self.sum.update(data)
        return self.close() if self.size >= self.limit else None

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.store.move(self.temporary, f"{self.root}/{self.name}")
        row = (self.shard, self.seq, self.name, self.records, self.size, self.sum.hexdigest())
        self.out, self.seq = None, self.seq + 1
        return row


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, for tasks: local, HDFS, S3 and what else Arrow knows."""
    if folder.startswith("file:"):
        folder = "file:///" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


# -- writing --------------------------------------------------------------------------------


def write(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    shards: int = SHARDS,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row to ``folder`` and return the manifest.

    A null payload is empty; null urls and ids have no header; null ids come last. Rows may
    repeat: of equal rows the first is the response, and rows equal in id and payload are written
    by one task, one after the other. An empty table gives an empty manifest. Other columns are
    left aside.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).alias("page"), F.col(url).cast("string").alias("url"), body.alias("body"),
        F.sha1(body).alias("digest"), F.octet_length(body).alias("size"),
    )
    key = [F.col("page").isNull(), F.col("page"), F.col("digest")]
    narrow = rows.select("page", "digest", "size")
    numbered, total = number_rows(narrow, key, "row")
    step = max(1, -(-total // shards))
    firsts = numbered.where(F.col("row") % step == 0).orderBy("row").collect()  # one per shard
    place = lambda *values: F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)])
    kind = narrow.schema["page"].dataType
    starts = dict.fromkeys((r["page"], r["digest"]) for r in firsts[1:])
    bounds = [place(F.lit(p is None), F.lit(p).cast(kind), F.lit(d)) for p, d in starts]
    shard = F.size(F.filter(F.array(*bounds), lambda b: b <= place(*key))) if bounds else F.lit(0)
    # rows of equal payloads: the first of them in order; combined before the shuffle
    copies = (
        numbered.where(F.col("size") >= min_bytes).groupBy("digest")
        .agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    )
    # rows equal in id and payload have consecutive numbers, so one line tells of all of them
    roles = numbered.groupBy("page", "digest").agg(F.min("row").alias("row")).join(copies, "digest", "left")
    # that line sorts right before their payloads, so payloads are shuffled once
    none = lambda kind: F.lit(None).cast(kind)
    told = roles.select("page", "digest", "row", "first", none("string").alias("url"), none("binary").alias("body"))
    full = rows.select("page", "digest", none("long").alias("row"), none("long").alias("first"), "url", "body")
    merged = told.union(full).withColumn("shard", shard).withColumn("id", F.col("page").cast("string"))
    dealt = merged.repartition(shards, "shard").sortWithinPartitions("shard", *key, F.col("row").isNull(), "url")
    dealt = dealt.select("shard", "id", "row", "first", "url", "body")
    store, root = opened(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        roller, done, number, first = None, [], None, None
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "id", "row", "first", "url", "body")]
            for at in range(batch.num_rows):
                shard, page, row, told_first = (c[at].as_py() for c in columns[:4])
                if row is not None:
                    number, first = row, told_first
                    continue
                revisits = first if first is not None and first < number else None
                if roller is None or roller.shard != shard:
                    done.append(roller.close() if roller else None)
                    roller = Roller(store, root, shard, file_bytes)
                url, body = columns[4][at].as_py(), columns[5][at].as_py()
                done.append(roller.add(member(record(number, page, url, body, revisits))))
                number += 1
        done.append(roller.close() if roller else None)
        listed = list(zip(*(d for d in done if d))) or [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["shard", "seq", "file", "records", "bytes", "sha1"]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(listed, kinds)], names)

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    remove(spark, f"{folder}/_temporary")
    return spark.read.parquet(f"{folder}/manifest")


# -- reading --------------------------------------------------------------------------------


def members(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The data of each gzip member of a stream."""
    unpacker, parts = zlib.decompressobj(31), []
    while data := source.read(chunk):
        while data:
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> dict:
    """A record: its headers, and the payload with length and digest computed anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"{fields['WARC-Record-ID']}: the block does not match its digest")
    kind, payload = fields["WARC-Type"], block.partition(b"\r\n\r\n")[2]
    full = kind == "response"
    if full and f"sha1:{base32_sha1(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    return {
        "record_id": fields["WARC-Record-ID"],
        "record_type": kind,
        "page_id": fields.get("X-Row-Id"),
        "url": fields.get("WARC-Target-URI"),
        "refers_to_id": fields.get("WARC-Refers-To"),
        "payload_bytes": len(payload) if full else None,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload": payload if full else None,
    }


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files in the manifest; a revisit has neither payload nor length."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", "records")
    wanted = [f.split(" ") for f in RECORD.split(", ")]
    wanted = [w for w in wanted if payloads or w[0] != "payload"]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for batch in batches:
            for name, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                held, size, seen = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for data in members(source):
                        held.append({k: v for k, v in parse(data).items() if payloads or k != "payload"})
                        size, seen = size + (len(data) if payloads else 200), seen + 1
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if seen != expected:
                    raise ValueError(f"{name}: {seen} records, the manifest has {expected}")
                yield pa.RecordBatch.from_pylist(held, schema)

    files = max(1, manifest.count())
    dealt = manifest.repartition(min(files, 4 * SHARDS), "file")
    return dealt.mapInArrow(run, ", ".join(" ".join(w) for w in wanted))


def resolved(records: DataFrame) -> DataFrame:
    """All records; a revisit gets the length of the response it refers to, and that one's page.

    Only revisits are joined, and salted, as one response may have most of them.
    """
    responses = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"),
    )
    joined = salted_join(records.where("record_type <> 'response'"), responses, ["refers_to_id"], "left")
    error = F.raise_error(F.lit("a revisit refers to no response"))
    sound = F.col("_digest").eqNullSafe(F.col("payload_digest"))
    revisits = joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).withColumn(
        "record_type", F.when(sound, F.col("record_type")).otherwise(error)
    ).drop("_bytes", "_digest")
    whole = records.where("record_type = 'response'")
    return revisits.unionByName(whole.withColumn("refers_to", F.lit(None).cast("string")))
