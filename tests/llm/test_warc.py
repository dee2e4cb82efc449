"""WARC archives: round trip, determinism, rolling, edges."""

from __future__ import annotations

import base64
import gzip
import hashlib

from pyarrow import fs

from urbanchange.llm import queries, warc

SF_DIR = "/root/testdata/sf0.001"


def expected(pages, least=0):
    first, out = {}, {}
    for page, html in sorted(pages):
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        head = first.setdefault(digest, page) if len(body) >= least else page
        out[page] = (len(body), digest, "response" if head == page else "revisit", None if head == page else head)
    return out


def test_query(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()]
    got = {r.page_id: tuple(r)[1:] for r in queries.op2_warc_archives(spark, SF_DIR).collect()}
    assert got == expected(pages)


def test_round_trip_rolls_and_repeats(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (1 + i % 3), "x") for i in range(90)]
    rows += [(500, "http://a\r\nX: y", None, "x"), (501, None, "", "x"), (502, "http://big", "é" * 300_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    sums = []
    for k, part in enumerate((3, 9)):
        folder = f"file://{tmp_path}/{k}"
        manifest = warc.write(pages.repartition(part), folder, min_bytes=10, shards=4, file_bytes=900).collect()
        assert sum(r.records for r in manifest) == len(rows) and len(manifest) > 4
        sums.append(sorted((r.file, r.sha1, r.bytes) for r in manifest))
        out = {r.page_id: r for r in warc.resolved(warc.read(spark, folder)).collect()}
        want = expected([(r[0], r[2]) for r in rows], 10)
        assert {int(p): (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for p, r in out.items()} == want
        assert out["502"].payload.decode() == "é" * 300_000 and out["501"].url is None
        assert out["500"].url == "http://a%0D%0AX: y"
    assert sums[0] == sums[1]  # the same files whatever the partitions of the input
    store, root = warc.opened(f"file://{tmp_path}/0")
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(root))]
    assert "_temporary" not in names
    some = sums[0][0][0]
    assert gzip.open(f"{tmp_path}/0/{some}").read().startswith(b"WARC/1.1\r\n")


def test_stray_files_do_not_count(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/x"
    warc.write(pages, folder)
    (tmp_path / "x" / "part-00099-00000.warc.gz").write_bytes(b"junk")
    assert warc.read(spark, folder).count() == 2


def test_null_ids_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "a"), (None, "u", "a"), (3, "u", "a"), (3, "u", "a")], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/n")
    got = sorted((r.record_type, r.page_id or "", r.refers_to or "") for r in warc.resolved(warc.read(spark, f"file://{tmp_path}/n")).collect())
    assert got == [("response", "3", ""), ("revisit", "", "3"), ("revisit", "", "3"), ("revisit", "3", "3")]
    warc.write(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0
