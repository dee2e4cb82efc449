"""Secret scan: base spans against plain patterns, and layers against known nestings."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import random
import re
import time
import tracemalloc
import urllib.parse
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from urbanchange.llm import queries, secrets

SF_DIR = "/root/testdata/sf0.001"
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
SECRET = "password = hunter22x"


def plain(text):
    text = text or ""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.op7_secret_layers(spark, SF_DIR).collect():
        spans = plain(docs[r.doc_id])
        listed = ["%s:%d:%d" % s for s in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(listed) <= set(r.spans.split(",")) | {""}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAkKiIpsword=: \"'_é日secrtonAKIA0123f", max_size=120))
def test_base_spans_of_any_text(text):
    assert secrets.scan_text(text.encode())[0] == plain(text)


b64 = lambda b: base64.b64encode(b).decode()


@pytest.mark.parametrize(
    "hidden",
    [
        urllib.parse.quote(SECRET),
        urllib.parse.quote(urllib.parse.quote(SECRET)),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "".join(f"&#{ord(c)};" for c in SECRET),
        b64(SECRET.encode()),
        b64(SECRET.encode()).rstrip("="),
        base64.urlsafe_b64encode(SECRET.encode() + b"???>>>").decode(),
        b64(gzip.compress(SECRET.encode())),
        b64(zlib.compress(SECRET.encode())),
        b64(bz2.compress(SECRET.encode())),
        urllib.parse.quote(b64(b64(SECRET.encode()).encode())),
        b64(gzip.compress(b64(urllib.parse.quote(SECRET).encode()).encode())),
        b64(gzip.compress(b"nothing here") + gzip.compress(SECRET.encode())),
        b64(gzip.compress(b"passw") + gzip.compress(b"ord = hunter22x")),
        b64(bz2.compress(b"nothing here") + bz2.compress(SECRET.encode())),
        base64.encodebytes(gzip.compress(bytes(range(256)) + SECRET.encode())).decode().strip(),
        base64.encodebytes(("x" * 50 + SECRET + "y" * 40).encode()).decode().strip().rstrip("="),
        b64(("Это обычный русский текст, а вот " + SECRET + " и дальше текст").encode()),
        "/a/" + b64(SECRET.encode()),
        "path/" + b64(SECRET.encode()),
        "xy/" + b64(gzip.compress(SECRET.encode())),
        b64(b"HEADER v1\n" + gzip.compress(SECRET.encode()) + b"after"),
        b64(b"HEADER v1\n" + zlib.compress(SECRET.encode())),
        b64(SECRET.encode("utf-16")),
        b64(("Größe " + SECRET).encode("utf-16-be")),
        "%25" * 3 + "2525" * 20 + "70" + "assword%2525253D%252525202hunter22x",
    ],
)
def test_layers(hidden):
    text = f"Größe {hidden} ende"
    base, every = secrets.scan_text(text.encode())
    assert base == plain(text)
    found = [s for s in every if s[0] == "assign"]
    assert found and all(6 <= a < b <= 6 + len(hidden) for _, a, b in found)


def test_escapes_map_to_their_place():
    text = "é x pass%77ord=abc%64efgh z"
    assert secrets.scan_text(text.encode()) == ([], [("assign", 4, 25)])


def test_nested_escapes_take_linear_time():
    def nested(n):
        text = "%" + "25" * n + "70assword = hunter22x"
        began = time.process_time()
        assert ("assign", 0, len(text)) in secrets.scan_text(text.encode())[1]
        return time.process_time() - began

    assert nested(500_000) < 20  # a text of 1 MB
    assert secrets.scan_text(b"%25" * 50)[1] == []
    assert secrets.scan_text(b"&#1114112; \\u{110000}" * 20)[1] == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="%2541\\ux&#;{}", max_size=40))
def test_escapes_undone_at_once_equal_rounds(text):
    layer = secrets.Layer(text.encode())
    once = secrets.undone_wholly(layer)
    steps = [layer]
    while (step := secrets.undone_once(steps[-1])) is not None:
        steps.append(step)
    assert once.data == steps[-1].data
    for i in range(len(once.data)):
        assert once.span(i, i + 1) == steps[-1].span(i, i + 1)


def test_large_content_is_scanned_in_windows(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 4000)
    monkeypatch.setattr(secrets, "OVERLAP", 200)
    monkeypatch.setattr(secrets, "PIECE", 300)
    rng = random.Random(3)
    for at in (0, 3990, 4000, 7795, 30_000):
        content = bytearray(rng.choices(b"abc \n", k=60_000))
        content[at : at + len(SECRET)] = SECRET.encode()
        for pack in (gzip.compress, bz2.compress):
            hidden = b64(pack(bytes(content)))
            found = [s for s in secrets.scan_text(f"x {hidden} y".encode())[1] if s[0] == "assign"]
            assert found and all(2 <= a < b <= 2 + len(hidden) for _, a, b in found)


def test_bombs_are_unpacked_in_bounded_memory():
    bomb = b64(gzip.compress(b"z" * (80 << 20) + SECRET.encode()))
    tracemalloc.start()
    every = secrets.scan_text(bomb.encode())[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [s[0] for s in every] == ["assign"] and peak < 10 * secrets.WINDOW


def test_edges(spark):
    key = "AKIA" + "Q" * 16
    rows = [(1, None, 1), (2, "", 1), (3, "word " * 200_000 + key, 1), (3, key, 1), (3, key, 1), (None, SECRET + " " + SECRET, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    out = secrets.scan(docs)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "base_spans", "spans"] and len(got) == 6
    assert [tuple(s) for r in got if r.text and len(r.text) > 100 for s in r.spans] == [("access", 1_000_000, 1_000_020)]
    assert [len(r.spans) for r in got if r.doc_id is None] == [2]
    assert secrets.scan(docs.limit(0)).count() == 0
