"""Secret scan with a recursive decoding worklist.

The text is the first layer. Every layer is searched for secrets and unwrapped further: URL and
Unicode escapes are undone in the whole layer; base64 runs (also wrapped over lines, and at each of
the four alignments), compressed data (all members, wherever they begin) and two-byte text become
layers of their own. The worklist ends when no layer gives a new one; a layer whose bytes and place
were seen before is not taken up again, so cycles end. A layer knows the stretch of the layer below
that each byte came from, as a rule and not as an array where it can, and a find is mapped down to
code points of the original text.

No layer is given up. Escapes nested more than `ROUNDS` deep are undone to their innermost text in
one step, so a text takes time in proportion to its length. Content that unpacks to more than
`WINDOW` bytes is scanned in windows that overlap by `OVERLAP`; only a stretch longer than the overlap
is scanned in two parts. Layers are taken depth first, so what is held is one window per depth.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanchange.llm.common import by_value, free_name, small_batches

by_value(__name__)

WINDOW, OVERLAP = 16 << 20, 1 << 20  # bytes of unpacked content scanned at a time
PIECE = 1 << 20  # bytes unpacked at a time
ROUNDS = 8  # nested escapes undone one by one
KINDS = ("assign", "access", "hex")
NAMES = ["base_spans", "spans"]

# What counts as a secret; applied to lower-cased bytes where case doesn't matter.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
WORDS = (b"passw", b"secret", b"token", b"api")
HEXADECIMAL = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))

ESCAPE = re.compile(
    rb"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})"
    rb"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
LAST_ESCAPE = re.compile(rb"(?:" + ESCAPE.pattern + rb")\Z")
ESCAPE_ENDS = frozenset(b"0123456789abcdefABCDEF;}")
LONGEST_ESCAPE = 10
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}")
NEXT_LINE = re.compile(rb"\r?\n[ \t]*([A-Za-z0-9+/_-]+)")
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|x[\x01\x5e\x9c\xda]")
PACKED_MARKS = (b"\x1f\x8b\x08", b"BZh", b"x\x01", b"x^", b"x\x9c", b"x\xda")
TWO_BYTE = re.compile(rb"\x00?(?:[\x01-\x7f]\x00){7,}[\x01-\x7f]?")


def finds(data: bytes) -> list[tuple[str, int, int]]:
    """Kind, start and end (bytes) of the secrets that stand openly in ``data``."""
    out = []
    low = data.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(low) if len(m[2]) >= 6]
    if b"AKIA" in data:
        out += [("access", *m.span()) for m in ACCESS.finditer(data) if len(m[0]) >= 20]
    if b"h" * 24 in data.translate(HEXADECIMAL):
        out += [("hex", *m.span()) for m in HEX.finditer(data)]
    return out


class Layer:
    """Decoded bytes; byte ``i`` came from ``low(i)`` up to ``high(i)`` of the layer ``under`` it.

    ``rounds`` counts the steps of undoing escapes that led here without any other in between.
    """

    def __init__(
        self,
        data: bytes,
        under: Layer | None = None,
        low: Callable[[int], int] | None = None,
        high: Callable[[int], int] | None = None,
        rounds: int = 0,
    ):
        self.data, self.under, self.low, self.high, self.rounds = data, under, low, high, rounds

    def span(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.under is not None:
            start, end, layer = layer.low(start), layer.high(end - 1), layer.under
        return start, end


def meant(m: re.Match) -> bytes | None:
    """The bytes an escape stands for; None where there is no such code point."""
    kind = m.lastindex
    value = int(m[kind], 10 if kind == 6 else 16)
    if kind == 1:
        return bytes([value])
    return chr(value).encode("utf-8", "surrogatepass") if value < 0x110000 else None


def undone_once(layer: Layer) -> Layer | None:
    """The layer with each escape replaced by what it stands for."""
    data = layer.data
    out, done = bytearray(), 0
    begins, stops, starts, ends = (array("q") for _ in range(4))  # of the new bytes, and of the escapes
    for m in ESCAPE.finditer(data):
        new = meant(m)
        if new is None:
            continue
        out += data[done : m.start()]
        begins.append(len(out))
        out += new
        stops.append(len(out))
        starts.append(m.start())
        ends.append(m.end())
        done = m.end()
    if not begins:
        return None
    out += data[done:]

    def place(i: int, last: bool) -> int:
        k = bisect_right(begins, i) - 1
        if k < 0:
            return i + last
        if i < stops[k]:
            return ends[k] if last else starts[k]
        return ends[k] + i - stops[k] + last

    return Layer(bytes(out), layer, lambda i: place(i, False), lambda i: place(i, True), layer.rounds + 1)


def undone_wholly(layer: Layer) -> Layer:
    """The layer with escapes undone until there are none, also those that others bring up.

    An escape is undone as soon as its last byte is there. No two escapes can overlap, so the
    order in which they are undone makes no difference.
    """
    out, lows, highs = bytearray(), array("I"), array("I")
    for at, byte in enumerate(layer.data):
        out.append(byte)
        lows.append(at)
        highs.append(at + 1)
        while out[-1] in ESCAPE_ENDS:
            m = LAST_ESCAPE.search(out[-LONGEST_ESCAPE:])
            new = meant(m) if m else None
            if new is None:
                break
            size = len(m[0])
            low, high = lows[-size], highs[-1]
            del out[-size:], lows[-size:], highs[-size:]
            out += new
            lows.extend([low] * len(new))
            highs.extend([high] * len(new))
    return Layer(bytes(out), layer, lows.__getitem__, highs.__getitem__)


def lines_of_base64(data: bytes) -> Iterator[list[tuple[int, int]]]:
    """Places of runs in the base64 alphabet; of a wrapped one the lines, and each line by itself."""
    at = 0
    while m := BASE64.search(data, at):
        lines, width = [m.span()], len(m[0])
        while len(m[m.lastindex or 0]) == width and (m := NEXT_LINE.match(data, lines[-1][1])) and len(m[1]) <= width:
            lines.append(m.span(1))
        at = lines[-1][1]
        yield from ([line] for line in lines)
        if len(lines) > 1:
            yield lines
            if len(lines) > 2:
                yield lines[:-1]  # the last may be a word of what follows


def base64_layers(layer: Layer) -> Iterator[Layer]:
    data = layer.data
    for lines in lines_of_base64(data):
        run = b"".join(data[a:b] for a, b in lines)
        begins = [0, *accumulate(b - a for a, b in lines[:-1])]
        web = b"-_" if b"-" in run or b"_" in run else None

        def place(c: int, lines=lines, begins=begins) -> int:
            k = bisect_right(begins, c) - 1
            return lines[k][0] + c - begins[k]

        for skip in range(min(4, len(run))):
            part = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
            inner = base64.b64decode(part + b"=" * (-len(part) % 4), web)
            if inner:
                yield Layer(
                    inner,
                    layer,
                    lambda i, skip=skip, place=place: place(skip + i * 8 // 6),
                    lambda i, skip=skip, place=place: place(skip + (i * 8 + 7) // 6) + 1,
                )


def unpacked(data: bytes, start: int) -> Iterator[tuple[bytes, int, bool]]:
    """Pieces of the content of the members from ``start`` on that follow each other at once.

    With each piece, where the data read so far end and whether a member ends there. Damaged data
    give what was unpacked before the damage.
    """
    at, tail = start, b""
    try:
        while at < len(data) and (at == start or PACKED.match(data, at)):
            is_bz = data[at : at + 3] == b"BZh"
            unpacker = bz2.BZ2Decompressor() if is_bz else zlib.decompressobj(47)
            while not unpacker.eof and at < len(data):
                tail = data[at : at + PIECE]
                at += len(tail)
                while not unpacker.eof:
                    out = unpacker.decompress(tail, PIECE)
                    tail = b"" if is_bz else unpacker.unconsumed_tail
                    if unpacker.eof:
                        at -= len(unpacker.unused_data)
                    yield out, at, unpacker.eof
                    if (unpacker.needs_input if is_bz else not tail) and len(out) < PIECE:
                        break
    except (OSError, ValueError, EOFError, zlib.error):
        return


def packed_layers(layer: Layer) -> Iterator[Layer]:
    """The content of compressed data anywhere in the layer; each window maps to all of the data."""
    data = layer.data
    if not any(mark in data for mark in PACKED_MARKS):
        return
    at = 0
    while m := PACKED.search(data, at):
        start, at = m.start(), m.start() + 1
        size, end, clean = 0, start, False
        for piece, read, ended in unpacked(data, start):
            size, clean, end = size + len(piece), clean or ended, read
        # two bytes are no proof of zlib data, so inside a layer they must unpack to their end
        if not size or not (clean or start == 0 or data[start] != 0x78):
            continue
        at = max(at, end) if clean else at
        window = bytearray()
        for piece, _, _ in unpacked(data, start):
            window += piece
            if len(window) >= WINDOW:
                yield Layer(bytes(window), layer, lambda i, a=start: a, lambda i, b=end: b)
                del window[:-OVERLAP]
        yield Layer(bytes(window), layer, lambda i, a=start: a, lambda i, b=end: b)


def two_byte_layers(layer: Layer) -> Iterator[Layer]:
    """Stretches of ASCII in UTF-16 of either order."""
    if b"\x00" not in layer.data:
        return
    for m in TWO_BYTE.finditer(layer.data):
        start = m.start() + (m[0][0] == 0)
        yield Layer(
            m[0].replace(b"\x00", b""), layer, lambda i, a=start: a + 2 * i, lambda i, a=start: a + 2 * i + 1
        )


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers that lie right inside this one."""
    data = layer.data
    if b"%" in data or b"\\" in data or b"&#" in data:
        inner = undone_once(layer)
        if inner is not None:
            yield inner if inner.rounds <= ROUNDS else undone_wholly(layer)
    yield from base64_layers(layer)
    yield from packed_layers(layer)
    yield from two_byte_layers(layer)


def scan_text(utf8: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, in code points, by start and kind."""
    base = set(finds(utf8))
    every = set(base)
    seen, work = {hashlib.sha256(utf8).digest()}, [unwrapped(Layer(utf8))]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        if not inner.data:
            continue
        mark = hashlib.sha256(inner.data).digest() + b"%d-%d" % inner.span(0, len(inner.data))
        if mark in seen:
            continue
        seen.add(mark)
        every.update((kind, *inner.span(a, b)) for kind, a, b in finds(inner.data))
        work.append(unwrapped(inner))
    points = None
    if every and not utf8.isascii():
        points = np.r_[0, np.cumsum((np.frombuffer(utf8, np.uint8) & 0xC0) != 0x80)]

    def listed(spans: set) -> list[tuple[str, int, int]]:
        placed = [(k, a, b) if points is None else (k, int(points[a]), int(points[b])) for k, a, b in spans]
        return sorted(placed, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    return listed(base), listed(every)


def scan(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``base_spans`` and ``spans``.

    Base spans stand openly in the text; ``spans`` are these and what decoding brought up, as
    (kind, start, end) in code points, end exclusive, by start and kind. A null text is empty
    and has none. Rows are judged one by one, so ids may be null or repeat; columns of the new
    names are replaced; an empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NAMES]
    raw = free_name(docs, "_utf8")
    fed = docs.select(*keep, F.col(text).cast("binary").alias(raw))
    spans = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
    schema = T.StructType([*fed.drop(raw).schema, *(T.StructField(n, spans) for n in NAMES)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [scan_text(t.as_py() or b"") for t in batch.column(raw)]
            made = [
                pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f[n]] for f in found], kind) for n in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, [*keep, *NAMES])

    return fed.mapInArrow(run, schema)


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
