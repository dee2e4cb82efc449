"""SimHash near-duplicates by a self-join of the binary trie of fingerprints; exact ones by shingle sets.

The traversal takes pairs of trie nodes together, splits both at their next bit, adds one to the
pair's differing bits where the children differ, and drops the pair when the sum exceeds the
error budget. A node is a range of the sorted codes; a pair of single codes is settled at once.

What makes it a Spark job: two codes that differ in at most ``k`` bits agree wholly in one of
``k + 1`` slices. So the codes are laid out once per slice, with that slice first, and hashed by
(layout, first slice) to tasks; each task starts its traversal below the slice, with many such
roots at once. A block with more than `BLOCK` codes is laid out again by slices of its remaining
bits, until ``2 ** remaining`` or the count is small enough; no block, however similar its codes,
comes to one task whole.

Words are what bytes 9 to 13 and 32 separate; A-Z count as a-z. A shingle is ``shingle`` words
joined by blanks, repeats included; fewer words make one shingle. Null and wordless texts have
the fingerprint zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.functions.skew import materialize, salted_join
from urbanchange.llm.common import FOLDERS, by_value, components, free_name, parts, remove, settled, small_batches, written

by_value(__name__)

BLOCK = 1 << 16  # codes a block may have
FLUSH = 1 << 19  # codes a task takes through one traversal
FRONT = 1 << 20  # node pairs expanded at once
SEED = 42


# -- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a text."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    return np.fromiter(hashes, np.uint64, len(words) - shingle + 1)


def remix(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th independent form of the hashes; the first is the hash itself."""
    if k == 0:
        return hashes
    z = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit fingerprints: a bit is set when it is in over half of the hashes."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    ones = np.zeros(64 * words, np.int64)
    step = max(256, (1 << 15) // words)
    for start in range(0, len(hashes), step):
        some = hashes[start : start + step]
        mixed = np.stack([remix(some, k) for k in range(words)], axis=1).astype(">u8")
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(some), 8 * words), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32 if len(some) > 65535 else np.uint16)
    packed = np.packbits(2 * ones > len(hashes))
    return packed.view(">u8").astype(np.uint64)


def with_sketches(docs: DataFrame, text: str, name: str, shingle: int, words: int) -> DataFrame:
    """All columns of ``docs`` and the array ``name`` of ``words`` fingerprints."""
    raw = free_name(docs, "_utf8")
    fields = docs.withColumn(name, F.array(F.lit(0).cast("long"))).schema
    fed = docs.withColumn(raw, F.col(text).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(raw)
            rows = [sketch(shingle_hashes(t.as_py(), shingle), words) for t in texts]
            flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * words
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
            kept = [c for c in batch.schema.names if c != raw]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [made], kept + [name])

    return fed.mapInArrow(run, fields)


# -- the trie join --------------------------------------------------------------------------


def traverse(codes: np.ndarray, bits: int, exact: int, budget: int) -> Iterator[tuple]:
    """Pairs of places in the sorted distinct ``codes`` whose codes differ in few enough bits.

    Codes stand in the upper ``bits`` of 64. Only pairs that agree in the first ``exact`` bits
    are sought; each range of codes that agree so far is a root.
    """
    heads = codes >> np.uint64(64 - exact) if exact else np.zeros(len(codes), np.uint64)
    lo = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]]) if len(codes) else np.empty(0, int)
    hi = np.r_[lo[1:], len(codes)] if len(codes) else lo
    big = hi - lo > 1
    start = np.stack([lo[big], hi[big], lo[big], hi[big], np.zeros(big.sum(), int)])
    stack = [(exact, start)]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > FRONT:
            half = pairs.shape[1] // 2
            stack += [(depth, pairs[:, half:]), (depth, pairs[:, :half])]
            continue
        if not pairs.shape[1] or depth >= bits:
            continue
        alo, ahi, blo, bhi, errors = pairs
        own = alo == blo
        shift = np.uint64(63 - depth)
        cut = (codes >> shift | np.uint64(1)) << shift  # where the upper child of a node begins

        def split(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return np.clip(np.searchsorted(codes, cut[low]), low, high)

        amid = split(alo, ahi)
        bmid = np.where(own, amid, split(blo, bhi))
        children = np.concatenate(
            [
                np.stack([alo, amid, blo, bmid, errors]),
                np.stack([amid, ahi, bmid, bhi, errors]),
                np.stack([alo, amid, bmid, bhi, errors + 1]),
                np.stack([amid, ahi, blo, bmid, errors + 1])[:, ~own],
            ],
            axis=1,
        )
        alo, ahi, blo, bhi, errors = children
        single = (ahi - alo == 1) & (bhi - blo == 1)
        alive = (ahi > alo) & (bhi > blo) & (errors <= budget) & ~(single & (alo == blo))
        settled = alive & single
        i, j = alo[settled], blo[settled]
        near = np.bitwise_count(codes[i] ^ codes[j]) <= budget
        if near.any():
            yield i[near], j[near]
        stack.append((depth + 1, children[:, alive & ~single]))


def roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    i = parent[i]
    while True:
        up = parent[i]
        if (up == i).all():
            return i
        i = up


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of each pair; the least place is the root of a set."""
    while True:
        i, j = roots(parent, i), roots(parent, j)
        apart = i != j
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def layouts(rows: DataFrame, bits: int, exact: int, budget: int) -> tuple[DataFrame, int]:
    """Every row once per slice of the bits after ``exact``, with that slice moved first."""
    rest = bits - exact
    width = max(1, rest // (budget + 1))
    base = 64 - bits
    ones = (1 << rest) - 1
    low = F.shiftrightunsigned("code", base).bitwiseAND(_signed(ones))
    kept = F.col("code").bitwiseAND(_signed(((1 << 64) - 1) ^ (ones << base)))
    moved = []
    for k in range(min(budget + 1, rest)):
        turn = k * width
        turned = low if not turn else F.shiftleft(low, turn).bitwiseOR(
            F.shiftrightunsigned(low, rest - turn)
        ).bitwiseAND(_signed(ones))
        code = kept.bitwiseOR(F.shiftleft(turned, base))
        moved.append(F.struct((F.col("layout") * (budget + 1) + k).alias("layout"), code.alias("code")))
    others = [c for c in rows.columns if c not in ("layout", "code")]
    out = rows.select(*others, F.explode(F.array(*moved)).alias("_to"))
    return out.select("_to.layout", "_to.code", *others), exact + width


def _signed(value: int):
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value)


def trie_join(rows: DataFrame, bits: int, budget: int, links: bool = False) -> DataFrame:
    """Links (``a``, ``b``) between rows (``layout``, ``code``, ``id``) of like first layout.

    Codes must be distinct within a layout. With ``links`` every link is returned, perhaps
    several times; else a forest with the same components, which is at most as long as the rows
    however dense the links are.
    """
    level, exact, found = rows, 0, None
    while True:
        level, exact = layouts(level, bits, exact, budget)
        head = F.shiftrightunsigned("code", 64 - exact)
        full = level.groupBy("layout", head.alias("_head")).agg(F.count(F.lit(1)).alias("_n"))
        full = full.where(F.col("_n") > BLOCK) if bits - exact > 16 else None
        full = materialize(full) if full is not None else None
        if full is None or full.isEmpty():
            made = _blocks(level, bits, exact, budget, links)
            return made if found is None else found.union(made)
        on = ["layout", "_head"]
        level = level.withColumn("_head", head)
        made = _blocks(level.join(full, on, "left_anti").drop("_head"), bits, exact, budget, links)
        found = made if found is None else found.union(made)
        level = level.join(full, on, "left_semi").drop("_head")


def _blocks(level: DataFrame, bits: int, exact: int, budget: int, links: bool) -> DataFrame:
    names = ["layout", "code", "id"]

    def settle(layout: np.ndarray, code: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for each in np.unique(layout):
            of = np.flatnonzero(layout == each)
            of = of[np.argsort(code[of], kind="stable")]
            codes, own = code[of], ids[of]
            parent = np.arange(len(codes))
            for i, j in traverse(codes, bits, exact, budget):
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j])], ["a", "b"])
                else:
                    unite(parent, i, j)
            if not links:
                top = roots(parent, np.arange(len(codes)))
                tied = np.flatnonzero(top != np.arange(len(codes)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[tied]), pa.array(own[top[tied]])], ["a", "b"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in names]
        size = 0
        for batch in batches:
            for k, c in enumerate(names):
                held[k].append(batch.column(c).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size < FLUSH:
                continue
            layout, code, ids = (np.concatenate(x) for x in held)
            block = code.view(np.uint64) >> np.uint64(64 - exact)
            last = np.flatnonzero((layout != layout[-1]) | (block != block[-1]))
            end = last[-1] + 1 if len(last) else 0  # the last block may go on
            if end:
                yield from settle(layout[:end], code[:end].view(np.uint64), ids[:end])
            held = [[x[end:]] for x in (layout, code, ids)]
            size = len(layout) - end
        if size:
            layout, code, ids = (np.concatenate(x) for x in held)
            yield from settle(layout, code.view(np.uint64), ids)

    n = parts(level)
    head = F.shiftrightunsigned("code", 64 - exact)
    dealt = level.select(*names).repartition(n, "layout", head).sortWithinPartitions("layout", head)
    return dealt.mapInArrow(run, "a long, b long")


# -- groups ---------------------------------------------------------------------------------


def hamming_groups(
    docs: DataFrame, id_col: str, text: str, shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """Every row's ``fingerprint`` (64 bits) and ``component_id``: the least id it reaches.

    Fingerprints link at ``max_bits`` or fewer differing bits. Only distinct fingerprints enter
    the trie join, so copies cost one grouped minimum. All rows stay: repeated ids give repeated
    rows; a null id keeps its row and is the component's id only if the component has no other.
    An empty table gives an empty result. Other columns are left aside, so none can clash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = with_sketches(rows, "text", "s", shingle, 1)
    rows = written(rows.select("id", F.col("s")[0].alias("fingerprint")))
    least = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    least = materialize(least)
    codes = least.select(
        F.lit(0).cast("long").alias("layout"), F.col("fingerprint").alias("code"), F.col("fingerprint").alias("id")
    )
    tree = components(trie_join(codes, 64, max_bits))
    named = least.join(tree, least.fingerprint == tree.node, "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    named = materialize(named)
    tops = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_code = salted_join(named, tops, ["component"]).select("fingerprint", "component_id")
    return rows.join(by_code, "fingerprint").select(
        F.col("id").alias(id_col), "fingerprint", "component_id"
    )


def similar_groups(
    docs: DataFrame, id_col: str, text: str, similarity: float = 0.8, shingle: int = 5, max_bits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates at a shingle similarity: ``docs`` with a row key, and row key -> group key.

    Two texts are near when the Jaccard similarity of their shingle sets is ``similarity`` or
    more; groups are the components of that relation. Nothing is estimated. Shingles have one
    order, common ones last. Of a set of ``n`` shingles the first ``n - ceil(similarity * n) + 1``
    are posted: near sets share one of these at least. Sets of one list are candidates unless
    their sizes, or their places in the list, leave too few shingles to share; each candidate
    pair is decided by its whole sets. Equal sets collapse first. Each set is compared with the
    leaders of its lists, which joins large groups in few pairs, and then with all sets of its
    lists that it is not joined with yet.

    With ``max_bits`` texts whose fingerprints differ in that many bits or fewer are near as well:
    the groups of `hamming_groups` come first, and the sets are compared across them.

    The group key is the row key of the member with the least id (null ids last); rows without
    words are left alone: they have nothing in common.
    """
    key = free_name(docs, "_row")
    rows = settled(docs.withColumn(key, F.monotonically_increasing_id()))
    texts = rows.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("t"))
    facts = settled(_prefixes(texts, shingle, similarity))
    named = rows.select(F.col(key).alias("id"), F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col(key).alias("r")).alias("who"))
    sets = settled(named.join(facts.select("id", "digest"), "id"))
    nodes = settled(sets.groupBy("digest").agg(F.min("who").alias("who")).select(F.col("who.r").alias("id"), "digest", "who"))
    single = facts.join(nodes.select("id"), "id", "left_semi").select("id", "n", "prefix", *MARK_NAMES)
    tokens = single.select(F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token")
    shared = settled(shared)
    lists = settled(_posted(single, _bitmap(shared.select(_bit("token")))).join(shared, "token"))
    near = _decided(texts, _led(lists, similarity), shingle, similarity)
    if max_bits is not None:
        near = near.union(_hamming_links(texts, nodes, max_bits))
    rest = _across(lists, settled(components(near, settled)), similarity)
    tree = components(near.union(_decided(texts, rest, shingle, similarity)), settled)
    placed = settled(
        nodes.join(tree, nodes.id == tree.node, "left")
        .select("digest", "who", F.coalesce("component", "id").alias("component"))
    )
    tops = placed.groupBy("component").agg(F.min("who").alias("top"))
    by_set = salted_join(placed, tops, ["component"]).select("digest", F.col("top.r").alias("group"))
    groups = sets.join(by_set, "digest").select(F.col("id").alias(key), "group")
    return rows, groups


def _hamming_links(texts: DataFrame, nodes: DataFrame, max_bits: int) -> DataFrame:
    """A link from each node to the least node of its component of fingerprints. Texts without
    words, which share the fingerprint zero, have no node and link nothing."""
    worded = texts.where(F.col("t").cast("string").rlike("[^\\x20\\x09-\\x0D]"))
    found = hamming_groups(worded, "id", "t", max_bits=max_bits).select("id", F.col("component_id").alias("c"))
    found = settled(found.join(nodes.select("id"), "id", "left_semi"))
    least = found.groupBy("c").agg(F.min("id").alias("least"))
    linked = salted_join(found, least, ["c"]).where("id <> least")
    return settled(linked.select(F.col("least").alias("a"), F.col("id").alias("b")))


HOT_TOKENS = 100_000  # shingles whose counts are carried along to order sets by


def _prefixes(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Per text with words: digest and size ``n`` of its shingle set, and the shingles to post.

    Counts of the common shingles come from one text in 16. They only make the order, and any
    order gives the same pairs; this one keeps common shingles from being posted.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column("t")]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0).mapInArrow(tokens, "token long")
    counts = some.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 4")
    hot = counts.orderBy(F.desc("m"), "token").limit(HOT_TOKENS).toArrow()
    known = hot.column("token").to_numpy().astype(np.int64).view(np.uint64)
    often = hot.column("m").to_numpy().astype(np.int64)[np.argsort(known)]
    known = np.sort(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            made = []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t")):
                one = np.unique(shingle_hashes(t.as_py(), shingle))
                if not len(one):
                    continue
                common = np.zeros(len(one), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, one), len(known) - 1)
                    common = np.where(known[at] == one, often[at], 0)
                least = int(np.ceil(similarity * len(one) - 1e-9))
                first = one[np.lexsort((one, common))][: len(one) - least + 1]
                made.append((i, xxhash.xxh3_128_digest(one.tobytes()), len(one), first.view(np.int64), _marks(first)))
            ids, digests, sizes, posted, marks = zip(*made) if made else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int32()), pa.array(posted, pa.list_(pa.int64())),
                    *[pa.array([m[k] for m in marks], pa.int64()) for k in range(MARKS)],
                ],
                ["id", "digest", "n", "prefix", *MARK_NAMES],
            )

    return texts.mapInArrow(run, f"id long, digest binary, n int, prefix array<long>, {MARK_TYPES}")


MARKS = 4  # numbers of 64 bits
MARK_NAMES = [f"m{k}" for k in range(MARKS)]
MARK_TYPES = ", ".join(f"{m} long" for m in MARK_NAMES)


def _marks(posted: np.ndarray) -> list[int]:
    """A bit for each posted shingle, one of 256."""
    bits = np.zeros(64 * MARKS, np.uint8)
    bits[(posted >> np.uint64(40)) % np.uint64(64 * MARKS)] = 1
    return np.packbits(bits).view(np.int64).tolist()


BITS = 1 << 23  # of a bitmap of keys: 1 MB


def _bit(name: str):
    """The place of a key in a bitmap, all of its bits mixed; `_among` has the same for arrays."""
    x = F.col(name)
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    x = x.bitwiseXOR(F.shiftleft(x, 17))
    return F.shiftrightunsigned(x, 20).bitwiseAND(F.lit(BITS - 1)).alias("bit")


def _bitmap(bits: DataFrame) -> np.ndarray:
    """The bits that are there. It only saves shuffling what no join will want."""
    page = bits.groupBy(F.shiftright("bit", 15).alias("page")).agg(
        F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("b")
    )
    made = np.zeros((BITS >> 15, 4096), np.uint8)
    for row in page.collect():  # at most 256 rows of 4 kB
        made[row["page"]] = np.frombuffer(bytes(row["b"]), np.uint8)
    return made.reshape(-1)


def _among(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    x = keys.view(np.uint64)
    for left, by in ((True, 13), (False, 7), (True, 17)):
        x = x ^ (x << np.uint64(by) if left else x >> np.uint64(by))
    bit = (x >> np.uint64(20)).astype(np.int64) & (BITS - 1)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _posted(single: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """A row for each posted shingle that the bitmap has, with its place ``at`` in the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096):
            prefix = batch.column("prefix")
            sizes = prefix.value_lengths().to_numpy()
            token = prefix.flatten().to_numpy()
            at = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = np.repeat(np.arange(len(sizes)), sizes)
            some = _among(bitmap, token)
            own = own[some]
            ids, n, *marks = (batch.column(c).to_numpy()[own] for c in ("id", "n", *MARK_NAMES))
            columns = [ids, n, at[some].astype(np.int32), sizes[own].astype(np.int32), token[some], *marks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], ["id", "n", "at", "posted", "token", *MARK_NAMES]
            )

    return single.mapInArrow(run, f"id long, n int, at int, posted int, token long, {MARK_TYPES}")


FACTS = ["n", "at", "posted", *MARK_NAMES]  # what a list knows of a set besides its id


def _may_be_near(other: str, similarity: float):
    """Whether two sets of a list, the other's facts under names with a prefix, may be near.

    They can't if their sizes differ too much, if too few shingles are left from their places in
    the list on, or if they share too few posted shingles: of two sets one is posted up to an
    earlier shingle of the order, and what they share is posted by both or lies beyond that set's
    posted ones. A mark that only one of two sets has is a posted shingle that the other lacks.
    """
    mine, its = (lambda c: F.col(c)), (lambda c: F.col(other + c))
    left = F.least(mine("n") - mine("at"), its("n") - its("at"))
    need = (mine("n") + its("n")) * (similarity / (1 + similarity)) - 1e-6
    sizes = F.least(mine("n"), its("n")) >= F.greatest(mine("n"), its("n")) * similarity - 1e-6
    lacks = lambda a, b: sum(F.bit_count(a(m).bitwiseAND(F.bitwise_not(b(m)))) for m in MARK_NAMES)
    common = F.least(mine("posted") - lacks(mine, its), its("posted") - lacks(its, mine))
    beyond = F.greatest(mine("n") - mine("posted"), its("n") - its("posted"))
    return sizes & (left >= need) & (common + beyond >= need)


def _leaders(lists: DataFrame) -> DataFrame:
    """The set of each list with the least hash, which tends to lead the neighbouring lists too."""
    lead = lists.groupBy("token").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id", *FACTS)).alias("x"))
    return lead.select("token", *[F.col(f"x.{c}").alias(f"lead_{c}") for c in ("id", *FACTS)])


def _led(lists: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs of each set with the leader of each of its lists."""
    led = lists.join(_leaders(lists), "token").where("id <> lead_id").where(_may_be_near("lead_", similarity))
    return led.select(F.least("id", "lead_id").alias("a"), F.greatest("id", "lead_id").alias("b")).distinct()


def _across(lists: DataFrame, tree: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs of one list that the tree does not join yet, without those of its leader.

    One side of each pair is outside the component of the list's leader, so a large group that
    is joined already costs nothing.
    """
    known = lists.join(tree, lists.id == tree.node, "left")
    known = known.select("token", "id", *FACTS, F.coalesce("component", "id").alias("c"))
    lead = F.min(F.struct(F.xxhash64("id").alias("h"), "id", "c"))
    leaders = known.groupBy("token").agg(lead.alias("x"), F.min("c").alias("low"), F.max("c").alias("high"))
    leaders = leaders.where("low < high").select("token", F.col("x.id").alias("lead"), F.col("x.c").alias("lead_c"))
    known = settled(known.join(leaders, "token").where("id <> lead"))
    outside = known.where("c <> lead_c").select("token", *[F.col(c).alias(f"o_{c}") for c in ("id", *FACTS, "c")])
    once = (F.col("c") == F.col("lead_c")) | (F.col("id") < F.col("o_id"))
    pairs = outside.join(known, "token").where("c <> o_c").where(once).where(_may_be_near("o_", similarity))
    return pairs.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()


SLICES = 4  # of the hashes; candidate pairs are first held against one of these


def _sets(texts: DataFrame, pairs: DataFrame, shingle: int, slices: int) -> DataFrame:
    """Shingle sets of the texts that occur in ``pairs``: ``id``, size ``n`` and hashes ``s``,
    only those of one slice of the hashes if there are several."""
    wanted = _bitmap(pairs.select(_bit("a")).union(pairs.select(_bit("b"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            batch = batch.filter(pa.array(_among(wanted, batch.column("id").to_numpy())))
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column("t")]
            sizes = pa.array(map(len, sets), pa.int32())
            some = [one[one % np.uint64(slices) == 0].view(np.int64) for one in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, pa.array(some, pa.list_(pa.int64()))], ["id", "n", "s"])

    return settled(texts.mapInArrow(run, "id long, n int, s array<long>"))


def _decided(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose whole shingle sets are near enough.

    Most candidates share a passage and little else. One slice of the hashes shows that: what two
    sets share is at most what they share of the slice and all that they have beyond it. Only
    pairs that this leaves a chance have their whole sets shuffled and compared.
    """
    before = len(FOLDERS)
    pairs = settled(pairs)
    for slices in (SLICES, 1):
        sets = _sets(texts, pairs, shingle, slices)
        left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
        right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
        beyond = F.least(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb"))
        most = F.size(F.array_intersect("sa", "sb")) + beyond
        near = most * (1 + similarity) >= (F.col("na") + F.col("nb")) * similarity - 1e-6
        pairs = settled(pairs.join(left, "a").join(right, "b").where(near).select("a", "b"))
        for path in FOLDERS[before:-1]:  # all but these pairs
            remove(texts.sparkSession, path)
        before = len(FOLDERS) - 1
    return pairs


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8, max_bits: int | None = None
) -> DataFrame:
    """One document of each group of `similar_groups`: the one with the least id.

    All columns stay. Of repeated rows one stays; null ids come after all others; rows whose
    text is null or has no word are kept. An empty table stays empty.
    """
    rows, groups = similar_groups(docs, id_col, text, similarity, max_bits=max_bits)
    key = next(c for c in rows.columns if c not in docs.columns)
    losers = groups.where(F.col("group") != F.col(key)).select(key)
    return rows.join(losers, key, "left_anti").select(*docs.columns)
