"""Operator 3: n-gram Jaccard join with adaptive multi-match prefixes.

Documents with the same shingle set are folded into a class first, kept by its
least document; classes are joined, and copies are never paired.

All shingles are ordered by rarity (the number of blocks of documents that have
them, then their hash). Two sets with Jaccard similarity t or more share at
least l shingles among the first n - ceil(t n) + l of either, for every l. A
document whose prefix would bring many candidates takes a longer prefix and a
larger l; a pair needs the smaller l of the two. Shingles that no other document
of a size near enough has come first and never bring candidates, so what is
compared are documents most of whose shingles such others have too. (A common
shingle of two similar documents is never of this kind, so all that they share
stands in one order.)

Links are wanted up to components. So each prefix shingle first proposes two
of its documents to all others that have it; after verification,
pairs are only formed within a shingle where several components are left. Large
groups of near copies thus cost a few comparisons a member. Every link between
different components is verified on the whole sets, so none is lost.

A null id is one id, smaller than all others. Null texts and texts without words have empty sets and are linked with nothing; rows
that repeat a document are copies. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import textkit as tk
from .anchors import KEY_BITS, bucket_of, by_bucket, rows, sql_schema
from .components import components
from .shared import table

SIGNS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])
KEYS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())])
RANKS = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("ranks", pa.binary())])
#: Estimated candidates of a prefix up to which l stays 1, 2, 3.
COSTS = (32, 256, 2048)
#: Bits of a shingle's hash; the others number the texts that are sorted together.
SET_BITS = np.uint64(48)
TEXTS = 1 << 16
#: Set elements compared at a time.
ELEMENTS = 1 << 20


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text, and the offsets of texts.

    Lower-cases A-Z. A text of fewer words has its whole sequence as one shingle.
    A shingle is its hash's upper 48 bits; a text's number and a shingle make one
    64-bit number, so that a single sort orders the sets of many texts.
    """
    buf = tk.LOWER[buf]
    s, e, woff = tk.words(buf, offs, tk.NOT_SPACE)
    h = tk.span_hashes(buf, s, e)
    n = np.diff(woff)
    width = np.minimum(n, size)
    count = np.where(n > 0, n - width + 1, 0)
    first = tk.ranges(woff[:-1], count)
    doc = np.repeat(np.arange(len(n)), count)
    g = tk.span_hashes(h, first, first + width[doc])
    cuts = np.concatenate([[0], np.cumsum(count)])
    sets, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a in range(0, len(n), TEXTS):
        b = min(a + TEXTS, len(n))
        s = slice(cuts[a], cuts[b])
        x = np.sort(((doc[s] - a).astype(np.uint64) << SET_BITS) | (g[s] >> (np.uint64(64) - SET_BITS)))
        x = x[np.append(True, x[1:] != x[:-1])] if len(x) else x
        sets.append(x << (np.uint64(64) - SET_BITS))
        sizes.append(np.bincount((x >> SET_BITS).astype(np.int64), minlength=b - a))
    return np.concatenate(sets), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def signatures(g: np.ndarray, goff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for a set; texts without shingles have 0."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(g ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((c[goff[1:]] - c[goff[:-1]]).view(np.int64))
    return out[0], out[1]


def pack6(x: np.ndarray) -> bytes:
    return np.ascontiguousarray((x >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack6(b: bytes | pa.Buffer) -> np.ndarray:
    raw = np.zeros((memoryview(b).nbytes // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return raw.view("<u8").ravel()


class _Block:
    """Shingle sets of the class representatives of a block."""

    def __init__(self, docs: pa.Table, side: pa.Table, size: int):
        buf, offs = tk.pack(docs.column("text"))
        ids = docs.column("doc_id").to_numpy()
        g, goff = shingles(buf, offs, size)
        k1, k2 = signatures(g, goff)
        want = {x for x in zip(*(side.column(c).to_pylist() for c in ("doc_id", "k1", "k2")), strict=True) if x[1] is not None}
        keep: list[int] = []
        for i, x in enumerate(zip(ids.tolist(), k1.tolist(), k2.tolist(), strict=True)):
            if x in want:
                want.remove(x)  # a repeated row is a copy
                keep.append(i)
        self.ids = ids[keep]
        self.n = np.diff(goff)[keep]
        self.g = g[tk.ranges(goff[:-1][keep], self.n)]
        self.off = np.concatenate([[0], np.cumsum(self.n)])

    @property
    def keys(self) -> np.ndarray:
        return self.g >> np.uint64(64 - KEY_BITS)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers of 48 bits as compressed differences, byte by byte."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return len(x).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(d.T).tobytes(), "zstd", asbytes=True)


def unpack_sorted(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    d = np.zeros((n, 8), np.uint8)
    d[:, :6] = np.frombuffer(pa.decompress(b[4:], 6 * n, "zstd"), np.uint8).reshape(6, n).T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def length_classes(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets as similar as asked for are in the same class of sizes or in neighbouring ones."""
    return np.minimum(np.floor(np.log(np.maximum(n, 1)) / np.log(100 / min(percent, 90))), 255).astype(np.uint64)


def sized_keys(b: _Block, percent: int) -> np.ndarray:
    """Of each shingle of each set its key and, in the last 8 bits, the set's class of sizes."""
    return (b.keys << np.uint64(8)) | np.repeat(length_classes(b.n, percent), b.n)


def send_keys(b: _Block, block: int, n: int, percent: int) -> pa.Table:
    key, count = np.unique(sized_keys(b, percent), return_counts=True)
    raw = (key << np.uint64(1)) | (count > 1).astype(np.uint64)
    return rows(KEYS, [(i, block, pack_sorted(raw[s])) for i, s in by_bucket(bucket_of(key >> np.uint64(8), n), n)])


def rank_keys(t: pa.Table) -> pa.Table:
    """Ranks of keys that two sets have whose sizes would let them be similar.

    A rank is the number of (block, class of sizes) that have the key, at least
    2; it depends on the key alone, so all sets have their shingles in one order.
    """
    parts = [unpack_sorted(x.as_py()) for x in t.column("keys")]
    raw = np.concatenate(parts)
    o = np.argsort(raw, kind="stable")
    x = raw[o] >> np.uint64(1)
    key, kind, two = x >> np.uint64(8), (x & np.uint64(255)).astype(np.int64), (raw[o] & np.uint64(1)) > 0
    edge = np.append(True, key[1:] != key[:-1])
    heads = np.flatnonzero(edge)
    n = np.diff(np.append(heads, len(key)))
    near = ~edge[1:] & (kind[1:] - kind[:-1] <= 1)
    shared = two | np.append(False, near) | np.append(near, False)
    rank, yes = np.empty(len(raw), np.uint8), np.empty(len(raw), bool)
    rank[o] = np.repeat(np.clip(n, 2, 255), n)
    yes[o] = shared
    cuts, out = np.cumsum([0, *(len(p) for p in parts)]), []
    for i, b in enumerate(t.column("block").to_pylist()):
        s = slice(cuts[i], cuts[i + 1])
        if yes[s].any():
            out.append((b, pack_sorted(raw[s][yes[s]] >> np.uint64(1)), rank[s][yes[s]].tobytes()))
    return rows(RANKS, out)


def prefixes(b: _Block, keys: np.ndarray, ranks: np.ndarray, percent: int, most: int) -> pa.Table:
    """Of documents with candidates: shared prefix shingles, their levels, l, and the set.

    A document too few of whose shingles others have is similar to none and left out.
    """
    key = sized_keys(b, percent)
    i = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
    rank = np.where(keys[i] == key, ranks[i], 1).astype(np.int64) if len(keys) else np.ones(len(key), np.int64)
    doc = np.repeat(np.arange(len(b.n)), b.n)
    shared = np.bincount(doc[rank > 1], minlength=len(b.n))
    yes = np.flatnonzero((rank > 1) & (shared * 100 >= b.n * percent)[doc])
    # shingles that no other has come first in the order, so only the others are sorted
    if len(b.n) < 1 << 24:  # document, rank and place fit one number
        x = (doc[yes].astype(np.uint64) << np.uint64(40)) | (rank[yes].astype(np.uint64) << np.uint64(32)) | np.arange(len(yes), dtype=np.uint64)
        o = yes[(np.sort(x) & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    else:
        o = yes[np.lexsort((rank[yes], doc[yes]))]
    doc, rank, g = doc[o], rank[o], b.g[o]
    place = np.arange(len(o)) - np.searchsorted(doc, doc)
    pos = place + (b.n - shared)[doc]
    base = b.n - -(-percent * b.n // 100) + 1
    cost = np.bincount(doc, weights=np.where(pos < base[doc], rank - 1, 0), minlength=len(b.n))
    ell = np.minimum(1 + sum((cost > c).astype(np.int64) for c in COSTS[: most - 1]), np.maximum(b.n - base + 1, 1))
    level = np.maximum(pos - base[doc] + 2, 1)
    sent = level <= ell[doc]
    count = np.bincount(doc[sent], minlength=len(b.n))
    docs = np.flatnonzero(count)
    offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    lists = lambda x, kind: pa.ListArray.from_arrays(offsets(count[docs]), pa.array(x[sent], kind))
    n = b.n[docs]
    members = pa.Array.from_buffers(pa.binary(), len(docs), [None, offsets(6 * n).buffers()[1], pa.py_buffer(pack6(b.g[tk.ranges(b.off[docs], n)]))])
    return pa.table([pa.array(b.ids[docs]), pa.array(n), pa.array(shared[docs]), pa.array(ell[docs], pa.int32()), lists(place, pa.int32()), lists(g.view(np.int64), pa.int64()), lists(level, pa.int32()), members], schema=CANDIDATES)


CANDIDATES = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("ell", pa.int32()), ("places", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int64())), ("levels", pa.list_(pa.int32())), ("members", pa.binary())])
CANDIDATES_SQL = "doc long, n long, shared long, ell int, places array<int>, tokens array<long>, levels array<int>, members binary"


def packed_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets end to end, and their n+1 offsets."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return unpack6(column.buffers()[2][int(offs[0]) : int(offs[-1])]), (offs - offs[0]) // 6


def similar(a: pa.Array, b: pa.Array, percent: int) -> np.ndarray:
    """Which pairs of packed sets are as similar as asked for, many pairs at a time."""
    if not len(a):
        return np.zeros(0, bool)
    (u, uoff), (v, voff) = packed_sets(a), packed_sets(b)
    common, i, total = np.zeros(len(a), np.int64), 0, uoff + voff
    while i < len(a):
        j = min(max(i + 1, int(np.searchsorted(total, total[i] + ELEMENTS, side="right")) - 1), i + TEXTS, len(a))
        pair = np.arange(j - i, dtype=np.uint64) << SET_BITS
        x = np.concatenate([np.repeat(pair, np.diff(o[i : j + 1])) | w[o[i] : o[j]] for w, o in ((u, uoff), (v, voff))])
        x.sort()
        common[i:j] = np.bincount((x[1:][x[1:] == x[:-1]] >> SET_BITS).astype(np.int64), minlength=j - i)
        i = j
    return 100 * common >= percent * (np.diff(total) - common)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets are as similar as asked for."""
    a = sets.select(F.col("doc").alias("x"), F.col("members").alias("a"))
    b = sets.select(F.col("doc").alias("y"), F.col("members").alias("b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = similar(t.column(2), t.column(3), percent)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(a, "x").join(b, "y").select("x", "y", "a", "b").mapInArrow(check, "x long, y long")


def join(docs: DataFrame, *, percent: int = 75, size: int = 5, block_bytes: int = 2 << 20, most: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id: the least document reachable by links."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(tk.long_id(), F.coalesce("text", F.lit("")).alias("text"))
    _, _, n = tk.block_sizes(spark, docs, block_bytes=block_bytes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            g, goff = shingles(*tk.pack(t.column(1)), size)
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(np.diff(goff)), *(pa.array(k) for k in signatures(g, goff))], SIGNS.names)
            tk.release()

    signs = table(docs.mapInArrow(sign, sql_schema(SIGNS)), "signatures")
    classes = table(signs.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).alias("block")
    blocks = docs.withColumn("block", at("doc_id")).groupBy("block")
    none = F.lit(None).cast("binary")
    reps = classes.select(F.col("rep").alias("doc_id"), "k1", "k2", none.alias("keys"), none.alias("ranks"), at("rep"))

    def to_keys(t: pa.Table, side: pa.Table) -> pa.Table:
        out = send_keys(_Block(t, side, size), t.column("block")[0].as_py(), n, percent) if len(t) else rows(KEYS, [])
        tk.release()
        return out

    def to_candidates(t: pa.Table, side: pa.Table) -> pa.Table:
        if not len(t):
            return pa.Table.from_pylist([], CANDIDATES)
        sent = [x for x in zip(side.column("keys").to_pylist(), side.column("ranks").to_pylist(), strict=True) if x[0] is not None]
        keys = np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(k) for k, _ in sent)])
        ranks = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r, np.uint8) for _, r in sent)])
        o = np.argsort(keys, kind="stable")
        out = prefixes(_Block(t, side, size), keys[o], ranks[o], percent, most)
        tk.release()
        return out

    keys = blocks.cogroup(reps.groupBy("block")).applyInArrow(to_keys, sql_schema(KEYS))
    ranks = keys.groupBy("bucket").applyInArrow(lambda t: rank_keys(t), sql_schema(RANKS))
    null = F.lit(None).cast("long")
    side = reps.unionByName(ranks.select(null.alias("doc_id"), null.alias("k1"), null.alias("k2"), "keys", "ranks", "block"))
    found = table(blocks.cogroup(side.groupBy("block")).applyInArrow(to_candidates, CANDIDATES_SQL), "candidates")
    links = candidate_links(found, percent, most=most)
    labels = components(links)
    ids = classes.join(labels, F.col("rep") == F.col("node"), "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    d = signs.join(ids, ["n", "k1", "k2"], "left")
    d = d.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return tk.with_null_ids(d, "doc_id", "component_id")


def candidate_links(found: DataFrame, percent: int, rounds: int = 4, most: int = 3) -> DataFrame:
    """Verified links (x, y) that have the components of all links.

    In each of the first rounds a document is compared with two others at most.
    Each of its open shingles proposes two documents: one that a hash, another
    each round, puts first, and a hub, which has few shingles of its own and so
    is near to what a group has in common. Of those outside its component a
    document takes the best hub and the one that most of its shingles propose;
    in later rounds chance picks among the hubs and the proposed, so that others
    are tried. A shingle is open while its documents are in several
    components. What is left then is compared in pairs that share enough prefix
    shingles and could still be similar by size and by the places of these
    shingles among those that others have; the first shared one brings the pair.
    """
    sets = found.select("doc", "members")
    upto = [F.size(F.filter("levels", lambda x, i=i: x <= i)) for i in range(1, most + 1)]
    prefix = found.select("doc", "tokens", F.array(*upto).alias("upto"))
    t = F.explode(F.arrays_zip("tokens", "levels", "places")).alias("_t")
    e = found.select("doc", "n", "shared", "ell", t).select("doc", "n", "shared", "ell", F.col("_t.tokens").alias("token"), F.col("_t.levels").alias("level"), F.col("_t.places").alias("place"))
    e = table(e.withColumn("c", F.col("doc")), "entries")
    long_enough = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    links: DataFrame | None = None
    for r in range(rounds):
        h = F.xxhash64("doc", F.lit(r)).alias("h")
        part = (F.col("shared") / F.col("n") + (F.pmod(h, F.lit(1024)) / 8192 if r else 0)).alias("part")
        ends = e.groupBy("token").agg(F.min(F.struct(h, "doc", "n", "c", part)).alias("a"), F.max(F.struct(part, h, "doc", "n", "c")).alias("b"), F.min("c").alias("_a"), F.max("c").alias("_b")).where("_a <> _b")
        both = F.array(*(F.struct(*(F.col(f"{o}.{x}").alias(x) for x in ("part", "doc", "n", "c"))) for o in "ab"))
        near = e.join(ends.select("token", both.alias("_o")), "token").select("doc", "n", "c", F.explode("_o").alias("o")).withColumn("m", F.col("o.n"))
        near = near.where("c <> o.c").where(long_enough).groupBy("doc", F.col("o.doc").alias("o")).agg(F.count(F.lit(1)).alias("k"), F.max("o.part").alias("part"))
        other = F.xxhash64("doc", "o", F.lit(r)) if r else F.col("k")
        best = F.array(F.max(F.struct(other.alias("_k"), "part", "o"))["o"], F.max(F.struct("part", "k", "o"))["o"])
        star = near.groupBy("doc").agg(best.alias("o")).select("doc", F.explode("o").alias("o")).select(F.least("doc", "o").alias("x"), F.greatest("doc", "o").alias("y")).distinct()
        new = table(verify(star, sets, percent), "links")
        links = new if links is None else links.union(new)
        labels = components(links)
        e = e.drop("c").join(labels, F.col("doc") == F.col("node"), "left").withColumn("c", F.coalesce("component", "doc")).drop("node", "component")
        open_ = e.groupBy("token").agg(F.min("c").alias("_a"), F.max("c").alias("_b")).where("_a <> _b").select("token")
        e = table(e.join(open_, "token", "left_semi"), "entries")
    e = e.join(prefix, "doc")
    f = e.select(*(F.col(c).alias(n) for c, n in (("doc", "y"), ("n", "m"), ("shared", "shared2"), ("ell", "ell2"), ("token", "token"), ("level", "level2"), ("place", "place2"), ("c", "c2"), ("tokens", "tokens2"), ("upto", "upto2"))))
    least = F.least("ell", "ell2")
    reach = F.least("place", "place2") + F.least(F.col("shared") - F.col("place"), F.col("shared2") - F.col("place2"))
    could = (100 + percent) * reach >= percent * (F.col("n") + F.col("m"))
    common = F.array_intersect(F.slice("tokens", 1, F.element_at("upto", least)), F.slice("tokens2", 1, F.element_at("upto2", least)))
    brings = (F.size(common) >= least) & (F.get(common, F.lit(0)) == F.col("token"))
    p = e.withColumnRenamed("doc", "x").join(f, "token").where("x < y and c <> c2").where(long_enough & could).where(F.greatest("level", "level2") <= least).where(brings).select("x", "y")
    return links.union(table(verify(p, sets, percent), "links"))
