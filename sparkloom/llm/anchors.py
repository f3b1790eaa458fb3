"""Windows that documents share, found through their anchors.

Operators 7 and 8 ask, for every window of ``length`` units (bytes or words) of
every document, whether a document with a smaller id has the same window. Each
window names an anchor: of its grams of ``k`` units the one with the least
hash, so equal windows name equal anchors. Neighbouring windows mostly name the
same one and form a run. The steps:

1. Documents are dealt into blocks by a hash of id and text. A block sends the
   distinct keys of its anchors, with a bit for those of two documents of its
   own, packed by bucket.
2. A bucket of keys answers each block with those of its keys that another
   block or another document has too, and says which are in many blocks.
3. A block sends the text of each distinct run with such an anchor, and the
   least document it occurs in, to the bucket of the key. Runs of an anchor in
   many blocks go as single windows, dealt by the window's own hash, so that no
   bucket has to hold all that surrounds a common phrase.
4. A bucket compares the runs by an operator's own method and answers each
   block with the windows that a smaller document has.
5. A block marks these, and copies of a run in its own later documents.

Copies are folded within a block before anything is sent, so a key sends one
row a block at most, whatever share of the documents has it. Keys are cut to 39
bits; where two anchors agree in them, more runs are compared, no fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import textkit as tk

KEY_BITS = 39
#: A key in so many blocks has its runs sent as single windows.
MANY_BLOCKS = 256


@dataclass
class Block:
    """Documents of a block in order of their ids; units are bytes or word hashes."""

    ids: np.ndarray
    buf: np.ndarray
    offs: np.ndarray
    units: np.ndarray
    uoffs: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


def read_block(t: pa.Table, words: bool) -> Block:
    t = t.sort_by([("doc_id", "ascending")])
    ids = t.column("doc_id").to_numpy()
    buf, offs = tk.pack(t.column("text"))
    if not words:
        return Block(ids, buf, offs, buf, offs)
    s, e, woff = tk.words(buf, offs, tk.NOT_SPACE)
    return Block(ids, buf, offs, tk.span_hashes(buf, s, e), woff, s, e)


@dataclass
class Runs:
    """Runs of windows with one anchor: first and last window, document, key, hash of the text."""

    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    text: np.ndarray


def runs_of(b: Block, length: int, k: int) -> Runs:
    parts, w = [], length - k + 1
    n = len(b.units)
    for a in range(0, n - length + 1, tk.CHUNK):
        seg = b.units[a : min(n, a + tk.CHUNK + length - 1)]
        h = tk.gram_hashes(seg, k)
        at = tk.sliding_argmin(h, w)
        d = np.searchsorted(b.uoffs, np.arange(a, a + len(at)), side="right") - 1
        ok = np.arange(a, a + len(at)) + length <= b.uoffs[d + 1]
        edge = np.ones(len(at), bool)
        edge[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
        first = np.flatnonzero(edge & ok)
        stop = np.ones(len(at), bool)
        stop[:-1] = edge[1:] | ~ok[1:]
        last = np.flatnonzero(stop & ok)
        parts.append((first + a, last + a, d[first], h[at[first]]))
    if not parts:
        z = np.zeros(0, np.int64)
        return Runs(z, z, z, z.astype(np.uint64), z.astype(np.uint64))
    first, last, doc, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Runs(first, last, doc, key >> np.uint64(64 - KEY_BITS), tk.span_hashes(b.units, first, last + length))


def within(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def pack5(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack5(b: bytes) -> np.ndarray:
    raw = np.zeros((len(b) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel()


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Ranges of keys, in order."""
    return ((key * np.uint64(n)) >> np.uint64(KEY_BITS)).astype(np.int64)


def by_bucket(buckets: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted array of bucket numbers, one for each number in it."""
    if len(buckets):
        edges = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(buckets)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(buckets[a]), slice(a, b)


def rows(schema: pa.Schema, data: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in data], f.type) for i, f in enumerate(schema)], schema=schema)


KEYS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())])
REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())])
PIECES = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("docs", pa.binary()), ("which", pa.binary()), ("windows", pa.binary()), ("texts", pa.binary())])
MARKS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("masks", pa.binary()), ("many", pa.binary())])


def sql_schema(s: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in s)


def shared_keys(t: pa.Table, many: int = MANY_BLOCKS) -> pa.Table:
    """Step 2. The lowest bit of a key says that its block has it in two documents."""
    blocks = t.column("block").to_numpy()
    parts = [unpack5(x.as_py()) for x in t.column("keys")]
    raw = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    key = raw >> np.uint64(1)
    o = np.argsort(key, kind="stable")
    ks = key[o]
    edge = np.flatnonzero(np.append(True, ks[1:] != ks[:-1]))
    n = np.diff(np.append(edge, len(ks)))
    two = np.maximum.reduceat((raw & np.uint64(1)).astype(np.uint8)[o], edge) > 0
    size = np.repeat(n, n)
    yes = np.zeros(len(raw), bool)
    yes[o] = (size > 1) | np.repeat(two, n)
    wide = np.zeros(len(raw), bool)
    wide[o] = size >= many
    cuts = np.searchsorted(owner, np.arange(len(parts) + 1))
    out, bucket = [], t.column("bucket")[0].as_py()
    for i, b in enumerate(blocks):
        s = slice(cuts[i], cuts[i + 1])
        if yes[s].any():
            out.append((int(b), bucket, pack5(key[s][yes[s]]), pack5(key[s][wide[s]])))
    return rows(REPLY, out)


def merged(t: pa.Table, column: str) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack5(x.as_py()) for x in t.column(column))]))


class SharedWindows:
    """The five steps for one kind of unit; ``compare`` is the operator's step 4.

    compare(docs, lengths, texts) gets pieces of text sorted by document, each
    of at least ``length`` units, and returns for all windows of all pieces, one
    piece after another, whether a smaller document has the window.
    """

    def __init__(self, length: int, k: int, words: bool, compare: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]):
        """k units a gram, more for long windows: a run has length - k + 1 windows at most, which must fit 63 bits."""
        if length < 1:
            raise ValueError("a window has at least one unit")
        self.length, self.k, self.words, self.compare = length, min(max(k, length - 62), length), words, compare

    def send_keys(self, n: int, b: Block, block: int) -> pa.Table:
        r = runs_of(b, self.length, self.k)
        o = np.lexsort((r.doc, r.key))
        key, ids = r.key[o], b.ids[r.doc[o]]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        stop = np.append(edge[1:], len(key)) - 1
        key = (key[edge] << np.uint64(1)) | (ids[edge] != ids[stop]).astype(np.uint64) if len(edge) else key
        return rows(KEYS, [(i, block, pack5(key[s])) for i, s in by_bucket(bucket_of(key >> np.uint64(1), n), n)])

    def pieces(self, r: Runs, many: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which runs go whole, and first window, document, hash and key of the runs cut into windows."""
        wide = within(r.key, many)
        n = (r.last - r.first + 1)[wide]
        return ~wide, tk.ranges(r.first[wide], n), np.repeat(r.doc[wide], n), np.repeat(r.key[wide], n)

    def send_pieces(self, n: int, b: Block, block: int, shared: np.ndarray, many: np.ndarray) -> pa.Table:
        r = runs_of(b, self.length, self.k)
        keep = within(r.key, shared)
        r = Runs(*(x[keep] for x in (r.first, r.last, r.doc, r.key, r.text)))
        whole, at, doc, _ = self.pieces(r, many)
        single = tk.span_hashes(b.units, at, at + self.length)
        first = np.concatenate([r.first[whole], at])
        size = np.concatenate([(r.last - r.first)[whole] + self.length, np.full(len(at), self.length, np.int64)])
        ids = b.ids[np.concatenate([r.doc[whole], doc])]
        text = np.concatenate([r.text[whole], single])
        bucket = np.concatenate([bucket_of(r.key[whole], n), bucket_of(single >> np.uint64(64 - KEY_BITS), n)])
        o = np.lexsort((ids, text, bucket))
        o = o[np.append(True, (text[o][1:] != text[o][:-1]) | (bucket[o][1:] != bucket[o][:-1]))] if len(o) else o
        out = []
        for i, s in by_bucket(bucket[o], n):
            x = o[s]
            own, which = np.unique(ids[x], return_inverse=True)
            units = b.units[tk.ranges(first[x], size[x])].tobytes()
            windows = (size[x] - self.length + 1).astype(np.uint8)
            out.append((i, block, own.astype("<i8").tobytes(), which.astype("<u4").tobytes(), windows.tobytes(), units if self.words else pa.compress(units, "zstd", asbytes=True)))
        return rows(PIECES, out)

    def answer(self, t: pa.Table) -> pa.Table:
        """Step 4, of all blocks' pieces in a bucket."""
        col = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in t.column(name)]
        ids, which, windows = (col(*x) for x in (("docs", "<i8"), ("which", "<u4"), ("windows", np.uint8)))
        owner = np.repeat(np.arange(len(ids)), [len(d) for d in which])
        docs = np.concatenate([d[w] for d, w in zip(ids, which, strict=True)])
        size = np.concatenate(windows).astype(np.int64) + self.length - 1
        if self.words:
            units = np.concatenate(col("texts", np.uint64))
        else:
            each = [int(w.sum(dtype=np.int64)) + (self.length - 1) * len(w) for w in windows]
            units = np.concatenate([np.frombuffer(pa.decompress(x.as_py(), n, "zstd"), np.uint8) for x, n in zip(t.column("texts"), each, strict=True)])
        start = np.cumsum(size) - size
        text = tk.span_hashes(units, start, start + size)
        # equal pieces of several blocks are compared once, as their smallest document's
        o = np.lexsort((docs, text, size))
        edge = np.append(True, (text[o][1:] != text[o][:-1]) | (size[o][1:] != size[o][:-1]))
        least = np.empty(len(docs), np.int64)
        least[o] = docs[o][np.maximum.accumulate(np.where(edge, np.arange(len(o)), 0))]
        own = o[edge]
        own = own[np.argsort(docs[own], kind="stable")]
        dup = self.compare(docs[own], size[own], units[tk.ranges(start[own], size[own])], self.length)
        n = size[own] - self.length + 1
        bit = np.where(dup, np.uint64(1) << (tk.ranges(np.zeros(len(n), np.int64), n)).astype(np.uint64), np.uint64(0))
        mask = np.zeros(len(docs), np.uint64)
        mask[own] = np.bitwise_or.reduceat(bit, np.cumsum(n) - n)
        group = np.cumsum(edge) - 1
        full = np.zeros(len(docs), np.uint64)
        full[o] = mask[o[edge]][group]
        all_ = (np.uint64(1) << (size - self.length + 1).astype(np.uint64)) - np.uint64(1)
        mask = np.where(docs > least, all_, full)
        cuts = np.searchsorted(owner, np.arange(len(t) + 1))
        out, bucket = [], t.column("bucket")[0].as_py()
        for i, b in enumerate(t.column("block").to_pylist()):
            s = slice(cuts[i], cuts[i + 1])
            yes = mask[s] > 0
            if yes.any():
                out.append((b, bucket, text[s][yes].tobytes(), mask[s][yes].tobytes(), b""))
        return rows(MARKS, out)

    def marked(self, b: Block, marks: pa.Table) -> np.ndarray:
        """Step 5: which windows of the block a smaller document has, by start."""
        dup = np.zeros(len(b.units), bool)
        r = runs_of(b, self.length, self.k)
        if not len(r.first):
            return dup
        text = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in marks.column("hashes"))])
        mask = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in marks.column("masks"))])
        o = np.argsort(text, kind="stable")
        text, mask = text[o], mask[o]
        many = merged(marks, "many")
        whole, at, doc, _ = self.pieces(r, many)
        h = np.concatenate([r.text[whole], tk.span_hashes(b.units, at, at + self.length)])
        first, ids = np.concatenate([r.first[whole], at]), b.ids[np.concatenate([r.doc[whole], doc])]
        n = np.concatenate([(r.last - r.first + 1)[whole], np.ones(len(at), np.int64)])
        o = np.lexsort((ids, h))
        least = np.empty(len(h), np.int64)
        least[o] = ids[o][np.maximum.accumulate(np.where(np.append(True, h[o][1:] != h[o][:-1]), np.arange(len(o)), 0))]
        m = np.where(within(h, text), mask[np.minimum(np.searchsorted(text, h), max(len(text) - 1, 0))], np.uint64(0)) if len(text) else np.zeros(len(h), np.uint64)
        m = np.where(ids > least, ~np.uint64(0), m)
        some = m > 0
        first, n, m = first[some], n[some], m[some]
        where = tk.ranges(first, n)
        bit = tk.ranges(np.zeros(len(n), np.int64), n).astype(np.uint64)
        dup[where[(np.repeat(m, n) >> bit) & np.uint64(1) > 0]] = True
        return dup

    def run(self, docs: DataFrame, finish: Callable[[Block, np.ndarray], pa.Table], schema: pa.Schema, block_bytes: int = 2 << 20) -> DataFrame:
        """finish(block, marked windows) gives the rows of a block's documents."""
        ship(docs.sparkSession)
        op, words = self, self.words
        _, _, n = tk.block_sizes(docs.sparkSession, docs, block_bytes=block_bytes)
        d = docs.select(tk.long_id(), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block"))
        blocks = d.groupBy("block")
        number = lambda t: t.column("block")[0].as_py()

        def tidy(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
            """f, after which the worker gives its memory back; Spark tells by the arguments what f takes."""
            if f.__code__.co_argcount == 1:
                return lambda t: (f(t), tk.release())[0]
            return lambda t, other: (f(t, other), tk.release())[0]

        def to_keys(t: pa.Table) -> pa.Table:
            return op.send_keys(n, read_block(t, words), number(t))

        def to_pieces(t: pa.Table, reply: pa.Table) -> pa.Table:
            if not len(t) or not len(reply):
                return rows(PIECES, [])
            many = merged(reply, "many")
            out = op.send_pieces(n, read_block(t, words), number(t), merged(reply, "keys"), many)
            if not len(many):
                return out
            # the block itself has to know these keys again in step 5
            return pa.concat_tables([out, rows(PIECES, [(-1, number(t), b"", b"", b"", pack5(many))])])

        def to_marks(t: pa.Table) -> pa.Table:
            if t.column("bucket")[0].as_py() < 0:
                return rows(MARKS, [(b, -1, b"", b"", x) for b, x in zip(t.column("block").to_pylist(), t.column("texts").to_pylist(), strict=True)])
            return op.answer(t)

        def to_rows(t: pa.Table, marks: pa.Table) -> pa.Table:
            if not len(t):
                return rows(schema, [])
            b = read_block(t, words)
            return finish(b, op.marked(b, marks))

        keys = blocks.applyInArrow(tidy(to_keys), sql_schema(KEYS))
        reply = keys.groupBy("bucket").applyInArrow(lambda t: shared_keys(t), sql_schema(REPLY))
        pieces = blocks.cogroup(reply.groupBy("block")).applyInArrow(tidy(to_pieces), sql_schema(PIECES))
        salt = F.when(F.col("bucket") < 0, F.col("block")).otherwise(-1)
        marks = pieces.groupBy("bucket", salt.alias("salt")).applyInArrow(tidy(to_marks), sql_schema(MARKS))
        return tk.with_null_ids(blocks.cogroup(marks.groupBy("block")).applyInArrow(tidy(to_rows), sql_schema(schema)), "doc_id")
