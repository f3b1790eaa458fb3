"""Operator 6: remove repeated lines by an exact set-similarity join.

A line's tokens are its distinct shingles of five lower-cased words (a shorter
line has its whole sequence as one). A line goes if a line before it, in order
of document id and line number, has a Jaccard similarity of ``percent`` to it;
lines are judged on the input, not on what is left. So the first of several
copies stays, and a line that only resembles a later one stays too.

1. Texts are read once and written in pieces of ``block_bytes``. A piece sends
   the signatures of its distinct token sets, with the first place of each.
2. Equal sets of all pieces are folded to one, which the piece with the first
   place owns.
3. Tokens are ordered by rarity over the distinct sets, and a set's prefix is
   taken, both as in ``ngramjoin``. Sets too few of whose tokens others have
   are left out.
4. A set is compared with a few earlier ones that its prefix tokens propose: the
   earliest of a token's sets, and hubs. A hub has few tokens of its own and so
   is near to what a group has in common; there is one for each stretch of
   places, so that late sets have hubs before them. What found no match is then
   compared with every earlier set that passes the prefix, length, positional and
   bitmap filters. One match is enough, so a large group of near copies costs a few
   comparisons a member. A group of g sets that share their rare tokens, could
   be similar by all filters and yet are not, costs g * g / 2.
5. Pieces are told which of their sets go. Sets are made anew from the pieces
   when needed, as hashes take more room than compressed text.

Nulls: a null id is one id, smaller than all others; a null text has no lines.
Lines without words are neither counted nor removed. Rows that repeat a
document's id share their lines' places, so neither removes the other's. Other
columns are ignored, whatever their names. A very long text makes a piece of
its own, which one worker holds. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import ngramjoin as nj
from . import textkit as tk
from .anchors import by_bucket, rows, sql_schema
from .shared import table

_bin = pa.binary()
#: Texts of a piece, which of its distinct sets each line has, and the sets' signatures and first places.
PIECES = pa.schema([("block", pa.int64()), *((c, _bin) for c in ("ids", "sizes", "texts", "which", "k1", "k2", "docs", "lines"))])
SIGNS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), *((c, _bin) for c in ("k1", "k2", "docs", "lines"))])
#: Of each set that a piece sent to a bucket whether its first place is elsewhere (LATE) or the piece owns it (OWN);
#: with neither it is a twin, whose first place is that of the owner's set too: rows that repeat an id.
FOLDS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("flags", _bin), ("twins", pa.list_(pa.int64())), ("owners", pa.list_(pa.int64()))])
FOLDS_SQL = "block long, bucket long, flags binary, twins array<long>, owners array<long>"
ROWS = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])
CANDIDATES = pa.schema([*nj.CANDIDATES, ("fdoc", pa.int64()), ("fline", pa.int32()), ("bits", pa.list_(pa.int64()))])
CANDIDATES_SQL = f"{nj.CANDIDATES_SQL}, fdoc long, fline int, bits array<long>"
#: 64-bit numbers of a set's bitmap, in which each token sets a bit: two bitmaps differ in as many bits as the sets do, or fewer.
BITMAP = 8
#: A line without words.
NO_SET = np.uint32(2**32 - 1)
LATE, OWN = 1, 2
#: A set's id is its piece and its number in it; a piece is a task of the first pass and a number in it.
#: So there may be 2**20 tasks of 2**18 pieces with 2**25 different lines each; more is an error.
SET_BITS, SEQ_BITS = 25, 18


def line_cuts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines without their newlines, and the offsets of texts' lines; a text has one more line than newlines."""
    nl = np.flatnonzero(buf == 0x0A)
    count = np.searchsorted(nl, offs)
    first = count + np.arange(len(offs))
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    at = np.arange(len(nl)) + np.searchsorted(offs, nl, side="right") - 1
    starts[first[:-1]], ends[first[1:] - 1] = offs[:-1], offs[1:]
    starts[at + 1], ends[at] = nl + 1, nl
    return starts, ends, first


def zstd(v: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(v).tobytes(), "zstd", asbytes=True)


def piece(texts: list[pa.Array], ids: list[pa.Array], block: int, n: int, size: int) -> pa.Table:
    buf, offs = tk.pack(pa.chunked_array(texts))
    own = np.concatenate([x.to_numpy(zero_copy_only=False) for x in ids])
    starts, _, first = line_cuts(buf, offs)
    # a line's newline is white space, so stretches from start to start have the same words
    g, goff = nj.shingles(buf, np.append(starts, len(buf)), size)
    k1, k2 = nj.signatures(g, goff)
    has = np.flatnonzero(np.diff(goff))
    doc = np.repeat(own, np.diff(first))[has]
    line = (np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first)))[has]
    k1, k2 = k1[has], k2[has]
    o = np.lexsort((line, doc, k2, k1, bucket_of(k1, n)))
    edge = np.append(True, (k1[o][1:] != k1[o][:-1]) | (k2[o][1:] != k2[o][:-1])) if len(o) else np.zeros(0, bool)
    x = o[edge]
    if len(x) >= 1 << SET_BITS:
        raise ValueError(f"a text has over {1 << SET_BITS} different lines")
    which = np.full(len(starts), NO_SET, np.uint32)
    which[has[o]] = np.cumsum(edge) - 1
    return rows(PIECES, [(block, own.astype("<i8").tobytes(), np.diff(offs).astype("<i8").tobytes(), zstd(buf), zstd(which), k1[x].tobytes(), k2[x].tobytes(), doc[x].astype("<i8").tobytes(), line[x].astype("<u4").tobytes())])


class _Piece:
    """A stored piece: texts, lines, and of each line the number of its set."""

    def __init__(self, r: dict):
        self.ids, sizes = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["sizes"], "<i8")
        self.offs = np.concatenate([[0], np.cumsum(sizes)])
        self.buf = np.frombuffer(pa.decompress(r["texts"], int(self.offs[-1]), "zstd"), np.uint8)
        self.starts, self.ends, self.first = line_cuts(self.buf, self.offs)
        self.which = np.frombuffer(pa.decompress(r["which"], 4 * len(self.starts), "zstd"), "<u4")


def flags_of(side: pa.Table) -> np.ndarray:
    """Of a piece's sets, from all buckets: sets are in the buckets' order."""
    got = sorted((x for x in zip(side.column("bucket").to_pylist(), side.column("flags").to_pylist(), strict=True) if x[1] is not None), key=lambda x: x[0])
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for _, x in got)])


def owned(r: dict, side: pa.Table, size: int) -> tuple[nj._Block, np.ndarray]:
    """The sets that a piece owns, and their numbers."""
    p, flags = _Piece(r), flags_of(side)
    number, line = np.unique(p.which, return_index=True)
    mine = (number != NO_SET) & (flags[np.minimum(number, max(len(flags) - 1, 0))] & OWN > 0) if len(flags) else np.zeros(len(number), bool)
    number, line = number[mine].astype(np.int64), line[mine]
    n = p.ends[line] - p.starts[line]
    b = object.__new__(nj._Block)
    b.g, b.off = nj.shingles(p.buf[tk.ranges(p.starts[line], n)], np.concatenate([[0], np.cumsum(n)]), size)
    b.n, b.ids = np.diff(b.off), (r["block"] << SET_BITS) + number
    return b, number


def bucket_of(k: np.ndarray, n: int) -> np.ndarray:
    return (((k.view(np.uint64) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def signs(r: dict, n: int) -> pa.Table:
    """Signatures and first places of a piece's sets, by bucket."""
    k1, k2, docs, lines = np.frombuffer(r["k1"], "<i8"), np.frombuffer(r["k2"], "<i8"), np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["lines"], "<u4")
    return rows(SIGNS, [(i, r["block"], s.start, *(x[s].tobytes() for x in (k1, k2, docs, lines))) for i, s in by_bucket(bucket_of(k1, n), n)])


def fold(t: pa.Table) -> pa.Table:
    """Step 2, of all pieces' sets in a bucket."""
    col = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in t.column(c)]
    counts = np.array([len(x) for x in col("k1", "<i8")])
    k1, k2, docs, lines = (np.concatenate(col(*x)) for x in (("k1", "<i8"), ("k2", "<i8"), ("docs", "<i8"), ("lines", "<u4")))
    blocks = t.column("block").to_numpy()
    ids = tk.ranges((blocks << SET_BITS) + t.column("at").to_numpy(), counts)
    o = np.lexsort((ids, lines, docs, k2, k1))
    edge = np.append(True, (k1[o][1:] != k1[o][:-1]) | (k2[o][1:] != k2[o][:-1]))
    head = np.empty(len(o), np.int64)
    head[o] = o[np.maximum.accumulate(np.where(edge, np.arange(len(o)), 0))]
    late = (docs != docs[head]) | (lines != lines[head])
    own = head == np.arange(len(o))
    flags = (late * LATE + own * OWN).astype(np.uint8)
    cuts, out, bucket = np.concatenate([[0], np.cumsum(counts)]), [], t.column("bucket")[0].as_py()
    for i, b in enumerate(blocks.tolist()):
        s = np.arange(cuts[i], cuts[i + 1])
        twin = s[flags[s] == 0]
        out.append((b, bucket, flags[s].tobytes(), ids[twin].tolist(), ids[head[twin]].tolist()))
    return rows(FOLDS, out)


def candidates(r: dict, side: pa.Table, size: int, percent: int) -> pa.Table:
    """Step 3: prefixes and first places of the sets that a piece owns."""
    b, number = owned(r, side, size)
    sent = [x for x in zip(side.column("keys").to_pylist(), side.column("ranks").to_pylist(), strict=True) if x[0] is not None]
    keys = np.concatenate([np.zeros(0, np.uint64), *(nj.unpack_sorted(k) for k, _ in sent)])
    ranks = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for _, x in sent)])
    o = np.argsort(keys, kind="stable")
    out = nj.prefixes(b, keys[o], ranks[o], percent, 3)
    at = out.column("doc").to_numpy() - (r["block"] << SET_BITS)
    members, off = nj.packed_sets(out.column("members").combine_chunks())
    bits = np.zeros((len(at), 64 * BITMAP), bool)
    bits[np.repeat(np.arange(len(at)), np.diff(off)), (members >> np.uint64(16)).astype(np.int64) % (64 * BITMAP)] = True
    bits = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * BITMAP, pa.int32()), pa.array(np.packbits(bits, axis=1).view("<i8").ravel()))
    more = [pa.array(np.frombuffer(r["docs"], "<i8")[at]), pa.array(np.frombuffer(r["lines"], "<u4")[at].astype(np.int32)), bits]
    return pa.table([*out.columns, *more], schema=CANDIDATES)


def proposals(e: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of a set and at most three earlier ones that its tokens propose; e has entries by token."""
    place = F.struct("fdoc", "fline")
    who = F.struct((F.col("shared") / F.col("n")).alias("part"), *(F.col(c) for c in ("doc", "n", "shared", "fdoc", "fline")))
    each = e.groupBy("token", "slice").agg(F.max(who).alias("hub"), F.min(place).alias("p"), F.min_by(who, place).alias("a"))
    ends = each.groupBy(F.col("token").alias("_token")).agg(F.collect_list(F.struct("slice", "hub")).alias("hubs"), F.min(F.struct("p", "a"))["a"].alias("a"))
    x = e.join(ends, F.col("token") == F.col("_token"))
    # the best hub of the stretches before, and that of the set's own
    before = F.array_max(F.transform(F.filter("hubs", lambda h: h["slice"] < F.col("slice")), lambda h: h["hub"]))
    own = F.array_max(F.transform(F.filter("hubs", lambda h: h["slice"] == F.col("slice")), lambda h: h["hub"]))
    x = x.select("doc", "n", "shared", place.alias("p"), F.explode(F.array_distinct(F.filter(F.array("a", before, own), lambda h: h.isNotNull()))).alias("o"))
    could = F.least("shared", "o.shared") * (100 + percent) >= percent * (F.col("n") + F.col("o.n"))
    x = x.where(F.struct("o.fdoc", "o.fline") < F.col("p")).where(F.least("n", "o.n") * 100 >= F.greatest("n", "o.n") * percent).where(could)
    x = x.groupBy("doc", F.col("o.doc").alias("o")).agg(F.count(F.lit(1)).alias("k"), F.max("o.part").alias("part"))
    best = [F.max_by("o", F.struct("part", "k", "o")), F.max_by("o", F.struct("k", "part", "o")), F.max_by("o", F.xxhash64("doc", "o"))]
    return x.groupBy(F.col("doc").alias("x")).agg(F.array_distinct(F.array(*best)).alias("_y")).select("x", F.explode("_y").alias("y"))


#: Stretches of places that have hubs of their own.
SLICES = 16


def matched(found: DataFrame, percent: int) -> DataFrame:
    """Step 4: ids of the sets that an earlier one matches."""
    sets = found.select("doc", "members")
    own = ["doc", "n", "shared", "ell", "fdoc", "fline"]
    cuts = found.agg(F.percentile_approx("fdoc", [i / SLICES for i in range(1, SLICES)], 1000)).first()[0] or []
    slice_ = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c <= F.col("fdoc"))).alias("slice")
    t = F.explode(F.arrays_zip("tokens", "levels", "places")).alias("_t")
    e = table(found.select(*own, slice_, t).select(*own, "slice", F.col("_t.tokens").alias("token"), F.col("_t.levels").alias("level"), F.col("_t.places").alias("place")), "entries")
    place = F.struct("fdoc", "fline")
    # a set of n tokens, shared of which others have, can't match one of more than this many
    most = F.floor(F.col("shared") * (100 + percent) / percent) - F.col("n")
    ends = e.groupBy(F.col("token").alias("_token")).agg(F.min(place).alias("_first"), F.min("n").alias("_least"), F.count(F.lit(1)).alias("_many")).where("_many > 1")
    e = table(e.join(ends, F.col("token") == F.col("_token")).where(most >= F.col("_least")).select(*own, "slice", "token", "level", "place", (place > F.col("_first")).alias("later")), "entries")
    gone = table(nj.verify(proposals(e, percent), sets, percent).select(F.col("x").alias("_gone")).distinct(), "gone")
    left = table(e.where("later").join(gone, F.col("doc") == F.col("_gone"), "left_anti"), "left")
    # what is left meets every earlier set of its postings
    some = left.groupBy(F.col("token").alias("_token")).agg(F.max(place).alias("_last"), F.max(most).alias("_most"))
    f = e.join(some, F.col("token") == F.col("_token")).where(place < F.col("_last")).where(F.col("n") <= F.col("_most"))
    upto = F.array(*[F.size(F.filter("levels", lambda x, i=i: x <= i)) for i in (1, 2, 3)])
    more = found.select(F.col("doc").alias("_d"), "bits", "tokens", upto.alias("upto"))
    f = f.join(more, F.col("doc") == F.col("_d")).select(*(F.col(c).alias(f"{c}2") for c in (*own, "token", "level", "place", "bits", "tokens", "upto")))
    differ = sum(F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits2", F.lit(i)))) for i in range(BITMAP))
    both = F.col("n") + F.col("n2")
    least = F.least("ell", "ell2")
    reach = F.least("place", "place2") + F.least(F.col("shared") - F.col("place"), F.col("shared2") - F.col("place2"))
    p = left.join(more, F.col("doc") == F.col("_d")).join(f, F.col("token") == F.col("token2")).where(F.struct("fdoc2", "fline2") < place)
    p = p.where(F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent).where((100 + percent) * reach >= percent * both).where(F.greatest("level", "level2") <= least)
    p = p.where((100 + percent) * (both - differ) >= 2 * percent * both)
    # the first of the prefix tokens that two sets share brings the pair
    common = F.array_intersect(F.slice("tokens", 1, F.element_at("upto", least)), F.slice("tokens2", 1, F.element_at("upto2", least)))
    p = p.where((F.size(common) >= least) & (F.get(common, F.lit(0)) == F.col("token"))).select(F.col("doc").alias("x"), F.col("doc2").alias("y"))
    return gone.union(table(nj.verify(p, sets, percent).select("x").distinct(), "gone"))


def finished(t: pa.Table, side: pa.Table, texts: bool) -> pa.Table:
    """Step 5: rows of a piece's documents."""
    if not len(t):
        return pa.Table.from_pylist([], ROWS)
    r = t.to_pylist()[0]
    p, bits = _Piece(r), flags_of(side) & LATE > 0
    gone_ids = side.column("gone").drop_null().to_numpy() - (r["block"] << SET_BITS)
    bits[gone_ids] = True
    has = np.flatnonzero(p.which != NO_SET)
    w = p.which[has].astype(np.int64)
    doc = np.repeat(np.arange(len(p.ids)), np.diff(p.first))
    # a place is an id and a line number: rows that repeat an id share places
    ids, line = p.ids[doc[has]], has - p.first[:-1][doc[has]]
    late = (ids != np.frombuffer(r["docs"], "<i8")[w]) | (line != np.frombuffer(r["lines"], "<u4")[w])
    gone = np.zeros(len(p.starts), bool)
    gone[has] = late | bits[w]
    n, bad = np.bincount(doc[has], minlength=len(p.ids)), np.bincount(doc[gone], minlength=len(p.ids))
    data, out = p.buf.tobytes(), []
    for i in range(len(p.ids)):
        kept = data[p.offs[i] : p.offs[i + 1]]
        if bad[i]:
            s = slice(p.first[i], p.first[i + 1])
            kept = b"\n".join(data[a:b] for a, b in zip(p.starts[s][~gone[s]].tolist(), p.ends[s][~gone[s]].tolist(), strict=True))
        out.append(kept)
    return pa.table([pa.array(p.ids), pa.array(n), pa.array(bad), pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string()), pa.array([x.decode() for x in out] if texts else [None] * len(out), pa.string())], schema=ROWS)


def dedup(docs: DataFrame, *, percent: int = 75, size: int = 5, block_bytes: int = 2 << 20, texts: bool = False) -> DataFrame:
    """A row a row of docs: doc_id, n_lines (with words), n_removed, kept_sha256 (of the
    kept lines, joined by newlines) and text: with ``texts`` the kept text, else null."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(tk.long_id(), F.coalesce("text", F.lit("")).alias("text"))
    _, _, n = tk.block_sizes(spark, d, block_bytes=block_bytes)

    def tidy(out: pa.Table) -> pa.Table:
        tk.release()
        return out

    def to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        if task >= 1 << (63 - SET_BITS - SEQ_BITS):
            raise ValueError("over a million input partitions; read larger ones")
        held, ids, total, number = [], [], 0, task << SEQ_BITS
        for b in batches:
            ids.append(b.column(0))
            held.append(b.column(1))
            total += b.column(1).nbytes
            if total >= block_bytes:
                yield from tidy(piece(held, ids, number, n, size)).to_batches()
                held, ids, total, number = [], [], 0, number + 1
        if held:
            yield from tidy(piece(held, ids, number, n, size)).to_batches()

    def to_signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from signs(r, n).to_batches()

    def to_keys(t: pa.Table, side: pa.Table) -> pa.Table:
        return tidy(nj.send_keys(owned(t.to_pylist()[0], side, size)[0], t.column("block")[0].as_py(), n, percent) if len(t) else rows(nj.KEYS, []))

    def to_candidates(t: pa.Table, side: pa.Table) -> pa.Table:
        if not len(t):
            return pa.Table.from_pylist([], CANDIDATES)
        return tidy(candidates(t.to_pylist()[0], side, size, percent))

    held = table(d.mapInArrow(to_pieces, sql_schema(PIECES)), "pieces")
    folds = table(held.select("block", "k1", "k2", "docs", "lines").mapInArrow(to_signs, sql_schema(SIGNS)).groupBy("bucket").applyInArrow(lambda t: fold(t), FOLDS_SQL), "folds")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    flags = folds.select("block", "bucket", "flags")
    keys = held.select("block", "ids", "sizes", "texts", "which").groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(to_keys, sql_schema(nj.KEYS))
    ranks = table(keys.groupBy("bucket").applyInArrow(lambda t: tidy(nj.rank_keys(t)), sql_schema(nj.RANKS)), "ranks")
    side = flags.select("*", none("keys", "binary"), none("ranks", "binary")).unionByName(ranks.select("block", none("bucket", "long"), none("flags", "binary"), "keys", "ranks"))
    places = held.select("block", "ids", "sizes", "texts", "which", "docs", "lines").groupBy("block")
    found = table(places.cogroup(side.groupBy("block")).applyInArrow(to_candidates, CANDIDATES_SQL), "candidates")
    gone = matched(found, percent)
    twins = folds.where(F.size("twins") > 0).select(F.explode(F.arrays_zip("twins", "owners")).alias("_t")).select("_t.*")
    gone = gone.union(twins.join(gone, F.col("owners") == F.col("_gone"), "left_semi").select("twins"))
    told = flags.select("*", none("gone", "long")).unionByName(gone.select(F.shiftright("_gone", SET_BITS).alias("block"), none("bucket", "long"), none("flags", "binary"), F.col("_gone").alias("gone")))
    out = places.cogroup(told.groupBy("block")).applyInArrow(lambda t, x: tidy(finished(t, x, texts)), sql_schema(ROWS))
    return tk.with_null_ids(out, "doc_id")
