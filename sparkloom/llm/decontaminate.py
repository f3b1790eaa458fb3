"""Operator 1: find benchmark phrases in documents with FM-indexes.

Documents are cut into shards. A shard's words become symbols; a word that no
phrase has becomes a break, and runs of breaks collapse, for no phrase can
cross them. The FM-index of a shard is the Burrows-Wheeler transform of its
symbols in a wavelet matrix, the counts of smaller symbols, and suffix
positions sampled every few symbols and behind each break. Backward search
gives the rows of each phrase, stepping back from a row to a sampled one gives
its position, and the spans of all occurrences are merged.

Phrases are read in blocks of bounded size. A pass over the documents gets a
set number of blocks by broadcast, so what driver and workers hold does not grow
with the benchmark; where one pass isn't enough, runs of hit words and items are
written with the documents and the next pass adds to them. Documents are not
shuffled.

Nulls: a null text has no words; a benchmark row with null text or id is
ignored; repeated items count once an id. Repeated documents are judged each, and
very long texts whole, as a shard of their own. A very long item is cut into
stretches that overlap by a window. Empty tables give no hits or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import textkit as tk
from .shared import table

#: Bytes of documents in a shard, words of phrases in a block, and blocks of a pass.
SHARD_BYTES, BLOCK_WORDS, PASS_BLOCKS = 8 << 20, 1 << 19, 2
RUNS, RUNS_SQL = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "array<struct<start: long, end: long>>"


def suffix_array(seq: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes in order. seq ends with 0; every 0 is a terminator, ordered by position."""
    n, q = len(seq), 64 // bits
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    padded = np.concatenate([seq, np.zeros(q, seq.dtype)]).astype(np.uint64)
    for j in range(q):
        s = padded[j : j + n]
        alive &= s > 0
        key = (key << np.uint64(bits)) | np.where(alive, s, np.uint64(0))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | ~alive[order[1:]]
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(new, at, 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = q
    while len(open_):
        pos, k1 = order[open_], start[open_]
        k2 = rank[pos + h]
        o = np.lexsort((k2, k1))
        pos, k1, k2 = pos[o], k1[o], k2[o]
        new = np.ones(len(pos), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        order[open_] = pos
        start[open_] = first = np.maximum.accumulate(np.where(new, open_, 0))
        rank[pos] = first
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, a level of bits at a time."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            one = ((seq >> b) & 1).astype(bool)
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[~one], seq[one]])

    def place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the i-th place of the sequence leads for symbol c."""
        for b, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            r = ones[i]
            i = np.where((c >> b) & 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before place i."""
        return self.place(c, i) - self.place(c, np.zeros_like(i))

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for ones, zeros in self.levels:
            r = ones[i]
            one = ones[i + 1] - r
            c = (c << 1) | one
            i = np.where(one, zeros + r, i - r)
        return c


class FMIndex:
    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 8):
        self.n = len(seq)
        bits = max(1, int(n_symbols).bit_length())
        sa = suffix_array(seq, bits)
        bwt = seq[sa - 1]
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols + 1))])
        self.tree = WaveletMatrix(bwt, bits)
        marked = (sa % sample == 0) | (bwt == 0)
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = sa[marked]

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.smaller[c] + self.tree.rank(c, i)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 row of each phrase; phrases is (n, length)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            a, b = self.step(c, lo[live]), self.step(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[b > a]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            r = rows[open_]
            done = self.marks[r + 1] > self.marks[r]
            out[open_[done]] = self.samples[self.marks[r[done]]] + steps
            open_, r = open_[~done], r[~done]
            rows[open_] = self.step(self.tree.access(r), r)
            steps += 1
        return out


class Phrases:
    """A block of items cut into windows, as symbols of its own vocabulary."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.vocab = np.unique(np.concatenate([w for _, w in items]))
        found: dict[bytes, list[int]] = {}
        self.ids = sorted({i for i, _ in items})
        number = {x: i for i, x in enumerate(self.ids)}
        for item, w in items:
            s = (np.searchsorted(self.vocab, w) + 1).astype(np.int64)
            for a in range(max(1, len(s) - window + 1)):
                found.setdefault(s[a : a + window].tobytes(), []).append(number[item])
        by_length: dict[int, list[bytes]] = {}
        for p in found:
            by_length.setdefault(len(p) // 8, []).append(p)
        #: (phrases of one length, offsets into owners, owners)
        self.groups = []
        for _, ps in sorted(by_length.items()):
            own = [np.unique(found[p]) for p in ps]
            self.groups.append((np.frombuffer(b"".join(ps), np.int64).reshape(len(ps), -1), np.concatenate([[0], np.cumsum([len(o) for o in own])]), np.concatenate(own)))


def phrase_blocks(bench: DataFrame, window: int, most: int) -> Iterator[Phrases]:
    items, n = [], 0
    for item, text in bench.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        buf, offs = tk.pack(pa.array([text], pa.large_string()))
        buf = tk.LOWER[buf]
        s, e, _ = tk.words(buf, offs, tk.ALNUM)
        w = tk.span_hashes(buf, s, e)
        for a in range(0, max(len(w) - window + 1, min(len(w), 1)), most):
            items.append((str(item), w[a : a + most + window - 1]))
            n += len(items[-1][1])
            if n >= most:
                yield Phrases(items, window)
                items, n = [], 0
    if items:
        yield Phrases(items, window)


def scan(buf: np.ndarray, offs: np.ndarray, blocks: list[Phrases]) -> tuple[np.ndarray, ...]:
    """Of the texts of a shard: word starts and ends, their offsets by text,
    which words are hit, and (text, item) pairs."""
    buf = tk.LOWER[buf]
    s, e, woff = tk.words(buf, offs, tk.ALNUM)
    h = tk.span_hashes(buf, s, e)
    mark = np.zeros(len(s) + 1, np.int64)
    pairs: list[tuple[int, str]] = []
    for block in blocks:
        sym = np.searchsorted(block.vocab, h)
        sym = np.where(block.vocab[np.minimum(sym, len(block.vocab) - 1)] == h, sym + 1, 0)
        # a break stands behind each text; runs of breaks collapse
        seq = np.insert(sym, woff[1:], 0)
        word = np.insert(np.arange(len(s)), woff[1:], -1)
        keep = (seq > 0) | np.append(True, seq[:-1] > 0)
        seq, word = seq[keep], word[keep]
        if not seq.any():
            continue
        index = FMIndex(seq, len(block.vocab))
        for phrases, own_off, own in block.groups:
            lo, hi = index.search(phrases)
            rows = tk.ranges(lo, hi - lo)
            if not len(rows):
                continue
            at = word[index.locate(rows)]
            which = np.repeat(np.arange(len(phrases)), hi - lo)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + phrases.shape[1], -1)
            text = np.searchsorted(woff, at, side="right") - 1
            for t, p in np.unique(np.stack([text, which], 1), axis=0):
                pairs += [(int(t), block.ids[i]) for i in own[own_off[p] : own_off[p + 1]]]
    return s, e, woff, np.cumsum(mark[:-1]) > 0, pairs


def shards(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SHARD_BYTES."""
    a = 0
    while a < len(offs) - 1:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + SHARD_BYTES, side="right")) - 1)
        yield a, b
        a = b


def decontaminate(docs: DataFrame, bench: DataFrame, *, window: int = 10, keep: list[str] = ("doc_id",), prefix: str = "", block_words: int = BLOCK_WORDS, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """The kept columns with n_words, n_hit, items (sorted as strings) and
    spans: merged byte ranges [start, end) of the text to remove. A kept column
    named like one of these is replaced; ``prefix`` gives them other names.

    A pass takes ``pass_blocks`` blocks of about ``block_words`` words of phrases.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    added = [prefix + c for c in ("n_words", "n_hit", "items", "spans")]
    keep = [c for c in keep if c.lower() not in added]
    k = len(keep)
    state = [F.array().cast(RUNS_SQL), F.array().cast("array<string>")]
    d = docs.select(*keep, docs["text"], *state)
    kinds = [f.dataType.simpleString() for f in d.schema.fields[:k]]
    names = [f"c{i}" for i in range(k + 3)]
    d = d.toDF(*names)
    between = ", ".join(f"{c} {t}" for c, t in zip(names, [*kinds, "string", RUNS_SQL, "array<string>"], strict=True))
    result = ", ".join(f"`{c}` {t}" for c, t in zip([*keep, *added], [*kinds, "long", "long", "array<string>", RUNS_SQL], strict=True))

    def one_pass(sent: list, last: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [b.value for b in sent]
            for batch in batches:
                buf, offs = tk.pack(batch.column(k))
                for a, b in shards(offs):
                    part = batch.slice(a, b - a)
                    s, e, woff, hit, pairs = scan(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], blocks)
                    for t, before in enumerate(part.column(k + 1).to_pylist()):
                        for r in before:
                            hit[woff[t] + r["start"] : woff[t] + r["end"]] = True
                    items = [set(x) for x in part.column(k + 2).to_pylist()]
                    for t, x in pairs:
                        items[t].add(x)
                    total = np.concatenate([[0], np.cumsum(hit)])
                    edge = hit & ~np.append(False, hit[:-1])
                    edge[woff[:-1][woff[:-1] < len(hit)]] |= hit[woff[:-1][woff[:-1] < len(hit)]]
                    first = np.flatnonzero(edge)
                    after = first + total[np.append(first, len(hit))[1:]] - total[first]  # behind the run's last word
                    text = np.searchsorted(woff, first, side="right") - 1
                    start, end = (s[first] + offs[a] - offs[a + text], e[after - 1] + offs[a] - offs[a + text]) if last else (first - woff[text], after - woff[text])
                    runs = [[] for _ in range(b - a)]
                    for t, x, y in zip(text.tolist(), start.tolist(), end.tolist(), strict=True):
                        runs[t].append({"start": x, "end": y})
                    found, runs = pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(runs, RUNS)
                    if last:
                        yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(np.diff(woff)), pa.array(total[woff[1:]] - total[woff[:-1]]), found, runs], [*keep, *added])
                    else:
                        yield pa.RecordBatch.from_arrays([*part.columns[: k + 1], runs, found], names)

        return run

    blocks = phrase_blocks(bench, window, block_words)
    sent = [sc.broadcast(b) for b in islice(blocks, pass_blocks)]
    while (more := next(blocks, None)) is not None:
        d = table(d.mapInArrow(one_pass(sent, False), between), "decontaminated")
        for b in sent:
            b.destroy()
        sent = [sc.broadcast(b) for b in islice(chain([more], blocks), pass_blocks)]
    return d.mapInArrow(one_pass(sent, True), result)


def sha256_items(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
