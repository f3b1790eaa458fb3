"""Operator 13: pack tokenised documents into windows by minimum bin slack.

A task reads its documents in blocks of tokens. Whole windows of a document are
sequences of their own. What is left of each is an item; the items of a block are
a multiset of lengths. A window starts with the longest item, and a bitset
subset-sum program finds the multiset of the others that comes closest to its
capacity; the counts are found by going back through its bitsets. A multiset is
used as often as the counts allow. Slack that no item fits is closed by cutting
an item. A block leaves at most one window unfilled, whose items go on to the
next block; the task's last one is cut into powers of two, which need no padding.

So there is no shuffle, memory follows the block, and a lost task is run again
with the same result.

Nulls: a null text is an empty one, which still has its end token. Repeated rows
and rows with equal or null ids are documents of their own. Ties: items of equal
length are taken as they were read. Very long texts are cut into windows; one
text's tokens are held at a time. An empty table gives no rows. Extra columns
aren't read, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .phrases import gathered
from .textkit import ALNUM, LOWER, ranges, release
from .textkit import pack as packed

STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".,;:!?"]] = True
#: Words longer than this (in bytes) are not kept in a worker's cache.
LONG_WORD = 64
SCHEMA = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def fill(left: np.ndarray, capacity: int) -> tuple[int, dict[int, int]]:
    """The sum nearest to capacity that a multiset of lengths can give, and its counts.

    left[x] is how many items of length x there are. A bit of a bitset tells
    whether a sum can be had; counts are split into powers of two.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for x in np.flatnonzero(left[: capacity + 1])[::-1].tolist():
        most, m = min(int(left[x]), capacity // x), 1
        while most:
            m = min(m, most)
            steps.append((x, m, reach))
            reach |= (reach << (x * m)) & mask
            most -= m
            m *= 2
        if reach >> capacity & 1:
            break
    best = at = reach.bit_length() - 1
    out: dict[int, int] = {}
    for x, m, before in reversed(steps):
        if not before >> at & 1:
            out[x] = out.get(x, 0) + m
            at -= x * m
    return best, out


class Items:
    """Pieces of documents by length: (row, start) of each, the oldest first."""

    def __init__(self, capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        self.held: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, length: int, row: int, start: int) -> None:
        self.held[length].append((row, start))
        self.left[length] += 1

    def take(self, length: int) -> tuple[int, int, int]:
        self.left[length] -= 1
        return (*self.held[length].pop(), length)


def windows(items: Items, capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """The windows of the items as lists of (row, start, length); all are full but the last."""
    for h in items.held:
        h.reverse()
    while (found := np.flatnonzero(items.left)).size:
        longest = int(found[-1])
        items.left[longest] -= 1
        best, need = fill(items.left, capacity - longest)
        items.left[longest] += 1
        need[longest] = need.get(longest, 0) + 1
        slack = capacity - longest - best
        cut = next((x for x in found[::-1].tolist() if items.left[x] > need.get(x, 0)), 0) if slack else 0
        if cut:
            need[cut] = need.get(cut, 0) + 1
        for _ in range(min(int(items.left[x]) // m for x, m in need.items())):
            out = []
            for x, m in need.items():
                out += [items.take(x) for _ in range(m - (x == cut))]
            if cut:
                row, start, _ = items.take(cut)
                out.append((row, start, slack))
                items.add(cut - slack, row, start + slack)
            yield out


def powers_of_two(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A window that is not full as sequences whose lengths are powers of two."""
    total, rest = sum(x for _, _, x in window), list(window)
    for b in reversed(range(total.bit_length())):
        room, out = (total >> b & 1) << b, []
        while room:
            row, start, n = rest[0]
            k = min(n, room)
            out.append((row, start, k))
            rest[:1] = [(row, start + k, n - k)] if n > k else []
            room -= k
        if out:
            yield out


class Tokens:
    """Token ids of texts by a tokenizers file of a byte-level vocabulary, with the ids of words kept.

    Such a vocabulary never joins a space to what stands before it, nor a letter to
    a stop behind it. So texts are cut before spaces that follow anything but white
    space and before stops that follow a letter or digit, and each different word of
    a batch is looked up once. Words that are not known are put through the
    tokenizer end to end; the lengths of tokens tell which belong to which.
    """

    def __init__(self, spec: str, end_id: int | None, most_words: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.end_id, self.most = Tokenizer.from_str(spec), end_id, most_words
        #: Words seen lately, and those seen before them; a word that is met again stays.
        self.known, self.older = {}, {}
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for name, i in vocabulary.items():
            self.bytes[i] = len(name)  # a character of a token's name stands for a byte

    def learn(self, names: list[bytes]) -> None:
        """Put words that are not known through the tokenizer."""
        apart = lambda w: w[:1] != b" "  # noqa: E731  joined, they might make other tokens
        alone = [w for w in names if apart(w)]
        for w, e in zip(alone, self.model.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, np.int32).tobytes()
        rest = [w for w in names if not apart(w)]
        for i in range(0, len(rest), 2000):
            some = rest[i : i + 2000]
            ids = np.array(self.model.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            cut = np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1
            raw = ids.tobytes()
            for w, x, y in zip(some, np.append(0, cut[:-1] * 4).tolist(), (cut * 4).tolist(), strict=True):
                self.known[w] = raw[x:y]

    def lookup(self, names: list[bytes]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        new = []
        for w in names:
            if w not in self.known:
                if w in self.older:
                    self.known[w] = self.older[w]
                else:
                    new.append(w)
        self.learn(new)
        out = [self.known[w] for w in names]
        for w in new:
            if len(w) > LONG_WORD:
                del self.known[w]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n+1 offsets."""
        buf, offs = packed(texts)
        n = len(offs) - 1
        mark = np.zeros(len(buf) + 1, bool)
        cut = np.flatnonzero(buf[1:] == 0x20) + 1
        a, b, c = (buf[np.maximum(cut - k, 0)] for k in (3, 2, 1))
        # fixed values: the last bytes of white space beyond ASCII; a few other letters are left uncut too
        wide = ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
        mark[cut[(c > 0x20) & ~wide]] = True
        cut = np.flatnonzero(STOPS[buf[1:]]) + 1
        b, c = buf[np.maximum(cut - 2, 0)], buf[cut - 1]
        mark[cut[ALNUM[LOWER[c]] & (c < 0x80) | (b == 0xC3) & (c >= 0x80) & (c != 0x97) & (c != 0xB7)]] = True
        mark[offs[:-1][offs[1:] > offs[:-1]]] = True
        at = np.flatnonzero(mark)
        word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(buf)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = word.dictionary_encode()
        ids = self.lookup(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        values, start = np.frombuffer(b"".join(ids), np.int32), np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False)
        each = size[which]
        flat = values[ranges(start[which], each)] if len(which) else np.zeros(0, np.int32)
        ends = np.append(0, np.cumsum(each))[np.searchsorted(at, offs)]
        if self.end_id is not None:
            flat = np.insert(flat, ends[1:], np.int32(self.end_id))
            ends = ends + np.arange(n + 1)
        return flat, ends


class Block:
    """Documents that are being packed, and what was made of them."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.rows: list[tuple] = []  # (id, tokens of the document, start of the ids held, ids)
        self.items, self.made, self.tokens = Items(capacity), [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        row, n = len(self.rows), len(ids)
        self.rows.append((doc_id, n, 0, ids))
        for s in range(0, n - n % self.capacity, self.capacity):
            self.put([(row, s, self.capacity)])
        if n % self.capacity:
            self.items.add(n % self.capacity, row, n - n % self.capacity)
        self.tokens += n

    def put(self, window: list[tuple[int, int, int]]) -> None:
        offset = 0
        for row, start, length in window:
            self.made.append((row, start, length, self.next, offset))
            offset += length
        self.next += 1

    def flush(self, last: bool) -> pa.RecordBatch:
        """What is packed so far; the window that is left is kept, or cut up if it is the last one."""
        rest = None
        for w in windows(self.items, self.capacity):
            if sum(x for _, _, x in w) == self.capacity:
                self.put(w)
            else:
                rest = w
        if rest and last:
            for w in powers_of_two(rest):
                self.put(w)
            rest = None
        self.made.sort()
        cells = [self.rows[r] for r, *_ in self.made]
        ids = [c[3][s - c[2] : s - c[2] + n] for c, (_, s, n, _, _) in zip(cells, self.made, strict=True)]
        length = np.array([len(x) for x in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        col = lambda x: pa.array(x, pa.int64())
        out = pa.RecordBatch.from_arrays([col([c[0] for c in cells]), col([m[1] for m in self.made]), col(length), lists, col([c[1] for c in cells]), col([m[3] for m in self.made]), col([m[4] for m in self.made])], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        old, self.rows, self.items, self.made, self.tokens = self.rows, [], Items(self.capacity), [], 0
        for row, start, n in rest or []:
            doc_id, tokens, first, have = old[row]
            self.items.add(n, len(self.rows), start)
            self.rows.append((doc_id, tokens, start, have[start - first : start - first + n].copy()))
            self.tokens += n
        return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 1, block_tokens: int = 1 << 20) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    tokenizer: a tokenizers file, which is sent to the executors. end_id: put
    behind each document. A sequence holds its pieces by offset; its number has
    the task's in the upper bits.
    """
    spec = Path(tokenizer).read_text(encoding="utf-8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, block = None, Block(capacity, TaskContext.get().partitionId() << 40)
        for b in gathered(batches, 4 * block_tokens):
            tokens = tokens or Tokens(spec, end_id)
            # texts of about a block's tokens at a time
            size = np.append(0, np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)))
            cuts = [0, *np.flatnonzero(np.diff(size // (4 * block_tokens))) + 1, b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                ids, offs = tokens.encode(b.column(1)[i:j])
                for k, doc_id in enumerate(b.column(0)[i:j].to_pylist()):
                    block.add(doc_id, ids[offs[k] : offs[k + 1]])
                    if block.tokens >= block_tokens:
                        yield block.flush(False)
                        release()
        yield block.flush(True)

    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids and the start of each document's piece; a sequence has at most its capacity of ids."""
    p = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    g = pieces.groupBy("sequence_id").agg(p.alias("_p"))
    return g.select("sequence_id", F.flatten(F.transform("_p", lambda x: x["ids"])).alias("ids"), F.transform("_p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("_p", lambda x: x["offset"]).alias("offsets"))
