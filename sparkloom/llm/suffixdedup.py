"""Operator 7: remove repeated byte strings by longest previous factors.

A byte goes if it lies in a string of ``length`` bytes that also starts in a
document with a smaller id. ``anchors`` brings the texts around shared anchors
together; here they are sorted into a suffix array, cut at ``length`` bytes, with
the lengths that neighbours have in common, cut likewise. For every suffix the
previous and the next one in suffix order that an earlier document has are found
by pointer jumping, together with the least common length on the way; the greater
of the two is the longest previous factor. Where it reaches ``length``, the window
goes; the first document keeps it. Only suffixes that share all ``length`` bytes with
a neighbour can have a factor that long; the others are left out before, so the
lengths in common that are used are 0 and ``length``, and the search runs within
groups of equal windows. Shorter factors are not worked out. Runs that
are equal within or across blocks are marked by a 64-bit hash before, in
``anchors``.

Nulls: a null id is one id, smaller than all others; a null text is empty. Documents with equal ids do not count as earlier
ones. Windows are judged on the input. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .anchors import Block, SharedWindows

#: Suffixes sorted at a time.
SLICE = 1 << 17

ROWS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_removed", pa.int64())])


def suffixes(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at starts in order of their first ``length`` bytes, equal ones
    in order of position, and whether each has these in common with the one before."""
    words = -(-length // 8)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    same = np.ones(len(starts), bool)
    open_ = np.arange(len(starts))  # places whose suffix is equal to a neighbour so far
    for i in range(words):
        at = min(8 * i, length - 8) if length >= 8 else 0
        x = starts[order[open_]] + at
        w = np.zeros(len(x), np.uint64)
        for j in range(8):
            w = (w << np.uint64(8)) | (padded[x + j] if j < length else np.uint64(0))
        o = np.lexsort((w, group[open_]))
        order[open_], w = order[open_][o], w[o]
        edge = np.ones(len(x), bool)
        edge[1:] = (w[1:] != w[:-1]) | (group[open_][1:] != group[open_][:-1])
        group[open_] = open_[np.maximum.accumulate(np.where(edge, np.arange(len(x)), 0))]
        same[open_[edge]] = False
        alone = edge & np.append(edge[1:], True)
        open_ = open_[~alone]
        if not len(open_):
            break
    return order, same


def nearest_earlier(docs: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of each suffix the length it shares with the nearest one before it, in suffix
    order, that an earlier document has; 0 where there is none. common[i] is what
    i - 1 and i share; where that is 0 the search ends."""
    at, low = np.arange(len(docs)) - 1, common.copy()
    open_ = np.flatnonzero((low > 0) & (at >= 0))
    open_ = open_[docs[at[open_]] >= docs[open_]]
    while len(open_):
        # all between at[j] and j belong to documents not before that of j, so they can be skipped
        j = at[open_]
        to, least = at[j], np.minimum(low[open_], low[j])
        at[open_], low[open_] = to, np.where(to < 0, 0, least)
        open_ = open_[low[open_] > 0]
        open_ = open_[docs[at[open_]] >= docs[open_]]
    return low


def longest_previous(docs: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes in order: by the previous and the next smaller document."""
    back = np.concatenate([[0], common[:0:-1]]) if len(common) else common
    return np.maximum(nearest_earlier(docs, common), nearest_earlier(docs[::-1], back)[::-1])


def earlier_factors(docs: np.ndarray, lengths: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor in another document reaches ``length``, at each window."""
    first = np.cumsum(lengths) - lengths
    n = lengths - length + 1
    starts, doc = tk.ranges(first, n), np.repeat(docs, n)
    out = np.zeros(len(starts), bool)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    lead = np.zeros(len(starts), np.uint64)
    for j in range(min(8, length)):
        lead = (lead << np.uint64(8)) | padded[starts + j]
    by_lead = np.argsort(lead, kind="stable")
    lead = lead[by_lead]
    edges = np.append(np.flatnonzero(np.append(True, lead[1:] != lead[:-1])), len(lead))
    del lead
    a = 0
    while a < len(starts):  # a stretch of the suffix array at a time, cut between different first words
        b = int(edges[np.searchsorted(edges, min(a + SLICE, len(starts)))])
        part = np.sort(by_lead[a:b])
        order, same = suffixes(text, starts[part], length)
        some = np.flatnonzero(same | np.append(same[1:], False))
        x = part[order[some]]
        out[x] = longest_previous(doc[x], np.where(same[some], length, 0)) >= length
        a = b
    return out


def removed(b: Block, dup: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gone = tk.covered(dup, length)
    total = np.concatenate([[0], np.cumsum(gone)])
    edge = gone & ~np.append(False, gone[:-1])[: len(gone)]
    heads = b.uoffs[:-1][b.uoffs[1:] > b.uoffs[:-1]]
    edge[heads] = gone[heads]
    spans = np.concatenate([[0], np.cumsum(edge)])
    return gone, np.diff(total[b.uoffs]), np.diff(spans[b.uoffs])


def dedup(docs: DataFrame, *, length: int = 50, k: int = 24, texts: bool = False, block_bytes: int = 2 << 20) -> DataFrame:
    """A row a document: counts and the digest of what is kept, or with ``texts``
    the kept text (bytes of characters cut in two are dropped from it)."""
    op = SharedWindows(length, k, False, earlier_factors)

    def finish(b: Block, dup: np.ndarray) -> pa.Table:
        gone, n, spans = removed(b, dup, length)
        kept, out = ~gone, []
        for i in range(len(b.ids)):
            s = slice(b.offs[i], b.offs[i + 1])
            out.append((b.buf[s][kept[s]] if n[i] else b.buf[s]).tobytes())
        if texts:
            return pa.table([pa.array(b.ids), pa.array([x.decode(errors="ignore") for x in out], pa.string()), pa.array(n)], schema=TEXTS)
        return pa.table([pa.array(b.ids), pa.array(np.diff(b.offs)), pa.array(n), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in out])], schema=ROWS)

    return op.run(docs, finish, TEXTS if texts else ROWS, block_bytes)
