"""Operator 8: remove repeated passages by relative Lempel-Ziv parsing.

A word goes if it lies in a window of ``length`` words that also starts in a
document with a smaller id. ``anchors`` brings passages around shared anchors
together into reference blocks. In a block, passages are taken in order of
their documents and factored greedily against what is indexed so far: a factor
begins with a window of the index, is extended while reference and passage
agree, and makes all its windows duplicates. A factor's end can hide a window
that begins inside it and crosses the boundary, so the next lookup is at the
first window which the factor does not contain. What no factor covers is
indexed for the documents that follow.

Nulls: a null id is one id, smaller than all others; a null text has no words. Documents with equal ids do not count as
earlier ones. Windows are judged on the input. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .anchors import Block, SharedWindows

ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_removed", pa.int64())])


def factors(docs: np.ndarray, lengths: np.ndarray, units: np.ndarray, length: int) -> np.ndarray:
    """Which windows lie in a factor that an earlier document has."""
    first = np.cumsum(lengths) - lengths
    n = lengths - length + 1
    starts = tk.ranges(first, n)
    h = tk.span_hashes(units, starts, starts + length).tolist()
    out = np.zeros(len(h), bool)
    index: dict[int, int] = {}  # window -> where it ends in the reference
    piece = np.repeat(np.arange(len(docs)), lengths)
    ends = (first + lengths).tolist()
    base = 0
    for i, (f, m) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
        p = 0
        while p < m:
            end = index.get(h[base + p])
            if end is None:
                index[h[base + p]] = f + p + length
                p += 1
            elif docs[piece[end - 1]] == docs[i]:
                p += 1
            else:
                room = min(ends[i] - (f + p + length), len(units) - end)
                a, b = units[f + p + length : f + p + length + room], units[end : end + room]
                differ = np.flatnonzero((a != b) | (piece[end : end + room] != piece[end - 1]))
                q = p + 1 + (int(differ[0]) if len(differ) else max(room, 0))
                out[base + p : base + min(q, m)] = True
                p = q
        base += m
    return out


def dedup(docs: DataFrame, *, length: int = 50, k: int = 16, texts: bool = False, block_bytes: int = 2 << 20) -> DataFrame:
    """A row a document: counts and the digest of the kept words joined by a space, or that text."""
    op = SharedWindows(length, k, True, factors)

    def finish(b: Block, dup: np.ndarray) -> pa.Table:
        gone = tk.covered(dup, length)
        n = np.diff(np.concatenate([[0], np.cumsum(gone)])[b.uoffs])
        s, e = b.starts[~gone], b.ends[~gone]
        at = np.searchsorted(s, b.offs)
        # the kept words with a space behind each; the last space of a text is not part of it
        raw = np.append(b.buf, np.uint8(32))
        pos = tk.ranges(s, e - s + 1)
        space = np.cumsum(e - s + 1) - 1
        pos[space] = len(b.buf)
        data = raw[pos].tobytes()
        cut = np.concatenate([[0], np.cumsum(e - s + 1)])[at]
        out = [data[x : max(x, y - 1)] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        if texts:
            return pa.table([pa.array(b.ids), pa.array([x.decode() for x in out], pa.string()), pa.array(n)], schema=TEXTS)
        return pa.table([pa.array(b.ids), pa.array(np.diff(b.uoffs)), pa.array(n), pa.array([hashlib.sha256(x).hexdigest() for x in out])], schema=ROWS)

    return op.run(docs, finish, TEXTS if texts else ROWS, block_bytes)
