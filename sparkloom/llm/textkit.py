"""Vectorised byte-level text primitives shared by the operators.

All work is done on the UTF-8 bytes of a batch of texts laid end to end.
White space, ASCII letters and digits are single bytes in UTF-8 and never part
of a longer character, so tokenising and lower-casing bytes gives the same
words as tokenising characters.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240917))
#: A random 64-bit value per byte; fixed by the seed, so hashes agree everywhere.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes hashed at a time, so that long texts take no more memory than short ones.
CHUNK = 1 << 19

_table = np.ones(256, dtype=bool)
_table[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = _table
_table = np.zeros(256, dtype=bool)
_table[0x30:0x3A] = _table[0x61:0x7B] = _table[0x80:] = True
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = _table
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        m = max(n, CHUNK + 4096)
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(m, base, dtype=np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def pack(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end as bytes, and n+1 offsets. A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the n+1 offsets of each text's words."""
    inside = table[buf]
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[offs[full]] = False
    starts = np.flatnonzero(inside & ~before)
    before[:-1] = inside[1:]
    before[offs[full + 1] - 1] = False
    ends = np.flatnonzero(inside & ~before) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each span; spans are sorted by start and not empty.

    values are bytes or 64-bit hashes. Works a chunk at a time.
    """
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        base = int(s[i])
        j = max(i + 1, int(np.searchsorted(s, base + CHUNK)))
        end = int(e[i:j].max())
        v = values[base:end]
        p, ip = powers(end - base + 1)
        sums = np.zeros(end - base + 1, np.uint64)
        np.cumsum((BYTE_VALUE[v] if values.dtype == np.uint8 else v) * p[: end - base], out=sums[1:])
        a = s[i:j] - base
        out[i:j] = (sums[e[i:j] - base] - sums[a]) * ip[a]
        i = j
    return mix(out)


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i:i+k] for every i (no chunking; callers pass bounded arrays)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, ip = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((BYTE_VALUE[values] if values.dtype == np.uint8 else values) * p[: len(values)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * ip[:n])


def sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """Position of the least key in each window of w; the first of equal ones.

    The order is by the upper 40 bits of a key; len(keys) must be below 2**24.
    """
    low = np.uint64((1 << 24) - 1)
    m = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    n, size = len(keys) - w + 1, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return (np.minimum(m[:n], m[w - size : w - size + n]) & low).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i]+lengths[i]-1, one after another."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def covered(dup: np.ndarray, length: int) -> np.ndarray:
    """Which positions lie in a window of that length that starts at a set bit."""
    c = np.cumsum(dup, dtype=np.int32 if len(dup) < 2**31 else np.int64)
    c[length:] -= c[:-length].copy() if len(c) > length else 0
    return c > 0


def release() -> None:
    """Give memory that Arrow and malloc keep back to the system; a worker lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Stands for a null document id while rows are in blocks: smaller than all others.
NO_ID = -(2**63)


def long_id(name: str = "doc_id"):
    from pyspark.sql import functions as F

    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(name)


def with_null_ids(df, *names: str):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in names})


def block_sizes(spark, docs, text: str = "text", block_bytes: int = 4 << 20):
    """Rows, bytes and the number of blocks of about block_bytes that hold them."""
    from pyspark.sql import functions as F

    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return rows, size, max(1, -(-int(size) // block_bytes))
