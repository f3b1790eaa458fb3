"""Operator 10: language identification by prediction by partial matching.

For every language a byte context tree of orders 0 to ``order`` is counted on a
bounded sample of labelled texts and then frozen. A byte costs -log2 of its
probability: in the longest context seen for the language, a byte seen there
n times has n / (total + distinct), any other escapes with
distinct / (total + distinct) to the next shorter context (method C, without
exclusion); below order 0 all 256 bytes are equally likely. The language with
the shortest code wins.

The cost of a byte depends on it and the ``order`` bytes before it only, so a
batch is scored by looking up its distinct grams once.

Nulls: a null text and one without any letter (Unicode category L) are ``und``
with score 0. Ties go to the language first in code point order. Without
labelled rows every text is ``und``. Very long texts are scored whole, a chunk at
a time. Repeated rows are learned from once and scored each. A column named like
one that is added is replaced; ``prefix`` gives the added ones other names. The
trees of all labels are held by the driver and every worker, so labels must be
few (languages, not free text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import ship
from . import textkit as tk

UND = "und"


def grams(buf: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it in its text (0 before its start)."""
    lengths = np.diff(offs)
    padded = np.zeros(len(buf) + order * len(lengths), np.uint8)
    at = np.arange(len(buf), dtype=np.int64) + np.repeat((np.arange(len(lengths)) + 1) * order, lengths)
    padded[at] = buf
    out = np.zeros(len(buf), np.uint64)
    for j in range(order, -1, -1):
        out = (out << np.uint64(8)) | padded[at - j].astype(np.uint64)
    return out


class Trees:
    """Frozen context trees of all languages, one table of grams an order."""

    def __init__(self, texts: dict[str, list[str]], order: int = 3):
        self.order, self.langs = order, sorted(texts)
        self.tables = []  # by order: contexts, their totals and distinct bytes, grams, their counts
        top = []
        for lang in self.langs:
            buf, offs = tk.pack(pa.array(texts[lang], pa.large_string()))
            top.append(np.unique(grams(buf, offs, order), return_counts=True))
        for k in range(order + 1 if top else 0):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            keys = np.unique(np.concatenate([g & mask for g, _ in top]))
            n = np.zeros((len(keys), len(self.langs)))
            for i, (g, c) in enumerate(top):
                np.add.at(n[:, i], np.searchsorted(keys, g & mask), c)
            ctx, inv = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = (np.zeros((len(ctx), len(self.langs))) for _ in range(2))
            np.add.at(total, inv, n)
            np.add.at(kinds, inv, n > 0)
            self.tables.append((ctx, total, kinds, keys, n))
        self.known = np.zeros(0, np.uint64)
        self.known_bits = np.zeros((0, len(self.langs)), np.float64)

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where((keys[i] == x)[:, None], values[i], 0)

    def bits(self, g: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram, a column a language."""
        p = np.full((len(g), len(self.langs)), 1 / 256)
        for k, (ctx, total, kinds, keys, n) in enumerate(self.tables):
            x = g & np.uint64((1 << 8 * (k + 1)) - 1)
            seen, all_, d = self._at(keys, n, x), self._at(ctx, total, x >> np.uint64(8)), self._at(ctx, kinds, x >> np.uint64(8))
            p = np.where(all_ > 0, np.where(seen > 0, seen, d * p) / np.maximum(all_ + d, 1), p)
        return -np.log2(p)

    def lookup(self, g: np.ndarray) -> np.ndarray:
        """bits() of sorted distinct grams; remembers a bounded number of them."""
        i = np.searchsorted(self.known, g)
        hit = self.known[np.minimum(i, len(self.known) - 1)] == g if len(self.known) else np.zeros(len(g), bool)
        if not hit.all():
            if len(self.known) > 400_000:
                self.known, self.known_bits, new = self.known[:0], self.known_bits[:0], g
            else:
                new = g[~hit]
            keys = np.concatenate([self.known, new])
            o = np.argsort(keys)
            self.known, self.known_bits = keys[o], np.concatenate([self.known_bits, self.bits(new)])[o]
            i = np.searchsorted(self.known, g)
        return self.known_bits[i]

    def code_lengths(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        for a in range(0, len(buf), tk.CHUNK):
            b = min(len(buf), a + tk.CHUNK)
            first = int(doc[a])
            lo = max(a - self.order, int(offs[first]))  # the context before this chunk
            cuts = np.concatenate([[lo], offs[(offs > lo) & (offs < b)], [b]]) - lo
            g = grams(buf[lo:b], cuts, self.order)[a - lo :]
            keys, inv = np.unique(g, return_inverse=True)
            cost, d = self.lookup(keys), doc[a:b] - first
            for i in range(len(self.langs)):
                s = np.bincount(d, weights=cost[:, i][inv])
                out[first : first + len(s), i] += s
        return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learn(docs: DataFrame, held_in: Column, *, order: int = 3, texts_per_lang: int = 200, most_bytes: int = 1 << 18) -> Trees:
    """Trees from at most texts_per_lang different whole texts of each label, each of
    at most most_bytes: the first by a hash of id and text. So the driver gets no
    more than texts_per_lang * most_bytes a label, however often a row repeats."""
    rows = docs.where(held_in & F.col("lang").isNotNull() & (F.octet_length("text") <= most_bytes)).select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    # the first of each part of a label, then the first of these: no task reads all of a frequent label
    first = rows.select("lang", "_h", F.pmod("_h", F.lit(64)).alias("_part")).distinct()
    for keys in (["lang", "_part"], ["lang"]):
        first = first.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_h"))).where(F.col("_n") <= texts_per_lang)
    first = first.select("lang", "_h")
    texts: dict[str, list[str]] = {}
    for r in rows.join(F.broadcast(first), ["lang", "_h"], "left_semi").dropDuplicates(["lang", "_h"]).collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return Trees({k: sorted(v) for k, v in texts.items()}, order)


def identify(docs: DataFrame, trees: Trees, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (the winner's share of the posterior) and bits_per_byte."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trees)
    added = [prefix + c for c in ("lang_pred", "score", "bits_per_byte")]
    names = [c for c in docs.columns if c.lower() not in added]
    d = docs.select(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields), *(f"`{c}` {t}" for c, t in zip(added, ("string", "double", "double"), strict=True))])
    at = [c.lower() for c in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = batch.column(at)
            buf, offs = tk.pack(texts)
            ok = np.array([has_letter(x.as_py()) for x in texts], bool)
            ok &= bool(m.langs)
            pred, score, rate = np.full(len(ok), UND, object), np.zeros(len(ok)), np.zeros(len(ok))
            if ok.any():
                cost = m.code_lengths(buf, offs)
                best = cost.argmin(axis=1)
                least = cost.min(axis=1)
                share = 1 / np.exp2(np.maximum(least[:, None] - cost, -1000)).sum(axis=1)
                pred = np.where(ok, np.array(m.langs, object)[best], UND)
                score = np.where(ok, share, 0.0)
                rate = np.where(ok, least / np.maximum(np.diff(offs), 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], [*names, *added])
            tk.release()

    return d.mapInArrow(run, schema)
