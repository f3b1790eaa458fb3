"""Embeddings learned from a corpus: rare-word weights and the leading directions of the term matrix.

Words are hashed into a fixed number of features. A feature weighs by its rarity,
a text is the unit vector of (1 + log of its count) times that. The directions are
the leading right singular vectors of the matrix of all texts, by subspace
iteration: a round multiplies a block of vectors with the matrix and back, in
executors over batches of texts, and Spark adds the parts up by feature. The
driver holds only features x directions numbers, whatever the number of texts.

A null or empty text is the zero vector. Two texts without a common word can be
near, if their words stand with the same others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, stored
from .lexical import words_of

#: Numbers of a matrix that a worker makes at a time, and bytes of texts that it splits at a time.
CELLS, TEXT = 1_000_000, 1_000_000
NONE = np.zeros(0, np.int64)


def feature(word: str, features: int) -> int:
    """The feature of a word, by the first bits of its MD5, so that other engines find the same."""
    return int.from_bytes(hashlib.md5(word.encode(errors="replace")).digest()[:4], "big") % features


class Features(dict):
    """Features of the words seen."""

    def __init__(self, features: int):
        self.features = features

    def __missing__(self, word: str) -> int:
        f = self[word] = feature(word, self.features)
        return f


def cut(texts: pa.Array, features: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of pieces of at most CELLS rows x features and about TEXT bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    i = 0
    while i < len(texts):
        n = int(np.searchsorted(np.cumsum(size[i : i + max(1, CELLS // features)]), TEXT)) + 1
        n = min(n, max(1, CELLS // features), len(texts) - i)
        yield i, n
        i += n


def term_counts(docs: DataFrame, key: str, content: str, features: int, most_words: int = 300_000) -> DataFrame:
    """key and terms: an array of (feature, count) of each row with words. Nothing is shuffled; a
    worker keeps the features of at most about most_words words."""
    ship(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    struct = pa.struct([("feature", pa.int32()), ("count", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(features)
        for b in batches:
            for i, n in cut(b.column(1), features):
                if len(known) > most_words:
                    known = Features(features)
                found = [np.fromiter(map(known.__getitem__, words_of(t.lower())), np.int64) if (t := x.as_py()) else NONE for x in b.column(1).slice(i, n)]
                # the counts of a piece as one table, rows x features
                at = np.repeat(np.arange(n), [len(f) for f in found]) * features + np.concatenate(found)
                table = np.bincount(at, minlength=n * features)
                some = np.flatnonzero(table)
                size = np.bincount(some // features, minlength=n)
                rows = np.flatnonzero(size)
                posts = pa.StructArray.from_arrays([pa.array((some % features).astype(np.int32)), pa.array(table[some].astype(np.int32))], fields=list(struct))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + rows)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[rows])).astype(np.int32)), posts)], [key, "terms"])

    return docs.select(key, content).mapInArrow(run, f"`{key}` {kind}, terms array<struct<feature: int, count: int>>")


def weights(counts: DataFrame, rows: int) -> DataFrame:
    """feature, df and idf; at most one row a feature."""
    d = counts.select(F.explode("terms.feature").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    return d.withColumn("idf", F.log((1 + rows) / (1 + F.col("df"))) + 1)


def sparse(terms: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of a batch's unit vectors."""
    size = np.diff(terms.offsets.to_numpy())
    flat = terms.flatten()  # of a slice its own only
    f, c = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    row = np.repeat(np.arange(len(terms)), size)
    v = (1 + np.log(c)) * idf[f]
    norm = np.sqrt(np.bincount(row, v * v, minlength=len(terms)))
    return row, f, v / np.where(norm > 0, norm, 1)[row]


def dense(terms: pa.Array, idf: np.ndarray) -> Iterator[np.ndarray]:
    """A batch's unit vectors as matrices of at most CELLS numbers."""
    rows = max(1, CELLS // len(idf))
    for i in range(0, len(terms), rows):
        row, f, v = sparse(terms.slice(i, rows), idf)
        out = np.zeros((min(rows, len(terms) - i), len(idf)), np.float32)
        out[row, f] = v
        yield out


@dataclass
class Lsa:
    """idf of each feature, directions (features x size, orthonormal) and their singular values.
    counts: the term counts of what it was learned from."""

    idf: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    counts: DataFrame | None = None

    def embed(self, docs: DataFrame, key: str = "doc_id", content: str = "text", out: str = "embedding", counts: DataFrame | None = None) -> DataFrame:
        """docs with a unit vector in the directions, zeros for a text without known words; keys differ and aren't null.
        counts: the docs' term counts where they are known."""
        ship(docs.sparkSession)
        idf, v, size = self.idf, self.directions.astype(np.float32), self.directions.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.concatenate([np.zeros((0, size), np.float32), *(d @ v for d in dense(b.column(1), idf))])
                norm = np.sqrt((x * x).sum(axis=1))
                x = (x / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * size, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["_key", out])

        counts = term_counts(docs, key, content, len(idf)) if counts is None else counts
        counts = counts.select(F.col(key).alias("_key"), "terms")
        made = counts.mapInArrow(run, f"_key {dict(docs.dtypes)[key]}, {out} array<float>")
        zero = F.array_repeat(F.lit(0.0).cast("float"), size)
        return docs.join(made, docs[key] == F.col("_key"), "left").withColumn(out, F.coalesce(out, zero)).drop("_key")


def learn(docs: DataFrame, key: str = "doc_id", content: str = "text", size: int = 64, features: int = 4096, rounds: int = 5, seed: int = 5) -> Lsa:
    """The embedding of a corpus; keys differ. rounds: multiplications with the matrix and back."""
    ship(docs.sparkSession)
    counts = stored(term_counts(docs, key, content, features), "terms")
    rows = counts.count()
    idf = np.zeros(features)
    for r in weights(counts, rows).collect():  # at most one row a feature
        idf[r.feature] = r.idf
    size = min(size, features)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, size)))[0]
    values = np.zeros(size)
    names = [f"v{i}" for i in range(size)]
    for _ in range(rounds):
        right = q.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((features, size))
            for b in batches:
                for d in dense(b.column(0), idf):
                    total += d.T @ (d @ right)
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(total[some, i]) for i in range(size)]], ["feature", *names])

        parts = counts.select("terms").mapInArrow(run, "feature int, " + ", ".join(f"{n} double" for n in names))
        got = parts.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        y = np.zeros((features, size))
        if len(got):
            y[got["feature"].to_numpy()] = np.column_stack([got[n].to_numpy() for n in names])
        q, r = np.linalg.qr(y)
        # the directions in the order of their strength, within the subspace
        u, s, _ = np.linalg.svd(r)
        q, values = q @ u, np.sqrt(s)
    return Lsa(idf, q, values, counts)
