"""Nearest vectors to many queries: an exact product in blocks, and an inverted-file index.

The index has lists, one a centroid. Centroids come from k-means on a bounded
sample; every vector is put into the list of its nearest one, and a search reads
the lists nearest to each query only and scores their vectors exactly.

Both searches put equal vectors together first: of equal ones only the k smallest
ids can be among the k best, so a vector that a third of the rows share is scored
once. Pairs of blocks are scored by a matrix product; a task holds one block of
vectors and one of queries. Scores are cosines rounded to 6 digits, ties by id.
A null vector is not found and finds nothing; one without length has cosine 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import scratch, ship, stored

#: Scores that a worker makes at a time.
SCORES = 1_000_000
FOUND = "query long, group long, score double"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows; a vector of another size or without length is a row of zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dim))
    good = size == dim
    out[good] = flat[np.repeat(good, size)].reshape(-1, dim)
    out[~np.isfinite(out).all(axis=1)] = 0
    norm = np.sqrt((out * out).sum(axis=1))
    out[norm > 0] /= norm[norm > 0, None]
    return out


def top_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k greatest scores, and of those that equal the last of them."""
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k]
        return np.nonzero(scores >= least[:, None])
    return tuple(x.ravel() for x in np.indices(scores.shape))


def tiles(v: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of q, rows of v and scores of the k best for each row of q, of at most about SCORES scores at a time."""
    step = max(1, SCORES // max(1, len(v)))
    for i in range(0, len(q), step):
        s = q[i : i + step] @ v.T
        np.round(s, 6, out=s)
        s += 0.0
        r, c = top_rows(s, k)
        yield r + i, c, s[r, c]


def folded(vectors: DataFrame, k: int, key: str, vector: str) -> tuple[DataFrame, DataFrame, int]:
    """(group, vector) of different vectors, (group, id) of the k smallest ids of each, and the dimension."""
    d = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector")).where(F.col("vector").isNotNull() & F.col("id").isNotNull())
    d = d.withColumn("group", F.xxhash64(F.col("vector").cast("string")))
    d = d.withColumn("_n", F.row_number().over(W.partitionBy("group").orderBy("id"))).where(F.col("_n") <= k)
    d = stored(d, "folded")
    dim = d.select(F.max(F.size("vector"))).first()[0] or 1
    return d.where("_n = 1").select("group", "vector"), d.select("group", "id"), dim


def _scored(left: DataFrame, right: DataFrame, keys: list[str], k: int, dim: int) -> DataFrame:
    """The k best groups for each query of each pair of blocks, which share the keys."""

    def run(_, a: pa.Table, b: pa.Table) -> pa.Table:
        query, group, score = [], [], []
        if len(a) and len(b):
            ids, asked = a["group"].to_numpy(), b["query"].to_numpy()
            for r, c, s in tiles(matrix(a["vector"], dim), matrix(b["vector"], dim), k):
                query.append(asked[r])
                group.append(ids[c])
                score.append(s)
        cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"query": cat(query, pa.int64()), "group": cat(group, pa.int64()), "score": cat(score, pa.float64())})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, FOUND)


def _best(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """query, rank, id and score of the k best ids of each query."""
    w = W.partitionBy("query").orderBy(F.desc("score"), "id")
    d = found.distinct().withColumn("_r", F.rank().over(W.partitionBy("query").orderBy(F.desc("score")))).where(F.col("_r") <= k)
    d = d.join(members, "group").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return d.select("query", "rank", "id", "score")


def _queries(queries: DataFrame, key: str, vector: str) -> DataFrame:
    d = queries.select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<float>").alias("vector"))
    return d.where(F.col("query").isNotNull() & F.col("vector").isNotNull())


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", vector: str = "embedding", block: int = 20_000) -> DataFrame:
    """query, rank, id, score: the k nearest vectors to each query, by comparing all blocks."""
    ship(vectors.sparkSession)
    groups, members, dim = folded(vectors, k, key, vector)
    return _best(_compared(groups, _queries(queries, key, vector), k, dim, block), members, k)


def _compared(groups: DataFrame, q: DataFrame, k: int, dim: int, block: int) -> DataFrame:
    """The k best groups for each query of each pair of blocks, all blocks of groups against all of queries."""
    n_v, n_q = (max(1, -(-d.count() // block)) for d in (groups, q))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = groups.withColumn("_v", F.pmod(F.xxhash64("group"), F.lit(n_v)).cast("long")).withColumn("_q", spread(n_q))
    right = q.withColumn("_q", F.pmod(F.xxhash64("query"), F.lit(n_q)).cast("long")).withColumn("_v", spread(n_v))
    return _scored(left, right, ["_v", "_q"], k, dim)


@dataclass
class Index:
    """lists: list, part, group and vector, in folders by list; members: group and id."""

    lists: DataFrame
    members: DataFrame
    parts: DataFrame
    centroids: np.ndarray
    k: int
    probes: int


def centroids_of(vectors: DataFrame, n: int, sample_rows: int = 20_000, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of n lists by k-means on the directions of at most about sample_rows vectors."""
    rows = vectors.count()
    some = vectors.select("vector").sample(fraction=min(1.0, sample_rows / max(rows, 1)), seed=seed).toArrow()
    dim = max([1, *np.diff(pa.concat_arrays(some["vector"].chunks).offsets.to_numpy())]) if len(some) else 1
    x = matrix(some["vector"], int(dim)) if len(some) else np.zeros((1, 1))
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        norm = np.sqrt((total * total).sum(axis=1))
        c = np.where(norm[:, None] > 0, total / np.where(norm > 0, norm, 1)[:, None], c)
    return c


def _nearest(df: DataFrame, keep: str, centroids: np.ndarray, n: int) -> DataFrame:
    """A row for each of the n lists nearest to a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = matrix(b.column(1), centroids.shape[1]) @ centroids.T
            near = np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], [keep, "vector", "lists"])

    # vectors are repeated by Spark, not in a worker
    return df.select(keep, "vector").mapInArrow(run, f"{keep} long, vector array<float>, lists array<int>").select(keep, "vector", F.explode("lists").alias("list"))


def build_index(vectors: DataFrame, n_lists: int = 32, k: int = 10, key: str = "doc_id", vector: str = "embedding", sample_rows: int = 20_000, part_rows: int = 20_000, target: float = 0.95, tried: int = 200) -> Index:
    """An index of all vectors for searches of up to k results. sample_rows: vectors that the
    centroids are learned from. part_rows: vectors of a list that are scored at a time. The
    number of lists to probe is the least that finds a ``target`` share of the exact results of
    about ``tried`` vectors, which are compared with all."""
    ship(vectors.sparkSession)
    groups, members, dim = folded(vectors, k, key, vector)
    centroids = centroids_of(groups, n_lists, sample_rows)
    lists = _nearest(groups, "group", centroids, 1)
    size = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    size = stored(size, "parts")  # a row a list
    lists = lists.join(F.broadcast(size), "list").withColumn("part", F.pmod(F.xxhash64("group"), F.col("parts")).cast("int")).drop("parts")
    path = scratch(vectors.sparkSession, "lists")
    lists.repartition("list", "part").write.partitionBy("list").parquet(path)
    lists = vectors.sparkSession.read.schema(lists.schema).parquet(path)
    some = groups.sample(fraction=min(1.0, tried / max(groups.count(), 1)), seed=11).select(F.col("group").alias("query"), "vector")
    some = stored(some, "tried")
    best = _compared(groups, some, k, dim, part_rows).distinct().withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "group"))).where(F.col("_r") <= k)
    held = best.join(lists.select("group", "list"), "group").groupBy("query").agg(F.collect_list("list").alias("lists")).join(some, "query").toArrow()
    return Index(lists, members, size, centroids, k, probes_for(held, centroids, target))


def probes_for(held: pa.Table, centroids: np.ndarray, target: float) -> int:
    """The least number of nearest lists that hold a target share of the results; held has the lists of each query's."""
    if not len(held):
        return len(centroids)
    order = np.argsort(-(matrix(held["vector"], centroids.shape[1]) @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    at = np.sort(np.concatenate([place[i][x] for i, x in enumerate(held["lists"].to_pylist())]))
    return int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) + 1


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, key: str = "doc_id", vector: str = "embedding", block: int = 20_000) -> DataFrame:
    """query, rank, id, score: the k nearest vectors of the lists nearest to each query, scored exactly.

    probes: lists to read for a query; the index's own number if it isn't given.
    block: queries that meet a part of a list at a time."""
    if k > index.k:
        raise ValueError(f"the index holds {index.k} ids of equal vectors; build it with k={k}")
    ship(queries.sparkSession)
    asked = _queries(queries, key, vector)
    blocks = max(1, -(-asked.count() // block))
    q = _nearest(asked, "query", index.centroids, probes or index.probes).withColumn("_q", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    q = stored(q.join(F.broadcast(index.parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), "probes")
    # lists are few: those that any query probes are named, so that the scan reads no other folder
    probed = [r[0] for r in q.select("list").distinct().collect()]
    lists = index.lists.where(F.col("list").isin(probed)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return _best(_scored(lists, q, ["list", "part", "_q"], k, index.centroids.shape[1]), index.members, k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact results that were found."""
    hit = exact.join(found.select("query", "id"), ["query", "id"], "left_semi").count()
    return hit / max(1, exact.count())
