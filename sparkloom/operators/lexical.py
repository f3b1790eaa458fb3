"""BM25 over an inverted index in blocks of documents; searches are DataFrame operations.

A row of the index is a term in a block of documents: its postings, and the most
that they can give (the block maximum, or a little more). A search first adds up these maxima, which
reads no postings, and scores the blocks that promise most. Their k-th best score
is a bar; of the other blocks only those whose maxima can reach it are read. So a
document without a word of the query is never scored, and few of the others are.

A term that all documents have is a row a block, not one long list. Words are
lower-cased and split at white space; a null text has none. Scores are rounded to
6 digits, ties by id. Repeated words of a query count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import ship, stored

#: What is not white space, as the words of functions/text.py.
SPLIT = re.compile("[^\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: White space of str.split alone.
ODD = "\x1c\x1d\x1e\x1f"
#: Different words of all queries that may be sent to all executors.
MOST_WORDS = 100_000
TERMS = "block long, term string, df int, tokens long, most int, least double, postings array<struct<id: long, tf: int, len: int>>"
#: Characters of texts after which a block ends.
BLOCK = 4_000_000


@dataclass
class TextIndex:
    """terms: block, term and postings (id, tf, len), with their number, the sum and the greatest of tf, and the least len / tf."""

    terms: DataFrame
    docs: int
    mean: float
    k1: float
    b: float

    def weight(self, tf: Column, length: Column) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))

    def best(self) -> Column:
        """No posting of the row gives more (without the idf): a weight falls with 1 / tf and with len / tf."""
        return (self.k1 + 1) / (1 + self.k1 * ((1 - self.b) / F.col("most") + self.b * F.col("least") / self.mean))

    def idf(self, terms: DataFrame) -> DataFrame:
        """term and idf of rows of the index."""
        df = terms.groupBy("term").agg(F.sum("df").alias("_df"))
        return df.select("term", F.log(1 + (self.docs - F.col("_df") + 0.5) / (F.col("_df") + 0.5)).alias("idf"))


def words_of(text: str) -> list[str]:
    """The words of SPLIT; str.split is faster and gives the same where a text has none of its odd white space."""
    return SPLIT.findall(text) if any(c in text for c in ODD) else text.split()


def bag(text: Column) -> Column:
    return T.words(F.lower(F.coalesce(text, F.lit(""))))


def narrowed(d: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """Rows of d that may be wanted: few different values filter the scan of d where it is read; many are left to the join that follows."""
    return d.join(F.broadcast(wanted), on, "left_semi") if wanted.count() <= MOST_WORDS else d


def build_text_index(docs: DataFrame, key: str = "doc_id", content: str = "text", k1: float = 1.2, b: float = 0.75, block_docs: int = 256) -> TextIndex:
    """docs with different, non-null whole numbers as keys. A block is at most block_docs documents
    that a task reads one after another; nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(content, F.lit("")).alias("text"))
    n = own.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, (ids, texts) in enumerate(blocks_of(batches, block_docs)):
            yield _postings(first + i, ids, texts)

    terms = stored(own.mapInArrow(run, TERMS), "postings")
    mean = (terms.agg(F.sum("tokens")).first()[0] or 0) / max(n, 1)
    return TextIndex(terms, n, mean or 1.0, k1, b)


def blocks_of(batches: Iterator[pa.RecordBatch], block_docs: int) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of a block's documents, of about BLOCK characters at most."""
    ids, texts, size = [], [], 0
    for b in batches:
        for doc, text in zip(*b.columns, strict=True):
            ids.append(doc.as_py())
            texts.append(text.as_py())
            size += len(texts[-1])
            if len(ids) >= block_docs or size >= BLOCK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _postings(block: int, docs: list[int], texts: list[str]) -> pa.RecordBatch:
    words, tfs, lens, sizes = [], [], [], []
    for text in texts:
        found = words_of(text.lower())
        count = Counter(found)
        words += count
        tfs += count.values()
        lens.append(len(found))
        sizes.append(len(count))
    coded = pa.array(words, pa.string()).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    n = len(coded.dictionary)
    size = np.bincount(code, minlength=n)
    start = np.append(0, np.cumsum(size))
    tf, length = np.array(tfs, np.int64)[order], np.repeat(np.array(lens, np.int64), sizes)[order]
    ids = np.repeat(np.array(docs, np.int64), sizes)[order]
    posting = pa.StructArray.from_arrays([pa.array(ids), pa.array(tf.astype(np.int32)), pa.array(length.astype(np.int32))], ["id", "tf", "len"])
    over = lambda f, x: f.reduceat(x, start[:-1]) if n else x[:0]
    columns = [np.full(n, block), coded.dictionary, size.astype(np.int32), over(np.add, tf), over(np.maximum, tf).astype(np.int32), over(np.minimum, length / tf), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), posting)]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["block", "term", "df", "tokens", "most", "least", "postings"])


def search_text(index: TextIndex, queries: DataFrame, k: int = 10, key: str = "item_id", content: str = "text", seeds: int = 2) -> DataFrame:
    """query, rank, id, score of the k best documents of each query."""
    asked = stored(queries.select(F.col(key).alias("query"), F.explode(F.array_distinct(bag(F.col(content)))).alias("term")), "asked")
    hits = narrowed(index.terms, asked.select("term").distinct(), "term")
    # the rows of few words are read from the whole index once
    hits = index.terms if hits is index.terms else stored(hits, "hits")
    asked = stored(asked.join(index.idf(hits), "term"), "weighed")
    bound = asked.join(hits.select("block", "term", index.best().alias("best")), "term").groupBy("query", "block").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"))
    bound = stored(bound.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("bound"), "block"))), "bounds")

    def scored(blocks: DataFrame) -> DataFrame:
        p = asked.join(blocks.select("query", "block"), "query").join(hits.select("block", "term", "postings"), ["block", "term"])
        p = p.select("query", "idf", F.explode("postings").alias("_p"))
        return p.groupBy("query", F.col("_p.id").alias("id")).agg(F.round(F.sum(F.col("idf") * index.weight(F.col("_p.tf"), F.col("_p.len"))), 6).alias("score"))

    ranked = lambda d: d.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    first = stored(ranked(scored(bound.where(F.col("_n") <= seeds))), "first")
    bar = first.where(F.col("rank") == k).select("query", F.col("score").alias("_bar"))
    rest = bound.where(F.col("_n") > seeds).join(bar, "query", "left").where(F.col("_bar").isNull() | (F.col("bound") >= F.col("_bar") - 1e-5))
    return ranked(first.select("query", "id", "score").union(scored(rest))).select("query", "rank", "id", "score")


def weighted_overlap(found: DataFrame, index: TextIndex, queries: DataFrame, docs: DataFrame, key: str = "item_id", doc_key: str = "doc_id", content: str = "text") -> DataFrame:
    """found with rerank: the share of the query's words that a document has, each by its rarity."""
    asked = queries.select(F.col(key).alias("query"), F.explode(F.array_distinct(bag(F.col(content)))).alias("term"))
    asked = asked.join(index.idf(narrowed(index.terms.select("term", "df"), asked.select("term").distinct(), "term")), "term", "left")
    asked = asked.withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    total = asked.groupBy("query").agg(F.sum("idf").alias("_all"))
    # texts of found documents only are split
    texts = narrowed(docs.select(F.col(doc_key).alias("id"), F.col(content).alias("_text")), found.select("id").distinct(), "id")
    has = found.join(texts, "id").select("query", "id", F.explode(F.array_distinct(bag(F.col("_text")))).alias("term")).join(asked, ["query", "term"]).groupBy("query", "id").agg(F.sum("idf").alias("_sum"))
    d = found.join(has, ["query", "id"], "left").join(total, "query", "left")
    return d.withColumn("rerank", F.round(F.coalesce("_sum", F.lit(0.0)) / F.greatest("_all", F.lit(1e-9)), 6)).drop("_sum", "_all")
