"""Documents, embeddings, the index and retrieval."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.strict import generate_text
from ..runtime import ship


def chunks(df: DataFrame, content: str = "text", size: int = 500, *, name: Column | None = None) -> DataFrame:
    """df's rows with chunk_no, content and is_sub_chunk: texts of more than size
    words in windows of size words, each behind a line that names where it is from."""
    d = df.withColumn("_parts", T.windows(F.col(content), size))
    d = d.select(*df.columns, F.posexplode("_parts").alias("chunk_no", "_part"))
    label, cut = name if name is not None else F.lit(""), F.coalesce("_part.cut", F.lit(False))
    said = F.when(cut, F.concat(F.lit("Context: Function "), label, F.lit("\n"), "_part.part")).otherwise(F.col("_part.part"))
    return d.select(*df.columns, "chunk_no", said.alias("content"), cut.alias("is_sub_chunk"))


def method_documents(methods: DataFrame) -> DataFrame:
    c, m, d = (F.coalesce(F.col(x), F.lit(y)) for x, y in (("class_name", "Unknown"), ("method_name", "unknown"), ("method_definition", "")))
    content = F.concat(F.lit("Class: "), c, F.lit("\nMethod: "), m, F.lit("\n\n"), d)
    return methods.drop("type", "content").select(content.alias("content"), F.lit("ast_method").alias("type"), *[x for x in methods.columns if x not in ("type", "content")])


def mapper_documents(mapped: DataFrame) -> DataFrame:
    deps = F.coalesce("dependencies", F.array().cast("array<string>"))
    said = F.when(F.size(deps) > 0, F.array_join(deps, ", ")).otherwise("None")
    content = F.concat(F.lit("Class: "), "class_name", F.lit("\nMethod: "), F.coalesce("method", F.lit("unknown")), F.lit("\nDependencies: "), said)
    return mapped.select(content.alias("content"), F.lit("code_mapper").alias("type"), "class_name", F.col("method").alias("method_name"), deps.alias("dependencies"), F.size(deps).alias("dependency_count"))


def union_documents(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def hashed_embedding(texts: pd.Series, dim: int = 256) -> pd.Series:
    """A deterministic stand-in for an embedding model: hashed word counts, normalised."""
    out = []
    for t in texts:
        v = np.zeros(dim, np.float32)
        for w in (t or "").lower().split():
            v[zlib.crc32(w.encode()) % dim] += 1
        n = float(np.linalg.norm(v))
        out.append((v / n if n else v).tolist())
    return pd.Series(out)


def embed(df: DataFrame, content: str = "content", out: str = "embedding", model=hashed_embedding) -> DataFrame:
    """df with a vector of each text; model maps a series of texts to one of vectors."""
    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return model(x)

    return df.withColumn(out, run(F.col(content)))


def write_index(docs: DataFrame, path: str, policy: str = "replace", buckets: int = 16, observe: Observation | None = None) -> DataFrame:
    """Write documents, one a content, in buckets by a hash of it; returns counts by type.

    policy: ``replace`` the whole index, ``skip`` documents it has, ``upsert``
    (new documents take the place of those with the same content) or ``fail`` on
    such. Skipping adds files; an upsert rewrites the buckets that it touches and no
    other, by dynamic partition overwrite, so nothing of older states is kept. The
    number of buckets is that of the index's first writing until it is replaced.
    Where there are no documents nothing is written. observe: gets the numbers of
    the documents written, in all and by kind, from the write itself.
    """
    if policy not in ("replace", "skip", "upsert", "fail"):
        raise ValueError(f"unknown policy: {policy}")
    spark = docs.sparkSession
    d = docs.withColumn("doc_key", F.sha2("content", 256)).dropDuplicates(["doc_key"])
    old = read_index(spark, path, plain=False)
    mark = _bucket(old) if old is not None and policy != "replace" else f"in_{buckets}"
    bucket = F.pmod(F.xxhash64("doc_key"), F.lit(int(mark[3:]))).cast("int")
    d = d.withColumn(mark, bucket)
    if docs.isEmpty():
        _observed(d.limit(0), observe).collect()
    elif old is None or policy == "replace":
        _buckets(_observed(d, observe), mark, path, "overwrite", "static")
    else:
        keys = lambda x: x.select("doc_key")
        touched = [r[0] for r in d.select(mark).distinct().collect()]  # at most the number of buckets
        there = old.where(F.col(mark).isin(touched))
        if policy == "fail" and not keys(d).join(keys(there), "doc_key", "left_semi").isEmpty():
            raise ValueError("the index has some of these documents")
        if policy == "upsert":
            kept = there.join(keys(d), "doc_key", "left_anti")
            _buckets(_observed(d, observe).unionByName(kept, allowMissingColumns=True), mark, path, "overwrite", "dynamic")
        else:
            new = d.join(keys(there), "doc_key", "left_anti") if policy == "skip" else d
            _buckets(_observed(new, observe), mark, path, "append", "static")
    got = read_index(spark, path)
    return spark.createDataFrame([], "type string, count long") if got is None else got.groupBy("type").count()


def _observed(docs: DataFrame, observe: Observation | None) -> DataFrame:
    """docs, whose numbers go to observe when they are written."""
    if observe is None:
        return docs
    kind = lambda k: F.count_if(F.col("type") == k)
    return docs.observe(observe, kind("ast_method").alias("ast_documents_written"), kind("code_mapper").alias("mapper_documents_written"), F.count(F.lit(1)).alias("total_documents"))


def _buckets(docs: DataFrame, mark: str, path: str, mode: str, overwrite: str) -> None:
    """A file a bucket, in order of kind, so that a filter on it skips row groups."""
    w = docs.repartition(mark).sortWithinPartitions("type", "doc_key").write.partitionBy(mark)
    w.mode(mode).option("partitionOverwriteMode", overwrite).parquet(path)


def _bucket(index: DataFrame) -> str:
    """The column of buckets; its name has their number."""
    return next(c for c in index.columns if re.fullmatch(r"in_\d+", c))


def read_index(spark: SparkSession, path: str, plain: bool = True) -> DataFrame | None:
    """The documents of an index, None where there is none; plain: without the bucket."""
    try:
        d = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return d.drop(_bucket(d)) if plain else d


def by_method(index: DataFrame, name: str, kind: str = "ast_method") -> DataFrame:
    return index.where((F.col("type") == kind) & (F.col("method_name") == name))


def by_class(index: DataFrame, name: str, kind: str = "ast_method") -> DataFrame:
    return index.where((F.col("type") == kind) & (F.col("class_name") == name))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def top_k(index: DataFrame, query: list[float], k: int = 10, vector: str = "embedding", key: str = "doc_id") -> DataFrame:
    """The k nearest rows to one query vector, which is a literal of the plan; no join, one bounded sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return index.withColumn("score", F.round(cosine(F.col(vector), q), 6)).orderBy(F.desc("score"), key).limit(k)


def overlap(text: Column, query: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's words in a text."""
    w = lambda x: F.array_distinct(T.words(F.lower(x)))
    q = w(query)
    return F.round(F.size(F.array_intersect(w(text), q)) / F.greatest(F.size(q), F.lit(1)), 6)


def rerank(found: DataFrame, score: Column, k: int = 5, key: str = "doc_id", query: str | None = None) -> DataFrame:
    """The k best rows by score, of each query where there are several."""
    d = found.withColumn("rerank", score)
    if query is None:
        return d.orderBy(F.desc("rerank"), key).limit(k)
    w = W.partitionBy(query).orderBy(F.desc("rerank"), key)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rag_prompt(found: DataFrame, question: str, rank: str = "rank", content: str = "content") -> DataFrame:
    """One row: the texts in order of rank, then the question. found has at most k rows."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(content).alias("c")))), lambda x: x["c"]), "\n---\n")
    return found.agg(F.concat(F.lit("Answer from these sources.\n\n"), body, F.lit(f"\n\nQuestion: {question}")).alias("prompt"))


def rag_prompts(found: DataFrame, questions: DataFrame, key: str = "query", question: str = "question", content: str = "content") -> DataFrame:
    """A row a question: key, question and prompt, the texts found for it in order of rank. A
    question that found nothing has none in its prompt; found has at most k rows a question."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), F.col(content).alias("c")))), lambda x: x["c"]), "\n---\n")
    d = questions.select(key, question).join(found.groupBy(key).agg(body.alias("_body")), key, "left")
    return d.select(key, question, F.concat(F.lit("Answer from these sources.\n\n"), F.coalesce("_body", F.lit("")), F.lit("\n\nQuestion: "), F.coalesce(question, F.lit(""))).alias("prompt"))


def answer(found: DataFrame, question: str, generate: Callable[[str], str], **columns: str) -> DataFrame:
    """One row: the prompt and what the model answers to it; null where it fails."""
    return generate_text(rag_prompt(found, question, **columns), "prompt", "answer", generate)
