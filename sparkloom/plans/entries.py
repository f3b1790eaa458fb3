"""The four end-to-end plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strict import generate_text
from ..operators import docs, index, lexical, mapping, vectors
from ..operators.extract import extract, facts
from ..sources.srctree import read_tree


def methods_of(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Source tree to method rows."""
    return extract(read_tree(spark, folder, **options))


def map_project(spark: SparkSession, folder: str) -> DataFrame:
    """Source tree to mapped methods: class, method, dependencies, API flag."""
    files = read_tree(spark, folder)
    return mapping.dependencies(extract(files), facts=facts(files))


def build_index(methods: DataFrame, mapped: DataFrame, path: str) -> DataFrame:
    """Method and mapper documents, embedded and written; counts by type."""
    return index.write_index(index.embed(index.union_documents(index.method_documents(methods), index.mapper_documents(mapped))), path)


def retrieve(indexed: DataFrame, question: str, k: int = 10, keep: int = 5) -> DataFrame:
    """Nearest documents to a question, reranked."""
    import pandas as pd

    q = index.hashed_embedding(pd.Series([question]))[0]
    found = index.top_k(indexed, q, k, key="doc_key")
    return index.rerank(found, index.overlap(F.col("content"), F.lit(question)), keep, key="doc_key")


def document_methods(methods: DataFrame, mapped: DataFrame, generate: Callable[[str], str] | None = None) -> DataFrame:
    """API methods with details, dependency context and documentation."""
    api = docs.with_details(docs.api_methods(mapped), methods)
    ctx = docs.dependency_context(api, index.method_documents(methods))
    return docs.documentation(ctx, generate)


def answer(indexed: DataFrame, question: str, generate: Callable[[str], str], k: int = 10, keep: int = 5) -> DataFrame:
    """A question answered from the best documents of an index."""
    found = retrieve(indexed, question, k, keep).withColumn("_rank", -F.col("rerank"))
    return index.answer(found, question, generate, rank="_rank")


def retrieve_many(indexed: DataFrame, questions: DataFrame, k: int = 10, keep: int = 5) -> DataFrame:
    """query, rank, doc_key and content: for each of questions (query, question) the k nearest
    documents, of these the ``keep`` that share most of its words, rare ones first."""
    d = indexed.withColumn("_id", F.xxhash64("doc_key"))
    asked = index.embed(questions.select(F.col("query").alias("_id"), "question"), "question")
    found = vectors.exact_top_k(d.select("_id", "embedding"), asked, k, "_id").select("query", "id")
    words = lexical.build_text_index(d, "_id", "content")
    scored = lexical.weighted_overlap(found, words, questions.select("query", F.col("question").alias("content")), d, "query", "_id", "content")
    best = index.rerank(scored, F.col("rerank"), keep, key="id", query="query")
    return best.join(d.select(F.col("_id").alias("id"), "doc_key", "content"), "id").select("query", "rank", "doc_key", "content")


def answer_many(indexed: DataFrame, questions: DataFrame, generate: Callable[[str], str], k: int = 10, keep: int = 5) -> DataFrame:
    """query, question, prompt and answer of every question; an answer that failed is null."""
    prompts = index.rag_prompts(retrieve_many(indexed, questions, k, keep), questions)
    return generate_text(prompts, "prompt", "answer", generate)
