"""Vector and word retrieval for many queries: exact blocks, the index's recall, skipped blocks, hot vectors and words."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import index, lexical, vectors
from sparkloom.plans import entries

SF = "/root/testdata/sf0.01"


def clustered(n: int, dim: int, seed: int = 1) -> list[tuple]:
    r = np.random.default_rng(seed)
    centre = r.normal(size=(20, dim))
    return [(i, [float(x) for x in centre[i % 20] + 0.4 * r.normal(size=dim)]) for i in range(n)]


def by_force(rows: list[tuple], queries: list[tuple], k: int) -> set[tuple]:
    out = set()
    unit = lambda v: np.array(v, np.float32).astype(float) / (np.linalg.norm(np.array(v, np.float32).astype(float)) or 1)
    for q, v in queries:
        scored = sorted((-round(float(unit(w) @ unit(v)), 6) + 0.0, i) for i, w in rows)
        out |= {(q, n + 1, i) for n, (_, i) in enumerate(scored[:k])}
    return out


def test_exact_blocks_and_equal_vectors(spark):
    rows = clustered(300, 8) + [(1000 + i, [1.0] * 8) for i in range(200)] + [(5000, [0.0] * 8)]
    df = spark.createDataFrame([*rows, (9000, None), (None, [1.0] * 8)], "doc_id long, embedding array<float>")
    queries = [r for r in rows if r[0] % 50 == 0]
    got = vectors.exact_top_k(df, df.where("doc_id % 50 = 0"), 10, block=40)
    assert {(r.query, r["rank"], r.id) for r in got.collect()} == by_force(rows, queries, 10)
    assert vectors.exact_top_k(df.limit(0), df, 10).count() == 0 and vectors.exact_top_k(df, df.limit(0), 10).count() == 0


def test_index_reads_only_probed_lists_and_finds_nearly_all(spark):
    rows = clustered(2000, 16) + [(10_000 + i, [0.5] * 16) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    index = vectors.build_index(df, 20, part_rows=300)
    q = df.where("doc_id % 50 = 0")
    found, exact = vectors.search(index, q), vectors.exact_top_k(df, q)
    assert vectors.recall(found, exact) >= 0.9 and index.probes < 20
    assert found.groupBy("query").count().where("count <> 10").isEmpty()
    assert index.lists.count() == 2001  # equal vectors are one row
    one = vectors.search(index, df.where("doc_id = 0"), probes=1)
    assert {r.id % 20 for r in one.collect()} == {0}
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan or "list#" in plan.split("PartitionFilters")[1][:80]
    with pytest.raises(ValueError, match="k=20"):
        vectors.search(index, q, 20)


def test_recall_on_the_given_vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0")
    found = vectors.search(vectors.build_index(e, key="vec_id"), q, key="vec_id")
    assert vectors.recall(found, vectors.exact_top_k(e, q, 10, "vec_id")) >= 0.9


TEXTS = [(i, " ".join(["the"] * (1 + i % 3) + [f"w{i % 7}", f"v{i % 31}", *[f"x{i}"] * (i % 2)])) for i in range(900)] + [(900, ""), (901, None), (902, "The THE w3 Rare")]


def bm25(query: str, k: int) -> list[tuple]:
    bags = {i: (t or "").lower().split() for i, t in TEXTS}
    mean, n = sum(map(len, bags.values())) / len(bags), len(bags)
    df = Counter(w for b in bags.values() for w in set(b))
    score = {}
    for i, b in bags.items():
        c = Counter(b)
        if words := [w for w in dict.fromkeys(query.lower().split()) if w in c]:
            score[i] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w in words), 6)
    return sorted(((-s, i) for i, s in score.items()))[:k]


@pytest.mark.parametrize("block", [16, 256, 10_000])
def test_bm25_with_skipped_blocks(spark, block):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    asked = [(1, "the w3 rare"), (2, "x17 x17 v5"), (3, "nothing here"), (4, "the"), (5, None), (6, "w1 v1 X31")]
    index = lexical.build_text_index(docs, block_docs=block)
    got = lexical.search_text(index, spark.createDataFrame(asked, "item_id long, text string"), 5).collect()
    for q, text in asked:
        want = bm25(text or "", 5)
        have = sorted((r["rank"], r.id, r.score) for r in got if r.query == q)
        assert [(i, s) for _, i, s in have] == [(i, -s) for s, i in want]


def test_rare_words_count_more(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    index = lexical.build_text_index(docs)
    q = spark.createDataFrame([(1, "the rare")], "item_id long, text string")
    found = spark.createDataFrame([(1, 902), (1, 0), (1, 900)], "query long, id long")
    got = {r.id: r["rerank"] for r in lexical.weighted_overlap(found, index, q, docs).collect()}
    assert got[902] == 1.0 and 0 < got[0] < 0.1 and got[900] == 0.0


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search_text(lexical.build_text_index(docs), q).count() == 0


def test_many_questions_at_once(spark):
    rows = [(f"class Shop{i} sells item{i} and paint", "ast_method") for i in range(30)] + [("paint paint paint", "code_mapper")]
    docs = index.embed(spark.createDataFrame(rows, "content string, type string")).withColumn("doc_key", F.sha2("content", 256))
    asked = spark.createDataFrame([(1, "what sells item7"), (2, "paint"), (3, None)], "query long, question string")
    got = entries.retrieve_many(docs, asked, k=4, keep=2)
    best = {(r.query, r["rank"]): r.content for r in got.collect()}
    assert best[1, 1] == "class Shop7 sells item7 and paint" and best[2, 1] in [r[0] for r in rows] and {q for q, _ in best} == {1, 2, 3} and max(n for _, n in best) == 2

    def model(prompt: str) -> str:
        if prompt.endswith("Question: "):
            raise RuntimeError("no question")
        return prompt.upper()

    said = {r["query"]: r for r in entries.answer_many(docs, asked, model, k=4, keep=2).collect()}
    assert said[1].prompt.startswith("Answer from these sources.\n\nclass Shop7 sells") and said[1].prompt.endswith("Question: what sells item7")
    assert said[1].answer == said[1].prompt.upper() and said[3].answer is None
