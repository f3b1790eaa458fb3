from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.operators import lexical, lsa

TEXTS = [None, "", " \n", "A a b", "x\x1cy\x85z w", "é É　q", *(f"w{i} w{i % 7} the" for i in range(700))]


def test_words_are_those_of_the_pattern():
    for t in [*(t for t in TEXTS if t), "".join(f"a{chr(i)}" for i in range(0x3010)), "\x1d", "a\x1fb c"]:
        assert lexical.words_of(t) == lexical.SPLIT.findall(t)


def test_pieces_of_texts_are_bounded():
    sizes = [10, 0, lsa.TEXT * 3, *[lsa.TEXT // 10] * 25, *[1] * 1000]
    texts = pa.array([None if n == 0 else "x" * n for n in sizes])
    got = list(lsa.cut(texts, 4096))
    assert [i for i, _ in got] == [0, *np.cumsum([n for _, n in got])[:-1]] and sum(n for _, n in got) == len(sizes)
    assert all(n * 4096 <= lsa.CELLS and (n == 1 or sum(sizes[i : i + n - 1]) < lsa.TEXT) for i, n in got)


def test_term_counts_of_one_batch_of_many_rows(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: [tuple(t) for t in r.terms] for r in lsa.term_counts(docs, "doc_id", "text", 4096, most_words=50).collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        if c := Counter(lsa.feature(w, 4096) for w in lexical.SPLIT.findall((t or "").lower())):
            want[i] = sorted(c.items())
    assert got == want


def test_stored_counts_give_the_same_vectors(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    made = lsa.learn(docs, size=4, features=64, rounds=2)
    vectors = lambda **a: np.array([r.embedding for r in made.embed(docs, **a).orderBy("doc_id").collect()])
    assert np.allclose(vectors(), vectors(counts=made.counts), atol=1e-6)


def test_blocks_end_at_their_size_and_postings_bound_their_weights():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(s, s + 9)), pa.array(["ab"] * 8 + ["x" * lexical.BLOCK])], ["id", "text"]) for s in (0, 9)]
    assert [ids for ids, _ in lexical.blocks_of(iter(batches), 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8], [9, 10, 11, 12], [13, 14, 15, 16], [17]]
    rows = lexical._postings(7, [1, 2, 3], ["A b a", "", "a c c c"]).to_pylist()
    assert {r["term"]: (r["block"], r["df"], r["tokens"], r["most"], r["least"]) for r in rows} == {"a": (7, 2, 3, 2, 1.5), "b": (7, 1, 1, 1, 3.0), "c": (7, 1, 3, 3, 4 / 3)}
    assert {r["term"]: [(p["id"], p["tf"], p["len"]) for p in r["postings"]] for r in rows}["a"] == [(1, 2, 3), (3, 1, 4)]
    assert lexical._postings(1, [5], [""]).num_rows == 0


def test_bounds_are_never_below_a_weight(spark):
    docs = spark.createDataFrame([(i, " ".join(["a"] * (i % 5) + ["b"] * (i * 7 % 11) + ["c"])) for i in range(60)], "doc_id long, text string")
    index = lexical.build_text_index(docs, block_docs=8)
    worst = index.terms.select(index.best().alias("best"), F.explode("postings").alias("p")).select(F.min(F.col("best") - index.weight(F.col("p.tf"), F.col("p.len")))).first()[0]
    assert -1e-9 < worst < 1e-9  # reached by some


def test_the_index_shuffles_no_text_and_searches_split_found_texts_only(spark, monkeypatch):
    plans = []
    kept = lexical.stored
    monkeypatch.setattr(lexical, "stored", lambda d, name: plans.append((name, d._jdf.queryExecution().executedPlan().toString())) or kept(d, name))
    docs = spark.createDataFrame([(i, f"a b{i}") for i in range(50)], "doc_id long, text string")
    index = lexical.build_text_index(docs, block_docs=4)
    assert [n for n, _ in plans] == ["postings"] and "Exchange" not in plans[0][1]
    asked = spark.createDataFrame([(1, "a b7")], "item_id long, text string")
    found = lexical.search_text(index, asked, 3)
    assert found.orderBy("rank").first().id == 7
    scored = lexical.weighted_overlap(found.select("query", "id"), index, asked, docs)
    assert "LeftSemi" in scored._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r["rerank"] for r in scored.collect()}[7] == 1.0
