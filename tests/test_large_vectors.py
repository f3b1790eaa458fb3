import numpy as np

from sparkloom.operators import vectors


def test_scores_are_made_in_bounded_tiles(monkeypatch):
    r = np.random.default_rng(3)
    v, q = r.normal(size=(300, 8)), r.normal(size=(70, 8))
    seen = []
    top = vectors.top_rows
    monkeypatch.setattr(vectors, "SCORES", 3000)
    monkeypatch.setattr(vectors, "top_rows", lambda s, k: seen.append(s.size) or top(s, k))
    got = {(int(a), int(b)): float(s) for rows in vectors.tiles(v, q, 5) for a, b, s in zip(*rows, strict=True)}
    assert max(seen) <= 3000 and sum(seen) == 300 * 70
    every = np.round(q @ v.T, 6)
    assert got == {(i, int(j)): float(every[i, j]) for i in range(70) for j in np.argsort(-every[i])[:5]}


def test_search_in_blocks_of_queries_finds_the_same(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    made = vectors.build_index(d, n_lists=4, k=3, part_rows=50)
    get = lambda **a: sorted(tuple(x) for x in vectors.search(made, d.where("doc_id % 4 = 0"), 3, **a).collect())
    assert get(block=30) == get() and len(get()) == 300
    plan = vectors.search(made, d, 3, block=30)._jdf.queryExecution().toString()
    assert "_q" in plan
