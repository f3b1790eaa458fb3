"""The learned embedding: weights, directions against a full decomposition, near copies against hashed counts."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import lsa
from sparkloom.operators.index import hashed_embedding

FEATURES = 256


def texts() -> list[tuple]:
    r = random.Random(4)
    topics = [[f"t{k}w{i}" for i in range(60)] for k in range(6)]
    out = [(i, " ".join(r.choice(topics[i % 6]) if r.random() < 0.7 else f"common{r.randrange(8)}" for _ in range(r.randint(4, 25)))) for i in range(240)]
    return [*out, (900, None), (901, " "), (902, "Common1")]


def matrix(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    of = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % FEATURES
    bags = [Counter(of(w) for w in (t or "").lower().split()) for _, t in rows]
    n = sum(bool(b) for b in bags)
    df = Counter(f for b in bags for f in b)
    idf = np.array([math.log((1 + n) / (1 + df[f])) + 1 if df[f] else 0.0 for f in range(FEATURES)])
    x = np.zeros((len(rows), FEATURES))
    for i, b in enumerate(bags):
        for f, c in b.items():
            x[i, f] = (1 + math.log(c)) * idf[f]
    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm > 0, norm, 1)[:, None], idf


@pytest.fixture(scope="module")
def learned(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    return df, lsa.learn(df, size=6, features=FEATURES, rounds=12)


def test_weights_and_directions(learned):
    _, model = learned
    x, idf = matrix(texts())
    assert model.idf == pytest.approx(idf)
    assert model.directions.T @ model.directions == pytest.approx(np.eye(6), abs=1e-9)
    _, s, vt = np.linalg.svd(x)
    assert model.values == pytest.approx(s[:6], rel=1e-3)
    assert np.linalg.norm(vt[:6] @ model.directions, 2) == pytest.approx(1, abs=1e-3) and abs(np.linalg.det(vt[:6] @ model.directions)) > 0.98


def test_vectors(learned):
    df, model = learned
    got = {r.doc_id: np.array(r.embedding) for r in model.embed(df).collect()}
    x, _ = matrix(texts())
    assert len(got) == len(texts()) and not got[900].any() and not got[901].any()
    for (i, _), row in zip(texts(), x @ model.directions, strict=True):
        assert got[i] == pytest.approx(row / (np.linalg.norm(row) or 1), abs=1e-5)


def test_topics_are_nearer_than_by_hashed_counts(learned):
    df, model = learned
    rows = {r.doc_id: np.array(r.embedding) for r in model.embed(df).where("doc_id < 240").collect()}
    plain = dict(zip([i for i, _ in texts()][:240], np.array(hashed_embedding(pd.Series([t for _, t in texts()][:240]), FEATURES).tolist()), strict=True))

    def hits(vectors: dict) -> float:
        m = np.array([vectors[i] for i in range(240)])
        s = m @ m.T
        np.fill_diagonal(s, -2)
        return float(np.mean([[j % 6 == i % 6 for j in np.argsort(-s[i])[:10]] for i in range(240)]))

    assert hits(rows) > 0.85 and hits(rows) > hits(plain) + 0.1


def test_no_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = lsa.learn(df, size=2, features=16, rounds=1)
    assert not model.idf.any() and model.embed(df).count() == 0
    assert model.embed(spark.createDataFrame([(1, "a")], "doc_id long, text string").where(F.lit(True))).first().embedding == [0.0, 0.0]
