"""Strict parsing by VARIANT against Python's parser, typed parts and merged schemas."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from sparkloom.functions import strict, variant

HARD = [
    '{"a":1}', "  [1, 2]\n", '"s"', "null", "true", "12", "-0", "1e5", '{"a":{"b":[{}]}}', '{"é":"\\u00e9\\ud83d\\ude00"}', '{"":""}', "[]",
    "", " ", "{", "[1,]", '{"a":1,}', "{a:1}", "{'a':1}", "01", ".5", "1.", "+1", "tru", "/*c*/1", "1 x", '{"a":1} {"b":2}', "1],[2", '1},{"v":1', '1,"x":2', '1,"w":0}', '{"a":1}}', '[1]]', '"a" "b"', "'a'",
    '1,"w' + "0" * 32 + '":0}', '"a\tb"', "﻿1", "{}x", "nullx", '{"v":1}', '{"v":1,"w":0}',
]
#: Taken by Python's parser, refused here.
LOOSE = ['{"a":NaN}', "Infinity", "-Infinity", '{"a":1,"a":2}']


def made(n: int) -> list[str]:
    r = random.Random(7)

    def value(depth: int):
        kind = r.randrange(7 if depth else 5)
        if kind < 5:
            return r.choice([None, True, r.randrange(-(10**9), 10**9), r.random(), "".join(r.choice('ab"\\\n{}[],:é ') for _ in range(r.randrange(6)))])
        return [value(depth - 1) for _ in range(r.randrange(4))] if kind == 5 else {r.choice("abcdef") + str(i): value(depth - 1) for i in range(r.randrange(4))}

    out = []
    for _ in range(n):
        s = json.dumps(value(3), ensure_ascii=r.random() < 0.5)
        if r.random() < 0.5:
            i = r.randrange(len(s) + 1)
            s = s[:i] + r.choice(['"', "{", "}", "[", "]", ",", ":", "x", " ", "1"]) + s[i + r.randrange(2) :]
        out.append(s)
    return out


def test_as_strict_as_pythons_parser(spark):
    texts = [*HARD, *made(1500)]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    got = {r.i: r.j for r in df.select("i", F.to_json(variant.strict_variant(F.col("t"))).alias("j")).collect()}
    assert got[len(texts)] is None
    for i, t in enumerate(texts):
        try:
            want = json.loads(t)
        except ValueError:
            assert got[i] is None, t
            continue
        assert got[i] is not None and json.loads(got[i]) == want, t
    loose = spark.createDataFrame([(t,) for t in LOOSE], "t string")
    assert all(strict.canonical(t) is not None for t in LOOSE)
    assert loose.where(variant.strict_variant(F.col("t")).isNotNull()).count() == 0


def test_replies(spark):
    rows = [(1, 'Sure:\n```json\n{"postman": {"n": 1,}, "x": 2}\n```'), (2, 'Here: {"swagger": {"s": [1, 2]}} done'), (3, '{"other": 1}'), (4, "no"), (5, None)]
    d = spark.createDataFrame(rows, "id int, reply string").select("id", variant.reply_variant(F.col("reply")).alias("v"))
    d = d.withColumn("p", variant.documentation_parts(F.col("v")))
    got = {r.id: (r.a, r.b, r.n) for r in d.select("id", F.to_json("p.postman").alias("a"), F.to_json("p.swagger").alias("b"), variant.typed(F.col("v"), "$.postman.n", "int").alias("n")).collect()}
    assert got == {1: ('{"n":1}', None, 1), 2: (None, '{"s":[1,2]}', None), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}
    one = variant.merged_schema(d, "v").first()
    assert (one.replies, one.valid) == (5, 3) and one.schema.startswith("OBJECT<") and "swagger: OBJECT<s: ARRAY<BIGINT>>" in one.schema
    by = {r.k: r.valid for r in variant.merged_schema(d.withColumn("k", F.col("id") > 3), "v", ["k"]).collect()}
    assert by == {False: 3, True: 0}
    assert variant.merged_schema(d.limit(0), "v").first().replies == 0
    assert "Python" not in d._jdf.queryExecution().toString().split("== Physical Plan ==")[1].replace("ArrowPython", "Python")
