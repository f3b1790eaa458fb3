import pyarrow as pa
import pytest

from sparkloom import code_queries
from sparkloom.operators import extract, grammar
from sparkloom.operators.extract import LANGUAGES

SF = "/root/testdata/sf0.001"
JAVA = "@Service\npublic class A extends B {\n  private C c;\n  public int go(String s) { return c.run(s); }\n}\n"
PY = "class A(B):\n    def go(self):\n        return self.run()\n"


def test_rows_of_sources_leave_a_worker_in_pieces():
    fields = pa.schema([("path", pa.string()), ("name", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(40)]), pa.array(["java"] * 40), pa.array(["x" * 100] * 40)], ["path", "lang", "content"])
    got = list(extract.pieces(iter([batch]), lambda text, lang: [(text[:3],), (lang,)], fields, most=1000))
    assert [b.num_rows for b in got] == [20] * 4
    assert [r["path"] for b in got for r in b.to_pylist()] == [str(i) for i in range(40) for _ in range(2)]


def test_python_gets_batches_of_few_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    files = spark.range(200).selectExpr("concat('a', id, '.java') AS path", f"concat('{JAVA.replace(chr(10), ' ')}', repeat(' ', 200000)) AS content").coalesce(1)
    extract.extract(files)
    sizes = files.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n long").collect()
    assert max(r.n for r in sizes) < 10_000_000
    assert extract.extract(files).count() == 200


@pytest.mark.parametrize("lang,source", [("java", JAVA), ("python", PY)])
def test_outline_parses_a_source_once(monkeypatch, lang, source):
    seen = []
    parse = extract.parsed
    monkeypatch.setattr(extract, "parsed", lambda s, of: seen.append(of) or parse(s, of))
    got = extract.outline_source(source, lang)
    assert seen == [lang]
    assert [r[:6] for r in got if r[2] != "method"] == extract.facts_source(source, lang)
    assert [r[1] for r in got if r[2] == "method"] == [r[5] for r in extract.extract_source(source, lang)]


def test_outline_of_faulty_sources_is_empty():
    assert all(extract.outline_source(s, lang) == [] for s in (None, "") for lang in LANGUAGES)
    assert extract.outline_source("def (", "python") == []


def test_sources_shuffle_the_turns_once(spark):
    plan = code_queries.sources(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_space_and_comments_at_the_end_give_no_token():
    for tail in ("", " ", "\n", " // no", " /* no", "/* no */ "):
        got, end = grammar.tokens("a ?. b == $c" + tail, "java")
        assert [(t.kind, t.text) for t in got] == [("word", "a"), ("mark", "?."), ("word", "b"), ("mark", "=="), ("word", "$c")]
        assert end == len("a ?. b == $c" + tail)
    got, _ = grammar.tokens('x = $$"{a}" + @"b""c" + $"{{d}} {e("}")}"; f', "c_sharp")
    assert [t.text for t in got if t.kind == "text"] == ['$$"{a}"', '@"b""c"', '$"{{d}} {e("}")}"']
