"""Sources, sinks, settings, retries, models, jobs, streaming and the command line."""

from __future__ import annotations

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from sparkloom import __main__ as cli
from sparkloom.functions import strict
from sparkloom.functions import text as T
from sparkloom.functions.replies import object_text
from sparkloom.operators import docs, index, mapping
from sparkloom.plans import entries, providers, trace
from sparkloom.sources import files
from sparkloom.streaming import chunks

SHOP = '''from django.http import JsonResponse
class OrderView(APIView):
    def get(self, request):
        return JsonResponse(order_service.load(1))
class OrderService:
    def load(self, n):
        return n
'''


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "shop"
    (root / "a").mkdir(parents=True)
    (root / "b").mkdir()
    (root / "a" / "views.py").write_text(SHOP)
    (root / "b" / "views.py").write_text("class Other:\n    def run(self):\n        return 1\n")
    (root / "b" / "broken.py").write_text("class (:\n")
    (root / "notes.md").write_text("nothing")
    return root


def test_settings_by_dotted_name(tmp_path):
    one, two = tmp_path / "one.yml", tmp_path / "two.yml"
    one.write_text("rag:\n  top_k_retriever: 3\n  deep:\n    x: 1\n")
    two.write_text("rag:\n  deep:\n    x: 2\n")
    s = files.Settings(str(one), str(two), str(tmp_path / "none.yml"), app={"APP_NAME": "Shop"})
    assert (s.get("rag.top_k_retriever"), s.get("rag.deep.x"), s.get("rag.top_k_reranker"), s.get("app.APP_NAME")) == (3, 2, 5, "Shop")
    assert s.get("rag.deep") == {"x": 2} and s.get("rag.none", 7) == 7 and s.get("none") is None


def test_credentials():
    add = files.with_credentials
    assert add("https://h.org/a.git", "u:p") == "https://u:p@h.org/a.git"
    assert add("https://x@h.org/a.git", "u:p") == "https://x@h.org/a.git"
    assert add("git@h.org:a.git", "u:p") == "git@h.org:a.git" and add("https://h.org/a", None) == "https://h.org/a"


def test_project_inputs(tmp_path, tree):
    with files.project("local", str(tree)) as p:
        assert p == str(tree)
    with pytest.raises(FileNotFoundError), files.project("local", str(tmp_path / "none")):
        pass
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tree, check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "x")
    with files.project("git", str(tree)) as p:
        from pathlib import Path

        clone = Path(p)
        assert (clone / "a" / "views.py").read_text() == SHOP
    assert not clone.exists()
    with pytest.raises(RuntimeError) as e, files.project("git", str(tmp_path / "none"), "u:secret"):
        pass
    assert "secret" not in str(e.value)


def test_json_sources(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"x": 1}')
    (tmp_path / "a.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{bad")
    (tmp_path / "d.txt").write_text("{}")
    assert [tuple(r) for r in files.read_json_folder(spark, str(tmp_path)).collect()] == [("a.json", "[1]"), ("b.json", '{"x":1}')]
    assert files.read_json_folder(spark, str(tmp_path / "none")).count() == 0
    assert [r.data for r in files.read_json_file(spark, f"file://{tmp_path}/b.json").collect()] == ['{"x":1}']
    assert files.read_json_file(spark, str(tmp_path / "none.json")).count() == 0


def test_replies_by_scan():
    assert json.loads(object_text('Sure:\n```json\n{"a": [1, 2,], "b": "}",}\n```')) == {"a": [1, 2], "b": "}"}
    assert json.loads(object_text('{"a": {"b": [1, "x')) == {"a": {"b": [1, "x"]}}
    assert json.loads(object_text(r'{"a": "\" {"} tail }')) == {"a": '" {'}
    assert json.loads(object_text('{"a": [1, {"b": 2]}')) == {"a": [1, {"b": 2}]}
    assert object_text(" none ") == "none"


def test_model_replies_are_asked_for_again(spark, tmp_path):
    log = str(tmp_path / "asked")

    def model(prompt: str) -> str:
        with open(log, "a") as f:
            f.write(prompt + "\n")
        with open(log) as f:
            n = f.read().split("\n").count(prompt)
        if prompt == "never":
            raise RuntimeError("down")
        return '{"other": 1}' if n < 3 else '```json\n{"postman": {},}\n```'

    df = spark.createDataFrame([("late",), ("never",)], "p string").coalesce(1)
    got = strict.generate_json(df, "p", "made", model, accept=strict.is_documentation).collect()
    assert [tuple(r) for r in got] == [("late", '{"postman":{}}'), ("never", None)]
    assert [r.said for r in strict.generate_text(df.where("p = 'x' or p = 'never'"), "p", "said", model).collect()] == [None]


def test_windows_split_a_text_once(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(7)))), (2, "a b"), (3, ""), (4, None)], "id long, t string")
    got = [(r.id, r.chunk_no, r.content, r.is_sub_chunk) for r in index.chunks(df, "t", 3, name=F.lit("f")).orderBy("id", "chunk_no").collect()]
    assert got == [(1, 0, "Context: Function f\n0 1 2", True), (1, 1, "Context: Function f\n3 4 5", True), (1, 2, "Context: Function f\n6", True), (2, 0, "a b", False), (3, 0, "", False)] + [g for g in got if g[0] == 4]
    long_ = spark.createDataFrame([(1, "w " * 40_000)], "id long, t string")
    assert index.chunks(long_, "t", 50).count() == 800


def test_extracted_classes_become_files(spark, tree, tmp_path):
    methods = entries.methods_of(spark, str(tree))
    docs.save_classes(methods, str(tmp_path / "ast"))
    made = {p.name: json.loads(p.read_text()) for p in (tmp_path / "ast").iterdir()}
    names = sorted(c["class_name"] for x in made.values() for c in x)
    assert len(made) == 2 and names == ["Other", "OrderService", "OrderView"] or names == sorted(["Other", "OrderService", "OrderView"])
    assert {r.file_name for r in files.read_json_folder(spark, str(tmp_path / "ast")).collect()} == set(made)


def test_dependencies_by_call_graph_and_by_model(spark, tree):
    mapped = {(r.class_name, r.method): r for r in entries.map_project(spark, str(tree)).collect()}
    assert mapped["OrderView", "get"].dependencies == ["order_service.load"] and mapped["OrderService", "load"].dependencies == []
    schema = "class_name string, methods array<struct<method_name: string, is_api_route: boolean, method_definition: string>>"
    classes = spark.createDataFrame([("A", [("m", True, "b.n()")]), ("B", [("n", False, "x")])], schema)
    model = lambda p: '{"methods": [{"method": "m", "dependencies": ["b.n"]}]}' if "Class: A" in p else "no idea"
    assert [tuple(r) for r in mapping.by_model(classes, model).collect()] == [("A", "m", ["b.n"], True)]
    assert "b.n()" in mapping.prompt(classes).first().prompt


def test_overloads_keep_their_own_context(spark):
    schema = "class_name string, method string, method_definition string, dependencies array<string>"
    m = spark.createDataFrame([("A", "f", "one", ["x.g"]), ("A", "f", "two", ["x.h"])], schema)
    d = spark.createDataFrame([("ast_method", "X", "g", "a.py", "G!"), ("ast_method", "X", "h", "a.py", "H!")], "type string, class_name string, method_name string, file_name string, content string")
    got = {r.method_definition: r.context for r in docs.dependency_context(m, d).collect()}
    assert "G!" in got["one"] and "H!" not in got["one"] and "H!" in got["two"]


def test_method_files_last_wins(spark, tmp_path):
    df = spark.createDataFrame([("A/x", "m", '{"postman": {"n": 1}}', 1), ("A/x", "m", '{"postman": {"n": 2}, "swagger": {"s": 1}}', 2), ("B", "m", '{"swagger": {}}', 3)], "class_name string, method string, documentation string, ord int")
    counts = docs.save_documentation(df, str(tmp_path), order="ord").first()
    assert (counts.methods_processed, counts.output_files) == (3, 2)
    read = lambda *p: json.loads((tmp_path.joinpath(*p)).read_text())
    assert read("A_x", "m", "postman.json") == {"n": 2} and read("A_x", "m", "swagger.json") == {"s": 1}
    assert read("B", "m", "postman.json") == {}


def test_index_policies_and_answers(spark, tmp_path):
    path = str(tmp_path / "index")
    doc = lambda *rows: index.embed(spark.createDataFrame(list(rows), "content string, type string, method_name string, class_name string"))
    a, b = ("load an order", "ast_method", "load", "Order"), ("paint a wall", "code_mapper", "paint", "Wall")
    count = lambda *x, **k: {r["type"]: r["count"] for r in index.write_index(doc(*x), path, **k).collect()}
    assert count(a, a) == {"ast_method": 1}
    assert count(a, b, policy="skip") == {"ast_method": 1, "code_mapper": 1}
    assert count(("paint a wall", "code_mapper", "other", "Wall"), policy="upsert") == {"ast_method": 1, "code_mapper": 1}
    assert [r.method_name for r in index.read_index(spark, path).where("type = 'code_mapper'").collect()] == ["other"]
    with pytest.raises(ValueError, match="some of these"):
        count(a, policy="fail")
    with pytest.raises(ValueError, match="unknown policy"):
        count(a, policy="x")
    found = index.read_index(spark, path)
    assert [r.content for r in index.by_class(found, "Order").collect()] == ["load an order"]
    assert entries.retrieve(found, "load order").first().content == "load an order"
    row = entries.answer(found, "load order", lambda p: p.upper()).first()
    assert row.prompt.index("load an order") < row.prompt.index("paint a wall") and row.answer == row.prompt.upper()
    assert count(b, policy="replace") == {"code_mapper": 1}


def test_providers():
    assert isinstance(providers.generator("LOCAL", env={}), providers.Local)
    assert providers.generator("Gemini", env={"GOOGLE_API_KEY": "k"}).key == "k"
    for name, key in (("openai", "OPENAI_API_KEY"), ("google", "GOOGLE_API_KEY")):
        with pytest.raises(ValueError, match=key):
            providers.generator(name, env={})
    with pytest.raises(ValueError, match="unknown provider"):
        providers.generator("none", env={})
    assert providers.generator("Mine", env={"x": "1"}, more={"mine": lambda env: lambda p: p + env["x"]})("a") == "a1"


def test_traces_never_stop_a_plan():
    got = []
    with trace.span("one", got.append):
        pass
    with pytest.raises(KeyError), trace.span("two", got.append):
        raise KeyError("x")
    with trace.span("three", lambda _: 1 / 0):
        pass
    assert [(x["name"], x["error"] is None) for x in got] == [("one", True), ("two", False)]


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    write = lambda i: spark.createDataFrame([(i, "w " * 700, None, None, 0)], chunks.SCHEMA).write.mode("append").parquet(src)
    for i in range(2):
        write(i)
        chunks.run_once(chunks.chunk_stream(spark, src), out, cp)
        assert spark.read.parquet(out).count() == 2 * (i + 1)


def test_command_line(spark, tree, tmp_path, capsys):
    out = lambda x: str(tmp_path / x)
    cli.main(["extract", str(tree), out("ast")], spark)
    assert len(list((tmp_path / "ast").iterdir())) == 2
    cli.main(["map", str(tree), out("mapped")], spark)
    assert "order_service.load" in spark.read.text(out("mapped")).first()[0]
    cli.main(["index", str(tree), out("index")], spark)
    assert "Class: OrderView" in cli.main(["ask", out("index"), "Class: OrderView Method: get"], spark)
    cli.main(["document", str(tree), out("docs")], spark)
    assert (tmp_path / "docs" / "OrderView" / "get" / "swagger.json").exists()
    with pytest.raises(SystemExit):
        cli.main(["none"], spark)


def test_text_edges(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.join_path(F.lit("/a/"), F.lit("/b"))) == "/a/b" and one(T.join_path(F.lit("/a"), F.lit(None).cast("string"))) == "/a"
    assert one(strict.safe_parse(F.lit("{bad"), F.lit("{}"))) == "{}"


def test_replies_are_cut_and_closed(spark):
    cases = {
        '```json\n{"a": 1}\n```': '{"a": 1}', "so {x} and {y} end": "{x} and {y}", "```\n[1, 2]\n```": "[1, 2]", "  plain ": "plain", "```json [1": "[1", "} {": "} {", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", T.extract_json(F.col("t")).alias("x")).collect()} == cases
    cases = {
        '{"a": [1, {"b": 2': '{"a": [1, {"b": 2}]}', '{"a": [1, 2,], }': '{"a": [1, 2]}', '{"a": "{[': '{"a": "{["}', '{"a": "\\"}': '{"a": "\\"}"}', "[]": "[]", "x": "x", '{"a": "]"': '{"a": "]"}', "]": "]", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", T.repair_json(F.col("t")).alias("x")).collect()} == cases
