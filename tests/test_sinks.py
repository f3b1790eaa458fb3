"""Committed files, the bucketed index, the source tree and what else reads and writes projects."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sparkloom.operators import docs, index, shape
from sparkloom.plans import entries
from sparkloom.sources import filesink, srctree

TREE = {
    "app.py": "class A:\n    def m(self):\n        return 1\n", "_hidden.py": "x", ".env.py": "y", "src/deep/b.ts": "export class B { m() { return 1 } }",
    "src/node_modules/x.ts": "no", "node_modules/y.ts": "no", ".git/z.py": "no", "__pycache__/c.py": "no", ".venv/lib/d.py": "class D:\n    pass\n", "src/.venv/e.py": "no",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.py").write_bytes(b"ok \xff\xfe end")
    return root


def names(df, root) -> set:
    return {os.path.relpath(r.path, root) for r in df.collect()}


def test_tree_leaves_out_folders_at_any_depth(spark, tree):
    assert names(srctree.read_tree(spark, str(tree)), tree) == {"app.py", "_hidden.py", ".env.py", "bad.py", "src/deep/b.ts"}
    assert names(srctree.read_heads(spark, str(tree)), tree) == {"app.py", "_hidden.py", ".env.py", "bad.py", "src/deep/b.ts", ".venv/lib/d.py", "src/.venv/e.py"}
    assert names(srctree.read_tree(spark, str(tree), exclude="src"), tree) >= {"node_modules/y.ts", ".git/z.py"}


def test_tree_bad_bytes_and_heads(spark, tree):
    row = lambda d: d.where("file_name = 'bad.py'").first()
    strict, lossy = row(srctree.read_tree(spark, str(tree))), row(srctree.read_tree(spark, str(tree), errors="ignore"))
    assert (strict.content, strict.error) == (None, "UnicodeDecodeError") and (lossy.content, lossy.error) == ("ok  end", None)
    assert row(srctree.read_heads(spark, str(tree), 4)).content == "ok  "
    with pytest.raises(FileNotFoundError):
        srctree.read_tree(spark, str(tree / "none"))


def test_driver_lists_one_level_and_names_answer_filters(tree, monkeypatch):
    reader = srctree.Reader({"path": str(tree)})
    seen = []
    walk = os.walk
    monkeypatch.setattr(os, "walk", lambda top: seen.append(top) or walk(top))
    parts = reader.partitions()
    assert not seen and [p.folder and os.path.basename(p.folder) for p in parts] == [None, "src"]
    rest = list(reader.pushFilters([srctree.StringEndsWith(("path",), ".ts"), srctree.EqualTo(("content",), "x")]))
    assert rest == [srctree.EqualTo(("content",), "x")]
    opened = [r[1] for p in reader.partitions() for r in reader.read(p)]
    assert opened == ["b.ts"]


def test_tree_filters_by_spark(spark, tree):
    d = srctree.read_tree(spark, str(tree))
    assert names(d.where(F.col("path").endswith(".ts")), tree) == {"src/deep/b.ts"}
    assert names(d.where(F.col("file_name").isin("app.py", "none")), tree) == {"app.py"}
    assert d.where("content like '%class%' and path like '%.py'").count() == 1


def files_of(folder) -> dict:
    return {os.path.relpath(p, folder): p.read_text() for p in Path(folder).rglob("*") if p.is_file()}


def test_files_appear_at_commit(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a/x.json", '{"é": [1]}'), ("b.json", "{}"), ("c.json", "null")], "name string, text string")
    filesink.write_files(df, out, indent=2)
    assert files_of(out) == {"a/x.json": '{\n  "é": [\n    1\n  ]\n}', "b.json": "{}", "c.json": "null"}
    filesink.write_files(df.limit(0), out)
    filesink.write_files(spark.createDataFrame([("b.json", "new")], "name string, text string"), out)
    assert files_of(out)["b.json"] == "new" and len(files_of(out)) == 3
    filesink.write_files(spark.createDataFrame([("d.txt", None)], "name string, text string"), out, mode="overwrite")
    assert files_of(out) == {"d.txt": ""}


@pytest.mark.parametrize("bad", ["{broken", "outside"])
def test_a_failed_write_leaves_what_was_there(spark, tmp_path, bad):
    out = str(tmp_path / "out")
    filesink.write_files(spark.createDataFrame([("a.json", "{}")], "name string, text string"), out)
    rows = [(f"n{i}.json", "{}") for i in range(50)] + [("z.json", bad) if bad != "outside" else ("../../z.json", "{}")]
    with pytest.raises(Exception, match="JSON|not a name|Expecting"):
        filesink.write_files(spark.createDataFrame(rows, "name string, text string").repartition(4), out, mode="overwrite", indent=1)
    assert files_of(out) == {"a.json": "{}"} and not (tmp_path / "z.json").exists()


def test_attempts_that_spark_did_not_take_leave_nothing(tmp_path, monkeypatch):
    class At:
        n = 0

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            At.n += 1
            return At.n

    monkeypatch.setattr(filesink.TaskContext, "get", staticmethod(lambda: At()))
    w = filesink.Writer({"path": str(tmp_path / "out")}, False)
    first = w.write(iter([("a", "half")]))
    second = w.write(iter([("a", "whole"), ("b", "too")]))
    assert first.folder != second.folder and not (tmp_path / "out" / "a").exists()
    w.commit([second, None])
    assert files_of(tmp_path / "out") == {"a": "whole", "b": "too"}
    w.abort([])


def test_classes_and_methods_in_the_order_of_the_source(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.ts").write_text("export class Z { z() { return 1 } b() { return 2 } a() { return 3 } }\nexport class A { y() { return 1 } }")
    docs.save_classes(entries.methods_of(spark, str(root)), str(tmp_path / "ast"))
    (made,) = files_of(tmp_path / "ast").values()
    got = json.loads(made)
    assert [(c["class_name"], [m["method_name"] for m in c["methods"]]) for c in got] == [("Z", ["z", "b", "a"]), ("A", ["y"])]
    assert set(got[0]) == {"class_name", "class_type", "base_path", "methods"} and got[0]["methods"][0]["method_path"] is None


def test_artifacts(spark, tmp_path):
    rows = [("/users/{id}", "get", "One user", None, '{"id": 1}', 0), ("/users", "POST", None, '{"n": 2}', None, 1)]
    df = spark.createDataFrame(rows, "path string, method string, description string, example_request string, example_response string, ord int")
    made = docs.generate_artifacts(df, str(tmp_path), "Shop", ["take care"])
    assert set(made) == {"swagger", "postman", "examples"} and len({os.path.dirname(p) for p in made.values()}) == 1
    text = Path(made["swagger"]).read_text()
    swagger = json.loads(text)
    assert text == json.dumps(swagger, indent=2) and swagger["info"]["title"] == "Shop" and list(swagger["paths"]) == ["/users/{id}", "/users"]
    assert [i["request"]["method"] for i in json.loads(Path(made["postman"]).read_text())["item"]] == ["GET", "POST"]
    assert '"get_users_id": {"request": {}, "response": {"id": 1}}' in Path(made["examples"]).read_text()
    empty = docs.generate_artifacts(df.limit(0), str(tmp_path / "none"))
    assert json.loads(Path(empty["swagger"]).read_text())["paths"] == {}


def test_point_lookup(spark):
    m = spark.createDataFrame([("A", "m", ["b.x", "c.y"]), ("A", "n", None)], "class_name string, method string, dependencies array<string>")
    assert docs.method_dependencies(m, "A", "m") == ["b.x", "c.y"]
    assert docs.method_dependencies(m, "A", "n") == docs.method_dependencies(m, "B", "m") == []


def test_documentation_by_a_model_or_else_the_fallback(spark):
    schema = "class_name string, method string, method_type string, method_path string, base_path string, method_definition string, context string"
    df = spark.createDataFrame([("A", "good", "Get", "/x", "/", "code", "none"), ("A", "bad", None, None, None, None, "none")], schema)

    def model(prompt: str) -> str:
        if "Method: bad" in prompt:
            raise RuntimeError("down")
        return 'Sure: {"postman": {"a": 1}, "swagger": {"b": 2},}'

    got = {r["method"]: json.loads(r.documentation) for r in docs.documentation(df, model).collect()}
    assert got["good"] == {"postman": {"a": 1}, "swagger": {"b": 2}}
    assert got["bad"]["postman"]["request"] == {"method": "GET", "header": [], "url": {"raw": "{{baseUrl}}/"}} and set(got["bad"]["swagger"]["responses"]) == {"200", "400", "500"}


def test_strict_schema(spark):
    schema = f"class_name string, base_path string, methods array<{shape.METHOD}>"
    good = ("A", "/", [("m", None, True, None, "x")])
    assert shape.strict_classes(spark.createDataFrame([good], schema)).count() == 1
    for bad in [(" ", None, True, None, "x"), ("m", None, None, None, "x"), ("m", None, True, None, None)]:
        with pytest.raises(Exception, match="class is not valid"):
            shape.strict_classes(spark.createDataFrame([good, ("B", "/", [bad])], schema)).collect()
    with pytest.raises(Exception, match="class is not valid"):
        shape.strict_classes(spark.createDataFrame([("B", "/", None)], schema)).collect()


def doc(spark, *rows):
    return spark.createDataFrame(list(rows), "content string, type string, n int")


def parquet(path: str) -> dict:
    return {os.path.relpath(p, path): p.stat().st_size for p in Path(path).rglob("*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(doc(spark, *[(f"text {i} " + "x" * 50, "ast_method" if i % 2 else "code_mapper", i) for i in range(1000)]), path, buckets=50)
    before = parquet(path)
    new = [(f"text {i} " + "x" * 50, "ast_method", -i) for i in range(1, 11)]
    counts = {r["type"]: r["count"] for r in index.write_index(doc(spark, *new), path, policy="upsert").collect()}
    after = parquet(path)
    assert sum(counts.values()) == 1000 and counts["ast_method"] == 505
    folder = lambda files: {os.path.dirname(f) for f in files}
    fresh = set(after) - set(before)
    assert 0 < len(folder(fresh)) <= 10 and folder(fresh) == folder(set(before) - set(after)) and len(folder(after)) == 50
    assert sum(after[f] for f in fresh) < 0.3 * sum(after.values())
    assert {r.n for r in index.read_index(spark, path).where("n < 0").collect()} == {-i for i in range(1, 11)}
    index.write_index(doc(spark, ("brand new", "ast_method", 7), new[0]), path, policy="skip")
    assert set(after) < set(parquet(path)) and index.read_index(spark, path).count() == 1001
    with pytest.raises(ValueError, match="some of these"):
        index.write_index(doc(spark, new[0]), path, policy="fail")
    index.write_index(doc(spark, new[0]), path, buckets=3)
    assert index.read_index(spark, path).count() == 1 and {f.split("=")[0] for f in parquet(path)} == {"in_3"}


def test_new_columns_and_no_index(spark, tmp_path):
    path = str(tmp_path / "index")
    assert index.read_index(spark, path) is None
    index.write_index(doc(spark, ("a", "t", 1)), path)
    index.write_index(doc(spark, ("b", "t", 2)).withColumn("more", F.lit("m")), path, policy="upsert")
    assert {(r.content, r.more) for r in index.read_index(spark, path).collect()} == {("a", None), ("b", "m")}


def test_numbers_from_the_write_itself(spark, tmp_path):
    path = str(tmp_path / "index")
    seen = lambda rows, **k: (index.write_index(rows, path, observe=(o := Observation()), **k), o.get)[1]
    assert seen(doc(spark)) == {"ast_documents_written": 0, "mapper_documents_written": 0, "total_documents": 0} and not os.path.exists(path)
    rows = doc(spark, ("a", "ast_method", 1), ("a", "ast_method", 2), ("b", "code_mapper", 3), ("c", "other", 4))
    assert seen(rows) == {"ast_documents_written": 1, "mapper_documents_written": 1, "total_documents": 3}
    assert seen(doc(spark, ("c", "ast_method", 4)), policy="upsert")["total_documents"] == 1
    assert seen(doc(spark, ("c", "ast_method", 4), ("d", "ast_method", 4)), policy="skip")["total_documents"] == 1
