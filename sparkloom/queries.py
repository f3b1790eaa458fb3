"""One query for each operator over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import code_queries
from .functions import strict, variant
from .functions import text as T
from .operators import docs as D
from .operators import index as I
from .operators import lexical, lsa, mapping, shape, vectors
from .runtime import ship, stored


def _t(name: str):
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")


documents, pages, events, conversations, embeddings, benchmark, labels = map(_t, ("documents", "pages", "events", "conversations", "embeddings", "benchmark", "labels"))

PATHS = ["src/app.ts", "src/App.TS", "a/B.java", "m.py", "x/y.cs", "z.js", "k.go", "i.php", "a.cpp", "b.cc", "c.cxx", "d.h", "e.hpp", "readme.md", "a/.py", "x.tar.GZ", "..a.py", "d.x/noext", "a.", "v.tsx"]
HEADS = [("a", "from django.http import HttpResponse"), ("b", "from fastapi import FastAPI"), ("c", "@Controller('x')"), ("d", "@SpringBootApplication class A {}"), ("e", "@GetMapping @RestController"), ("f", "using Microsoft.AspNetCore.Mvc;"), ("g", "const e = require('express')"), ("h", "namespace App\\Http\\Controllers;"), ("i", "import pandas"), ("j", "int main() {}")]
ROUTES = [("/users/{token}", "GET"), ("/api/{client_secret}/data", "GET"), ("/users/{id}", "GET"), ("/auth", "POST"), ("/auth/login", "POST"), ("/x/auth/login", "POST"), ("/{author}/books", "GET"), ("/{id}/token/{x}", "PUT"), ("/API/{Key}", "GET"), ("/password/", "GET")]
URL_PATH = r"^[a-z]+://[^/]+(/[^?#]*)"


def sql_list(rows: list[tuple]) -> str:
    q = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = I.chunks(documents(spark, sf).select("doc_id", "text"), size=500, name=F.col("doc_id").cast("string"))
    return d.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "is_sub_chunk", F.md5("content").alias("content_md5"))


def language_by_extension(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.createDataFrame([(p,) for p in PATHS], "path string")
    d = pages(spark, sf).select(F.col("url").alias("path")).union(fixed)
    return d.select("path", T.language(F.col("path")).alias("language"))


def framework_of_file(spark: SparkSession, sf: str) -> DataFrame:
    d = pages(spark, sf).select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    d = d.union(spark.createDataFrame(HEADS, "path string, content string"))
    return d.select("path", F.coalesce(T.framework(F.col("content")), F.lit("Unknown")).alias("framework"), F.coalesce(T.framework(F.col("content"), "reference"), F.lit("Unknown")).alias("framework_ref"))


def framework_of_project(spark: SparkSession, sf: str) -> DataFrame:
    d = pages(spark, sf).select(F.col("url").alias("path"), F.col("html").alias("content"))
    return shape.project_framework(d.union(spark.createDataFrame(HEADS[3:], "path string, content string")))


def security_alerts(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.createDataFrame(ROUTES, "path string, method string").withColumn("url", F.lit("https://x"))
    d = pages(spark, sf).select(F.regexp_extract("url", URL_PATH, 1).alias("path"), F.lit("GET").alias("method"), "url").unionByName(fixed)
    d = d.select("path", "method", "url", F.explode_outer(T.endpoint_alerts(F.col("path"), F.col("method"), F.col("url"))).alias("alert"))
    return d.withColumn("global_alert", F.get(T.global_alerts(F.col("url")), F.lit(0)))


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    fence = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    prose = F.concat(F.lit("Here it is: "), F.regexp_replace("props", r"\}$", ",}"), F.lit(" - done"))
    return events(spark, sf).select("event_id", F.when(k == 0, fence).when(k == 1, prose).otherwise(F.concat(F.lit("x "), "props")).alias("reply"))


def json_extract_repair(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).select("event_id", T.repair_json(T.extract_json(F.col("reply"))).alias("json"))


def json_strict_parse(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return _replies(spark, sf).select("event_id", strict.safe_parse(F.col("reply"), F.lit("{}")).alias("json"))


def replies_typed(spark: SparkSession, sf: str) -> DataFrame:
    """The number in each reply, by VARIANT."""
    d = _replies(spark, sf).select("event_id", variant.reply_variant(F.col("reply")).alias("v"))
    return d.select("event_id", variant.typed(F.col("v"), "$.k", "long").alias("k"), F.col("v").isNotNull().alias("valid"))


def replies_schema(spark: SparkSession, sf: str) -> DataFrame:
    """The schema that the replies of each kind of event fit."""
    e = events(spark, sf).select("event_id", "event_type")
    d = _replies(spark, sf).join(e, "event_id").withColumn("v", variant.reply_variant(F.col("reply")))
    return variant.merged_schema(d, "v", ["event_type"])


def code_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("\n "), F.replace("text", F.lit(" "), F.lit("\n\n\n\n")), F.lit(" \n"))
    return conversations(spark, sf).select("conv_id", "turn", F.md5(T.trim_code(raw)).alias("trimmed"), F.md5(T.unquote(F.concat(F.lit('"'), "text", F.lit('"')))).alias("unquoted"))


def metadata_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = conversations(spark, sf).select(F.col("role").alias("type"), F.col("turn").cast("string").alias("method_name"), F.col("conv_id").alias("class_name"), "text")
    return I.by_method(d, "1", "assistant").select("class_name", F.md5("text").alias("text_md5"))


def class_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select(F.lit("ast_method").alias("type"), F.col("source").alias("class_name"), F.col("doc_id").cast("string").alias("method_name"), "text")
    u = I.union_documents(d, conversations(spark, sf).select(F.lit("code_mapper").alias("type"), F.lit("src0").alias("class_name"), F.col("turn").cast("string").alias("method_name"), "text"))
    return I.by_class(u, "src0").select("method_name", F.md5("text").alias("text_md5"))


def docs_prompt(spark: SparkSession, sf: str) -> DataFrame:
    m = _turns(spark, sf).withColumn("method", F.when(F.col("ord") > 0, F.col("method_name"))).withColumn("class_name", F.col("class_name").cast("string"))
    return m.select("class_name", "ord", F.md5(D.prompt(F.lit("None."))).alias("prompt_md5"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    d = conversations(spark, sf)
    return d.select(F.lit("c").alias("path"), F.lit("f").alias("file_name"), F.col("conv_id").cast("string").alias("class_name"), F.lit(0).alias("class_ord"), F.lit("T").alias("class_type"), F.lit("/").alias("base_path"), F.col("turn").cast("int").alias("ord"), F.col("turn").cast("string").alias("method_name"), F.col("role").alias("method_type"), (F.col("role") == "user").alias("is_api_route"), F.lit(None).cast("string").alias("method_path"), F.md5("text").alias("method_definition"))


def flatten_methods(spark: SparkSession, sf: str) -> DataFrame:
    d = shape.flatten_classes(shape.nest_classes(_turns(spark, sf)))
    return d.select("class_name", "ord", "method_name", "method_type", "is_api_route")


def schema_check(spark: SparkSession, sf: str) -> DataFrame:
    d = _turns(spark, sf).withColumn("method_name", F.when(F.col("class_name").cast("long") % 5 == 0, " ").otherwise(F.col("method_name"))).withColumn("base_path", F.lit(None).cast("string"))
    good, bad = shape.check_classes(shape.nest_classes(d))
    return good.select("class_name", "base_path", F.lit("").alias("reason")).union(bad.select("class_name", "base_path", "reason"))


def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = pages(spark, sf).select(F.regexp_extract("url", URL_PATH, 1).alias("path"), "page_id")
    return shape.first_wins(d, ["path"], ["page_id"])


def last_wins_by_key(spark: SparkSession, sf: str) -> DataFrame:
    d = pages(spark, sf).select(F.regexp_extract("url", URL_PATH, 1).alias("path"), "page_id", F.col("page_id").alias("ord"))
    return shape.last_wins(d, ["path"], "ord").select("path", "page_id")


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest rows to every vector whose id is divisible by 50, by comparing all."""
    e = embeddings(spark, sf)
    return vectors.exact_top_k(e, e.where("vec_id % 50 = 0"), 10, "vec_id")


def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the index, and the share of the exact results that each query found."""
    e = embeddings(spark, sf)
    q = e.where("vec_id % 50 = 0")
    found = vectors.search(vectors.build_index(e, key="vec_id"), q, 10, key="vec_id")
    hit = vectors.exact_top_k(e, q, 10, "vec_id").select("query", "id", F.lit(1).alias("hit"))
    d = found.join(hit, ["query", "id"], "left").withColumn("recall", F.sum(F.coalesce("hit", F.lit(0))).over(W.partitionBy("query")) / 10)
    return d.select("query", "rank", "id", "score", "recall")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark(spark, sf).where("item_id % 50 = 0")


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for every benchmark text whose id is divisible by 50."""
    return lexical.search_text(lexical.build_text_index(documents(spark, sf)), _asked(spark, sf), 10)


def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Of the ten documents retrieved for each benchmark text, the five best by the words they share, rare ones first."""
    docs, asked = documents(spark, sf), _asked(spark, sf)
    made = lexical.build_text_index(docs)
    found = stored(lexical.search_text(made, asked, 10), "found")
    scored = lexical.weighted_overlap(found.drop("rank", "score"), made, asked, docs)
    return I.rerank(scored, F.col("rerank"), 5, key="id", query="query").select("query", F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), F.col("rerank").alias("score"))


def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors learned from the documents."""
    d = documents(spark, sf).select("doc_id", "text")
    made = lsa.learn(d)
    return made.embed(d, counts=made.counts).select("doc_id", F.size("embedding").alias("dim"), "embedding")


def embedding_weights(spark: SparkSession, sf: str) -> DataFrame:
    """What each feature of the embedding weighs."""
    counts = stored(lsa.term_counts(documents(spark, sf), "doc_id", "text", 4096), "terms")
    return lsa.weights(counts, counts.count()).select("feature", "df", F.round("idf", 6).alias("idf"))


def rag_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of every benchmark text, with the documents found for it."""
    best = stored(rerank_topk(spark, sf), "best")
    found = best.join(lexical.narrowed(documents(spark, sf).select("doc_id", F.col("text").alias("content")), best.select("doc_id").distinct(), "doc_id"), "doc_id")
    asked = _asked(spark, sf).select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    return I.rag_prompts(found, asked).select("query", F.md5("prompt").alias("prompt_md5"))


def method_docs(spark: SparkSession, sf: str) -> DataFrame:
    m = _turns(spark, sf)
    mapped = m.select("class_name", F.col("method_name").alias("method"), F.when(F.col("ord") == 0, T.no_strings()).otherwise(F.array(F.lit("a.b"), F.lit("c.d"))).alias("dependencies"))
    u = I.union_documents(I.method_documents(m), I.mapper_documents(mapped))
    return u.select("type", "class_name", "method_name", "dependency_count", F.md5("content").alias("content_md5"))


def index_counts(spark: SparkSession, sf: str) -> DataFrame:
    u = I.union_documents(documents(spark, sf).select(F.lit("document").alias("type"), F.col("text").alias("content")), conversations(spark, sf).select(F.lit("turn").alias("type"), F.col("text").alias("content"), "role"))
    return u.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("role").alias("n_role"))


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    deps = F.when(F.col("ord") == 0, T.no_strings()).otherwise(F.array(F.concat(F.lit("svc."), (F.col("ord") - 1).cast("string")), F.lit("x.nothing")))
    return _turns(spark, sf).select("class_name", F.col("method_name").alias("method"), deps.alias("dependencies"), "is_api_route")


def dependency_context(spark: SparkSession, sf: str) -> DataFrame:
    d = D.dependency_context(_mapped(spark, sf), I.method_documents(_turns(spark, sf)))
    return d.select("class_name", "method", F.md5("context").alias("context_md5"))


def method_details(spark: SparkSession, sf: str) -> DataFrame:
    d = D.with_details(D.api_methods(_mapped(spark, sf)), _turns(spark, sf))
    return d.select("class_name", "method", F.size("dependencies").alias("n_dependencies"), "method_type", "method_definition")


def flag_merge(spark: SparkSession, sf: str) -> DataFrame:
    m = documents(spark, sf).select(F.col("source").alias("class_name"), F.col("doc_id").cast("string").alias("method"))
    f = documents(spark, sf).join(labels(spark, sf), "doc_id").select(F.col("source").alias("class_name"), F.col("doc_id").cast("string").alias("method_name"), (F.col("quality") == 1).alias("is_api_route"), F.col("quality").alias("ord"))
    return mapping.with_flags(m, f)


def api_route_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = events(spark, sf).select(F.col("event_type").alias("class_name"), F.col("event_id").alias("method"), T.no_strings().alias("dependencies"), F.when(F.col("event_type") == "view", True).when(F.col("event_type") == "error", F.lit(None)).otherwise(False).alias("is_api_route"))
    return D.api_methods(d).select("class_name", "method", F.size("dependencies").alias("n_dependencies"))


def _endpoints(spark: SparkSession, sf: str) -> DataFrame:
    verb = F.element_at(F.array(*[F.lit(v) for v in ("get", "POST", "put")]), (F.col("page_id") % 3 + 1).cast("int"))
    return pages(spark, sf).select(F.regexp_extract("url", URL_PATH, 1).alias("path"), verb.alias("method"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("description"), F.lit(None).cast("string").alias("example_request"), F.to_json(F.struct("page_id")).alias("example_response"), F.col("page_id").alias("ord"))


def openapi_paths(spark: SparkSession, sf: str) -> DataFrame:
    d = D.openapi_operations(_endpoints(spark, sf))
    return d.select("path", "verb", "ord", F.col("operation.summary").alias("summary"), F.col("operation.description").alias("description"), F.col("operation.tags")[0].alias("tag"))


def openapi_document(spark: SparkSession, sf: str) -> DataFrame:
    return D.openapi(_endpoints(spark, sf))


def postman_items(spark: SparkSession, sf: str) -> DataFrame:
    d = D.postman_items(_endpoints(spark, sf))
    return d.select("ord", F.col("item.name").alias("name"), F.col("item.request.method").alias("method"), F.col("item.request.url.raw").alias("raw"), F.array_join("item.request.url.path", "|").alias("segments"))


def postman_document(spark: SparkSession, sf: str) -> DataFrame:
    return D.postman(_endpoints(spark, sf))


def examples_map(spark: SparkSession, sf: str) -> DataFrame:
    return D.examples(_endpoints(spark, sf)).select("key", "request", "response", "ord")


def examples_ts(spark: SparkSession, sf: str) -> DataFrame:
    return D.examples_ts(_endpoints(spark, sf))


def fallback_documentation(spark: SparkSession, sf: str) -> DataFrame:
    d = pages(spark, sf).select("page_id", F.regexp_extract("url", URL_PATH, 1).alias("method_path"), F.concat(F.lit("m"), F.col("page_id").cast("string")).alias("method"), F.when(F.col("page_id") % 2 == 0, "Get").alias("method_type"), F.lit("/api/").alias("base_path"))
    j = F.col("documentation")
    return D.documentation(d).select("page_id", F.get_json_object(j, "$.postman.request.url.raw").alias("url"), F.get_json_object(j, "$.postman.request.method").alias("verb"), F.get_json_object(j, "$.swagger.summary").alias("summary"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_documents, language_by_extension, framework_of_file, framework_of_project, security_alerts, json_extract_repair, json_strict_parse, replies_typed, replies_schema, code_text, metadata_filter, class_filter, docs_prompt, flatten_methods, schema_check,
        first_wins_dedup, last_wins_by_key, vector_topk, vector_index, bm25_topk, rerank_topk, embed_documents, embedding_weights, rag_prompt, method_docs, index_counts, dependency_context, method_details, flag_merge, api_route_filter, openapi_paths,
        openapi_document, postman_items, postman_document, examples_map, examples_ts, fallback_documentation,
    )
}
QUERIES |= code_queries.QUERIES

_EXT = " ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())
_PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"
_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
_ENDPOINTS = f"ep AS (SELECT {_PATH} AS path, ['get','POST','put'][page_id % 3 + 1] AS method, 'Page ' || page_id AS description, page_id AS ord FROM pages)"
_TURNS = "turns AS (SELECT conv_id::VARCHAR AS class_name, turn::INT AS ord, turn::VARCHAR AS method_name, role AS method_type, role = 'user' AS is_api_route, md5(text) AS method_definition FROM conversations)"
_BAG = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"
_BM25 = f"""bags AS (SELECT doc_id, {_BAG} AS w FROM documents), tf AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM bags),
        tfs AS (SELECT doc_id, n, term, count(*) AS c FROM tf GROUP BY ALL), stat AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM bags),
        df AS (SELECT term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tfs, stat GROUP BY term, docs),
        asked AS (SELECT item_id AS query, unnest(list_distinct({_BAG})) AS term FROM benchmark WHERE item_id % 50 = 0),
        scores AS (SELECT query, doc_id AS id, round(sum(idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM asked JOIN df USING (term) JOIN tfs USING (term), stat GROUP BY query, doc_id),
        best AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank, id, score FROM scores QUALIFY rank <= 10)"""
_REPLY = r"""rep AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || regexp_replace(props, '\}$', ',}') || ' - done' ELSE 'x ' || props END AS reply FROM events)"""


def _framework_sql(order: list[str]) -> str:
    has = lambda m: "contains(h, '" + m.replace("'", "''") + "')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(has(m) for m in T.FRAMEWORKS[f])} THEN '{f}'" for f in order) + " ELSE 'Unknown' END"


_REF = list(T.FRAMEWORKS)
_OWN = ["Django", "FastAPI", "SpringBoot", "NestJS", ".NET", "Express", "Laravel"]
_HEADS = f"SELECT * FROM (VALUES {sql_list(HEADS)}) t(path, content)"
_ALERT = " ".join(f"""CASE WHEN regexp_matches(lower(path), '\\{{.*{k}.*\\}}') OR contains(lower(path), '/{k}/') THEN 'SECURITY ALERT: Endpoint ' || method || ' ' || path || ' seems to be passing a ''{k}'' in the URL path. Sensitive data should be passed in headers or body.' END,""" for k in T.SENSITIVE).rstrip(",")
_TRIM = r"regexp_replace(%s, '^/+|/+$', '', 'g')"
_TAG = f"CASE WHEN path = '/' THEN 'root' ELSE split_part({_TRIM % 'path'}, '/', 1) END"

ORACLES = {
    "chunk_documents": f"""WITH d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, text, w, unnest(CASE WHEN len(w) > 500 THEN range(0, ((len(w) + 499) // 500)::BIGINT) ELSE [0] END) AS chunk_no FROM d)
        SELECT doc_id, chunk_no::BIGINT AS chunk_no, len(w) > 500 AS is_sub_chunk, md5(CASE WHEN len(w) > 500 THEN 'Context: Function ' || doc_id || chr(10) || array_to_string(w[chunk_no * 500 + 1 : chunk_no * 500 + 500], ' ') ELSE text END) AS content_md5 FROM p""",
    "language_by_extension": f"""WITH p AS (SELECT url AS path FROM pages UNION ALL SELECT * FROM (VALUES {sql_list([(x,) for x in PATHS])}) t(path)), x AS (SELECT path, lower(regexp_extract(path, '[^./][^/]*(\\.[^./]*)$', 1)) AS e FROM p) SELECT path, CASE {_EXT} ELSE 'unknown' END AS language FROM x""",
    "framework_of_file": f"WITH p AS (SELECT page_id::VARCHAR AS path, html AS content FROM pages UNION ALL {_HEADS}), x AS (SELECT path, substr(content, 1, 10000) AS h FROM p) SELECT path, {_framework_sql(_OWN)} AS framework, {_framework_sql(_REF)} AS framework_ref FROM x",
    "framework_of_project": f"WITH p AS (SELECT url AS path, html AS content FROM pages UNION ALL SELECT path, content FROM ({_HEADS}) WHERE path > 'c'), y AS (SELECT path, {_framework_sql(_OWN)} AS f FROM (SELECT path, substr(content, 1, 10000) AS h FROM p)) SELECT coalesce(arg_min(f, path) FILTER (f <> 'Unknown'), 'Unknown') AS framework FROM y",
    "security_alerts": f"""WITH p AS (SELECT {_PATH} AS path, 'GET' AS method, url FROM pages UNION ALL SELECT path, method, 'https://x' FROM (VALUES {sql_list(ROUTES)}) t(path, method)), a AS (SELECT *, list_filter([CASE WHEN starts_with(url, 'http://') THEN 'SECURITY ALERT: Endpoint ' || method || ' ' || path || ' is using HTTP. Use HTTPS for secure communication.' END, {_ALERT}], lambda x: x IS NOT NULL) AS l FROM p)
        SELECT path, method, url, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS alert, CASE WHEN starts_with(url, 'http://') THEN '{T.GLOBAL_ALERT}' END AS global_alert FROM a""",
    "json_extract_repair": f"WITH {_REPLY} SELECT event_id, regexp_replace(regexp_extract(reply, '(\\{{[^}}]*\\}})', 1), ',\\s*([}}\\]])', '\\1', 'g') AS json FROM rep",
    "json_strict_parse": """SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS json FROM events""",
    "replies_typed": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS valid FROM events",
    "replies_schema": "SELECT event_type, count(*) AS replies, count(*) AS valid, 'OBJECT<k: BIGINT>' AS schema FROM events GROUP BY event_type",
    "code_text": r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(replace(text, ' ', chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS trimmed, md5(text) AS unquoted FROM conversations",
    "metadata_filter": "SELECT conv_id AS class_name, md5(text) AS text_md5 FROM conversations WHERE role = 'assistant' AND turn = 1",
    "flatten_methods": f"WITH {_TURNS} SELECT class_name, (row_number() OVER (PARTITION BY class_name ORDER BY ord) - 1)::INT AS ord, method_name, method_type, is_api_route FROM (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY class_name, method_name ORDER BY ord) = 1)",
    "schema_check": "SELECT DISTINCT conv_id::VARCHAR AS class_name, '/' AS base_path, CASE WHEN conv_id % 5 = 0 THEN 'method name is blank' ELSE '' END AS reason FROM conversations",
    "first_wins_dedup": f"SELECT {_PATH} AS path, min(page_id) AS page_id FROM pages GROUP BY 1",
    "last_wins_by_key": f"SELECT {_PATH} AS path, max(page_id) AS page_id FROM pages GROUP BY 1",
    "vector_topk": """WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank, id, score FROM s QUALIFY rank <= 10""",
    "embedding_weights": f"""WITH w AS (SELECT doc_id, unnest({_BAG}) AS w FROM documents), f AS (SELECT DISTINCT doc_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 4096)::INT AS feature FROM w), n AS (SELECT count(DISTINCT doc_id) AS n FROM w)
        SELECT feature, count(*) AS df, round(ln((1 + n) / (1 + count(*))) + 1, 6) AS idf FROM f, n GROUP BY feature, n""",
    "bm25_topk": f"WITH {_BM25} SELECT query, rank, id, score FROM best",
    "rerank_topk": f"""WITH {_BM25}, total AS (SELECT query, sum(coalesce(idf, 0)) AS a FROM asked LEFT JOIN df USING (term) GROUP BY query),
        shared AS (SELECT query, doc_id, round(sum(idf) / any_value(a), 6) AS score FROM best JOIN tfs ON tfs.doc_id = best.id JOIN asked USING (query, term) JOIN df USING (term) JOIN total USING (query) GROUP BY query, doc_id)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM shared QUALIFY rank <= 5""",
    "method_docs": f"""WITH {_TURNS} SELECT 'ast_method' AS type, class_name, method_name, NULL::INT AS dependency_count, md5('Class: ' || class_name || chr(10) || 'Method: ' || method_name || chr(10) || chr(10) || method_definition) AS content_md5 FROM turns
        UNION ALL SELECT 'code_mapper', class_name, method_name, CASE WHEN ord = 0 THEN 0 ELSE 2 END, md5('Class: ' || class_name || chr(10) || 'Method: ' || method_name || chr(10) || 'Dependencies: ' || CASE WHEN ord = 0 THEN 'None' ELSE 'a.b, c.d' END) FROM turns""",
    "index_counts": "SELECT 'document' AS type, count(*) AS n, 0::BIGINT AS n_role FROM documents UNION ALL SELECT 'turn', count(*), count(role) FROM conversations",
    "dependency_context": f"""WITH {_TURNS}, f AS (SELECT method_name, class_name, method_definition FROM turns QUALIFY row_number() OVER (PARTITION BY method_name ORDER BY class_name) = 1)
        SELECT t.class_name, t.method_name AS method, md5(CASE WHEN t.ord = 0 THEN 'No internal dependencies identified.' ELSE '**svc.' || (t.ord - 1) || CASE WHEN f.method_name IS NULL THEN '**: No additional context available.' ELSE '**:' || chr(10) || 'Class: ' || f.class_name || chr(10) || 'Method: ' || f.method_name || chr(10) || chr(10) || f.method_definition END || chr(10) || chr(10) || '**x.nothing**: No additional context available.' || chr(10) END) AS context_md5
        FROM turns t LEFT JOIN f ON f.method_name = (t.ord - 1)::VARCHAR""",
    "method_details": f"WITH {_TURNS} SELECT class_name, method_name AS method, CASE WHEN ord = 0 THEN 0 ELSE 2 END AS n_dependencies, method_type, method_definition FROM turns WHERE is_api_route",
    "flag_merge": "SELECT source AS class_name, d.doc_id::VARCHAR AS method, coalesce(l.quality = 1, false) AS is_api_route FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)",
    "api_route_filter": "SELECT event_type AS class_name, event_id AS method, 0 AS n_dependencies FROM events WHERE event_type = 'view'",
    "openapi_paths": f"""WITH {_ENDPOINTS}, g AS (SELECT path, lower(method) AS verb, arg_max(description, ord) AS d, min(ord) AS ord FROM ep GROUP BY 1, 2), x AS (SELECT *, verb AS method FROM g), a AS (SELECT path, verb, ord, d, list_filter([{_ALERT}], lambda z: z IS NOT NULL) AS l FROM x)
        SELECT path, verb, ord, upper(verb) || ' ' || path AS summary, d || CASE WHEN len(l) > 0 THEN chr(10) || chr(10) || array_to_string(list_transform(l, lambda z: 'WARNING: ' || z), chr(10)) ELSE '' END AS description, {_TAG} AS tag FROM a""",
    "postman_items": f"WITH {_ENDPOINTS} SELECT ord, path AS name, upper(method) AS method, '{{{{base_url}}}}' || path AS raw, replace({_TRIM % 'path'}, '/', '|') AS segments FROM ep",
    "examples_map": f"""WITH {_ENDPOINTS} SELECT translate(lower(method) || '_' || replace({_TRIM % 'path'}, '/', '_'), '{{}}', '') AS key, '{{}}' AS request, '{{"page_id":' || max(ord) || '}}' AS response, min(ord) AS ord FROM ep GROUP BY 1""",
    "fallback_documentation": f"WITH p AS (SELECT page_id, {_PATH} AS mp FROM pages) SELECT page_id, '{{{{baseUrl}}}}' || CASE WHEN mp = '' THEN '/api/' ELSE '/api/' || regexp_replace(mp, '^/+', '') END AS url, CASE WHEN page_id % 2 = 0 THEN 'Get' ELSE 'GET' END AS verb, 'm' || page_id AS summary FROM p",
}

_OPERATION = """'{"summary":' || to_json(summary) || ',"description":' || to_json(description) || ',"tags":[' || to_json(tag) || '],"responses":{"200":{"description":"Successful response"}}}'"""
_ITEM = """'{"name":' || to_json(name) || ',"request":{"method":' || to_json(method) || ',"url":{"raw":' || to_json(raw) || ',"host":["{{base_url}}"],"path":' || to_json(string_split(segments, '|')) || '}}}'"""
#: Whole documents, of the rows of other queries.
ORACLES |= {
    "class_filter": "SELECT doc_id::VARCHAR AS method_name, md5(text) AS text_md5 FROM documents WHERE source = 'src0'",
    "docs_prompt": f"""WITH {_TURNS} SELECT class_name, ord, md5('Document this endpoint as JSON with the keys postman and swagger.' || chr(10) || 'Class: ' || class_name || chr(10) || 'Method: ' || CASE WHEN ord > 0 THEN method_name ELSE 'unknown' END || chr(10) || 'Verb: ' || method_type || chr(10) || 'Path: / /' || chr(10) || 'Code:' || chr(10) || method_definition || chr(10) || 'Uses:' || chr(10) || 'None.') AS prompt_md5 FROM turns""",
    "rag_prompt": f"""WITH best AS ({ORACLES["rerank_topk"]}), body AS (SELECT query, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) AS body FROM best JOIN documents ON documents.doc_id = best.doc_id GROUP BY query)
        SELECT item_id AS query, md5('Answer from these sources.' || chr(10) || chr(10) || coalesce(body, '') || chr(10) || chr(10) || 'Question: ' || coalesce(text, '')) AS prompt_md5 FROM benchmark LEFT JOIN body ON query = item_id WHERE item_id % 50 = 0""",
    "openapi_document": f"""WITH o AS ({ORACLES["openapi_paths"]}), p AS (SELECT path, min(ord) AS ord, string_agg(to_json(verb) || ':' || {_OPERATION}, ',' ORDER BY ord) AS verbs FROM o GROUP BY path)
        SELECT '{{"openapi":"3.0.0","info":{{"title":"Generated API","version":"1.0.0","description":"Automatically generated documentation.\\n"}},"paths":{{' || coalesce(string_agg(to_json(path) || ':{{' || verbs || '}}', ',' ORDER BY ord), '') || '}}}}' AS json FROM p""",
    "postman_document": f"""WITH i AS ({ORACLES["postman_items"]}) SELECT '{{"info":{{"name":"Generated Collection","schema":"{D.SCHEMA_URL}"}},"item":[' || coalesce(string_agg({_ITEM}, ',' ORDER BY ord), '') || ']}}' AS json FROM i""",
    "examples_ts": f"""WITH e AS ({ORACLES["examples_map"]}) SELECT '/** Auto-generated API Examples */' || chr(10) || chr(10) || 'export const apiExamples = {{' || chr(10) || coalesce(string_agg('  ' || to_json(key) || ': {{"request": ' || request || ', "response": ' || response || '}}', ',' || chr(10) ORDER BY ord), '') || chr(10) || '}};' || chr(10) AS text FROM e""",
}
ORACLES |= code_queries.ORACLES
