"""Per-method documentation and the artifacts of a project."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.strict import generate_json, is_documentation
from ..runtime import stored
from ..sources.filesink import write_files
from .shape import first_wins, last_wins

# Wording of documents and artifacts, here and in fallback(), openapi() and examples_ts().
NO_DEPS = "No internal dependencies identified."
SCHEMA_URL = "https://schema.getpostman.com/json/collection/v2.1.0/collection.json"


def api_methods(mapped: DataFrame) -> DataFrame:
    return mapped.where(F.col("is_api_route") == True).select("class_name", "method", F.coalesce("dependencies", T.no_strings()).alias("dependencies"))  # noqa: E712


def with_details(methods: DataFrame, details: DataFrame, order: str = "ord") -> DataFrame:
    """methods(class_name, method) with the last details row of the same class and method name, or nulls."""
    d = last_wins(details, ["class_name", "method_name"], order).withColumnRenamed("method_name", "method")
    return methods.join(d, ["class_name", "method"], "left")


def method_dependencies(mapped: DataFrame, class_name: str, method: str) -> list[str]:
    row = mapped.where((F.col("class_name") == class_name) & (F.col("method") == method)).select("dependencies").first()
    return list(row[0] or []) if row else []


def dependency_context(methods: DataFrame, documents: DataFrame, deps: str = "dependencies") -> DataFrame:
    """methods with the text of each dependency's method, in order, as context.

    All lookups are one join: the first document of each method name, by class
    and file, against the last part of each dependency.
    """
    docs = documents.where(F.col("type") == "ast_method")
    first = first_wins(docs, ["method_name"], ["class_name", "file_name"]).select(F.col("method_name").alias("_m"), F.col("content").alias("_c"))
    # a row stands for itself, as overloads share the keys; written once, its number stays the same
    m = stored(methods.withColumn("_row", F.monotonically_increasing_id()), "methods")
    e = m.select("_row", F.posexplode(deps).alias("_pos", "_dep"))
    e = e.join(first, T.dependency_tail(F.col("_dep")) == F.col("_m"), "left")
    said = F.when(F.col("_c").isNull(), F.concat(F.lit("**"), "_dep", F.lit("**: No additional context available.\n"))).otherwise(F.concat(F.lit("**"), "_dep", F.lit("**:\n"), "_c", F.lit("\n")))
    got = e.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", said.alias("t")))), lambda x: x["t"]), "\n").alias("context"))
    return m.join(got, "_row", "left").withColumn("context", F.coalesce("context", F.lit(NO_DEPS))).drop("_row")


def prompt(context: Column) -> Column:
    c = lambda x, d: F.coalesce(F.col(x), F.lit(d))
    parts = [F.lit("Document this endpoint as JSON with the keys postman and swagger.\nClass: "), c("class_name", "Unknown"), F.lit("\nMethod: "), c("method", "unknown"), F.lit("\nVerb: "), c("method_type", "GET"), F.lit("\nPath: "), c("base_path", "/"), F.lit(" "), c("method_path", "/"), F.lit("\nCode:\n"), c("method_definition", ""), F.lit("\nUses:\n"), context]
    return F.concat(*parts)


def fallback(name: Column, verb: Column, base: Column, path: Column) -> Column:
    """Documentation without a model, as JSON with postman and swagger."""
    url = F.concat(F.lit("{{baseUrl}}"), T.join_path(base, path))
    said = lambda t: F.struct(F.lit(t).alias("description"))
    postman = F.struct(
        name.alias("name"), F.struct(F.coalesce(verb, F.lit("GET")).alias("method"), T.no_strings().alias("header"), F.struct(url.alias("raw")).alias("url")).alias("request"),
        F.format_string("Auto-generated documentation for %s. Manual review recommended.", name).alias("description"),
    )
    swagger = F.struct(
        name.alias("summary"), F.format_string("Endpoint: %s. Documentation could not be fully generated.", name).alias("description"), T.no_strings().alias("parameters"),
        F.struct(said("Success").alias("200"), said("Bad Request").alias("400"), said("Internal Server Error").alias("500")).alias("responses"),
    )
    return F.to_json(F.struct(postman.alias("postman"), swagger.alias("swagger")))


def documentation(methods: DataFrame, generate: Callable[[str], str] | None = None) -> DataFrame:
    """methods with column documentation: the model's JSON where one is given and answers, else the fallback."""
    plain = fallback(F.coalesce("method", F.lit("unknown")), F.col("method_type"), F.coalesce("base_path", F.lit("/")), F.coalesce("method_path", F.lit("")))
    if generate is None:
        return methods.withColumn("documentation", plain)
    d = generate_json(methods.withColumn("prompt", prompt(F.col("context"))), "prompt", "_made", generate, accept=is_documentation)
    return d.withColumn("documentation", F.coalesce("_made", plain)).drop("_made", "prompt")


def save_documentation(docs: DataFrame, folder: str, by: tuple[str, ...] = ("class_name", "method"), order: str | None = None) -> DataFrame:
    """Write postman.json and swagger.json of every method into a folder of its own,
    named by the keys; returns counts. Of rows with the same folder the last by
    ``order`` is written, or else by the text. Files appear when all are written."""
    safe = F.concat_ws("/", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("unknown")), r"[^\w.-]|^\.+$", "_") for c in by])
    last = docs.groupBy(safe.alias("_folder")).agg(F.max_by("documentation", F.struct(*([order] if order else []), "documentation")).alias("_d"))
    part = F.explode(F.array(F.lit("postman"), F.lit("swagger"))).alias("_part")
    value = F.when(F.col("_part") == "postman", F.get_json_object("_d", "$.postman")).otherwise(F.get_json_object("_d", "$.swagger"))
    files = last.select("_folder", "_d", part).select(F.concat("_folder", F.lit("/"), "_part", F.lit(".json")).alias("name"), F.coalesce(value, F.lit("{}")).alias("text"))
    write_files(files, folder, indent=2)
    return docs.agg(F.count(F.lit(1)).alias("methods_processed"), F.count_distinct(safe).alias("output_files"))


def class_files(methods: DataFrame) -> DataFrame:
    """name and text: the classes of each source file as JSON, classes and methods in the order of the source."""
    item = F.struct("ord", F.struct("method_name", "method_type", "is_api_route", "method_path", "method_definition").alias("m"))
    one = methods.groupBy("path", "class_ord", "class_name", "class_type", "base_path").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("methods"))
    entry = F.struct("class_ord", F.struct("class_name", "class_type", "base_path", "methods").alias("c"))
    files = one.groupBy("path").agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["c"]), {"ignoreNullFields": "false"}).alias("text"))
    return files.select(F.concat(F.regexp_replace(F.regexp_replace("path", "^/+|/+$", ""), r"[^\w.-]", "_"), F.lit(".json")).alias("name"), "text")


def save_classes(methods: DataFrame, folder: str) -> None:
    """Write the classes extracted from each source file as <path>.json, an array of
    classes with their methods; separators of the path become underscores, so that
    equal names in different folders stay apart. Files appear when all are written."""
    write_files(class_files(methods), folder, indent=2)


# ---- artifacts -------------------------------------------------------------


def openapi_operations(endpoints: DataFrame, order: str = "ord") -> DataFrame:
    """path, verb and operation; the last of equal (path, verb), the place of the first."""
    path, verb = F.coalesce("path", F.lit("/")), F.lower(F.coalesce("method", F.lit("get")))
    alerts = T.endpoint_alerts(path, verb)
    op = F.struct(
        F.concat(F.upper(verb), F.lit(" "), path).alias("summary"), T.described(F.coalesce("description", F.lit("")), alerts).alias("description"),
        F.array(T.tag(path)).alias("tags"), F.struct(F.struct(F.lit("Successful response").alias("description")).alias("200")).alias("responses"),
    )
    d = endpoints.select(path.alias("path"), verb.alias("verb"), op.alias("operation"), F.col(order).alias("ord"))
    return d.groupBy("path", "verb").agg(F.max_by("operation", "ord").alias("operation"), F.min("ord").alias("ord"))


def openapi(endpoints: DataFrame, title: str = "Generated API", alerts: list[str] = (), order: str = "ord") -> DataFrame:
    """One row: the OpenAPI document of a project as JSON."""
    ops = openapi_operations(endpoints, order)
    in_order = lambda e: F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord"), e.alias("e")))), lambda x: x["e"])
    paths = ops.groupBy("path").agg(F.map_from_entries(in_order(F.struct(F.col("verb"), F.col("operation")))).alias("verbs"), F.min("ord").alias("ord"))
    info = F.struct(F.lit(title).alias("title"), F.lit("1.0.0").alias("version"), F.lit("Automatically generated documentation.\n" + "\n".join(alerts)).alias("description"))
    pairs = in_order(F.struct(F.col("path"), F.to_json("verbs").alias("verbs")))
    item = lambda p: F.concat(F.regexp_replace(F.to_json(F.array(p["path"])), r"^\[|\]$", ""), F.lit(":"), p["verbs"])
    return paths.agg(F.concat(F.lit('{"openapi":"3.0.0","info":'), F.to_json(info), F.lit(',"paths":{'), F.array_join(F.transform(pairs, item), ","), F.lit("}}")).alias("json"))


def postman_items(endpoints: DataFrame) -> DataFrame:
    """endpoints with item: name and request, one a row, nothing folded."""
    path = F.coalesce("path", F.lit("/"))
    url = F.struct(F.concat(F.lit("{{base_url}}"), path).alias("raw"), F.array(F.lit("{{base_url}}")).alias("host"), T.segments(path).alias("path"))
    req = F.struct(F.upper(F.coalesce("method", F.lit("GET"))).alias("method"), url.alias("url"))
    return endpoints.withColumn("item", F.struct(path.alias("name"), req.alias("request")))


def postman(endpoints: DataFrame, order: str = "ord") -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("item").alias("i")))), lambda x: x["i"])
    info = F.struct(F.lit("Generated Collection").alias("name"), F.lit(SCHEMA_URL).alias("schema"))
    return postman_items(endpoints).agg(F.to_json(F.struct(info.alias("info"), items.alias("item"))).alias("json"))


def examples(endpoints: DataFrame, order: str = "ord") -> DataFrame:
    """key, request and response; the last of equal keys."""
    key = T.example_key(F.coalesce("method", F.lit("get")), F.coalesce("path", F.lit("")))
    d = endpoints.select(key.alias("key"), F.coalesce("example_request", F.lit("{}")).alias("request"), F.coalesce("example_response", F.lit("{}")).alias("response"), F.col(order).alias("ord"))
    return d.groupBy("key").agg(F.max_by(F.struct("request", "response"), "ord").alias("_e"), F.min("ord").alias("ord")).select("key", "_e.*", "ord")


def examples_ts(endpoints: DataFrame, order: str = "ord") -> DataFrame:
    """One row: a TypeScript constant with all examples."""
    quoted = F.regexp_replace(F.to_json(F.array("key")), r"^\[|\]$", "")
    line = F.concat(F.lit("  "), quoted, F.lit(': {"request": '), "request", F.lit(', "response": '), "response", F.lit("}"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), ",\n")
    return examples(endpoints, order).agg(F.concat(F.lit("/** Auto-generated API Examples */\n\nexport const apiExamples = {\n"), body, F.lit("\n};\n")).alias("text"))


def generate_artifacts(endpoints: DataFrame, base: str, title: str = "Generated API", alerts: list[str] = ()) -> dict[str, str]:
    """Write the three artifacts of a project into a folder named by the time; paths by kind."""
    folder = os.path.join(base, time.strftime("%Y%m%d-%H%M%S"))
    made = {"swagger": ("swagger.json", openapi(endpoints, title, list(alerts))), "postman": ("postman_collection.json", postman(endpoints)), "examples": ("examples.ts", examples_ts(endpoints))}
    named = [df.toDF("text").withColumn("name", F.lit(name)) for name, df in made.values()]
    write_files(named[0].unionByName(named[1]), folder, indent=2)
    write_files(named[2], folder)
    return {kind: os.path.join(folder, name) for kind, (name, _) in made.items()}
