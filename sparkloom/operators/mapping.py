"""Dependencies of methods: a call graph in place of a language model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strict import generate_json
from ..runtime import stored
from .shape import last_wins

#: Receivers that stand for the object itself; an empty one too.
OWN = ["this", "self", ""]


def call_graph(facts: DataFrame, methods: DataFrame, project: list[str] | None = None, inherited: int = 2) -> DataFrame:
    """Calls that reach a method of the project: path, class_name, method_name, pos, receiver, name, to_class.

    facts: of ``extract.facts``. A receiver is looked up in the scope of its method,
    then in that of its class, and gives the class of its declared type; one that
    has none may be a class's name, or else be named like a class (upper case and
    underscores aside). A method that the class does not have is looked for in its
    parents, ``inherited`` steps up. project: columns that bound all lookups.
    """
    keys = project or []
    at = [*keys, "path", "class_name"]
    # both are read several times below: sources are parsed once for each
    facts = stored(facts.select(*at, "method_name", "kind", "name", "value", "pos"), "facts")
    methods = stored(methods.select(*at, "method_name").distinct(), "methods")
    calls = facts.where("kind = 'call'").select(*at, "method_name", F.col("name").alias("receiver"), F.col("value").alias("name"), "pos")
    calls = calls.join(methods, [*at, "method_name"], "left_semi")
    types = facts.where("kind = 'type'")
    inner = types.where("method_name IS NOT NULL").groupBy(*at, "method_name", F.col("name").alias("receiver")).agg(F.min("value").alias("_inner"))
    outer = types.where("method_name IS NULL").groupBy(*at, F.col("name").alias("receiver")).agg(F.min("value").alias("_outer"))
    d = calls.join(inner, [*at, "method_name", "receiver"], "left").join(outer, [*at, "receiver"], "left")
    own = F.when(F.col("receiver").isin(*OWN), F.col("class_name"))
    d = d.withColumn("_typed", F.coalesce(own, "_inner", "_outer"))
    has = methods.select(*keys, F.col("class_name").alias("_c"), F.col("method_name").alias("name")).distinct()
    has = has.withColumn("to_class", F.col("_c"))
    up = facts.where("kind = 'parent'").select(*keys, F.col("class_name").alias("_child"), F.col("name").alias("_c")).distinct()
    for _ in range(inherited):
        more = has.join(up, [*keys, "_c"]).select(*keys, F.col("_child").alias("_c"), "name", "to_class")
        has = stored(has.union(more.join(has, [*keys, "_c", "name"], "left_anti").groupBy(*keys, "_c", "name").agg(F.min("to_class").alias("to_class"))), "has")
    plain = lambda c: F.lower(F.translate(c, "_", ""))
    typed = d.where("_typed IS NOT NULL").withColumnRenamed("_typed", "_c").join(has, [*keys, "_c", "name"])
    loose = has.groupBy(*keys, plain(F.col("_c")).alias("_p"), "name").agg(F.min("to_class").alias("to_class"))
    named = d.where("_typed IS NULL").withColumn("_p", plain(F.col("receiver"))).join(loose, [*keys, "_p", "name"])
    out = [*at, "method_name", "pos", "receiver", "name", "to_class"]
    return typed.select(*out).union(named.select(*out))


def reaches(graph: DataFrame, project: list[str] | None = None, rounds: int | None = None) -> DataFrame:
    """class_name, method_name, to_class, to_method, steps: what each method calls, at once or
    by others, with the least number of calls between. Pairs are met once, so cycles end."""
    keys = project or []
    edges = stored(graph.select(*keys, "class_name", "method_name", "to_class", F.col("name").alias("to_method")).distinct(), "edges")
    step = edges.select(*keys, F.col("class_name").alias("to_class"), F.col("method_name").alias("to_method"), F.col("to_class").alias("_c"), F.col("to_method").alias("_m"))
    met = edges.withColumn("steps", F.lit(1))
    new, n = met, 1
    while rounds is None or n < rounds:
        n += 1
        far = new.join(step, [*keys, "to_class", "to_method"]).select(*keys, "class_name", "method_name", F.col("_c").alias("to_class"), F.col("_m").alias("to_method")).distinct()
        new = stored(far.join(met, [*keys, "class_name", "method_name", "to_class", "to_method"], "left_anti").withColumn("steps", F.lit(n)), "reach")
        if new.isEmpty():
            break
        met = met.union(new)
    return met


def dependencies(methods: DataFrame, project: list[str] | None = None, facts: DataFrame | None = None) -> DataFrame:
    """path, class_name, method, dependencies in order of appearance, is_api_route.

    With facts, calls are those of the sources' syntax, by the call graph. Without,
    a call receiver.name in the text counts when the project has a class named like
    the receiver (upper case and underscores aside) with such a method; self.name and
    this.name count as the own class's. project: columns that bound the lookup.
    """
    keys = project or []
    if facts is not None:
        on = [*keys, "path", "class_name", "method_name"]
        said = F.concat(F.when(F.col("receiver") == "", F.lit("this")).otherwise(F.col("receiver")), F.lit("."), "name")
        hit = call_graph(facts, methods, project).groupBy(*on, said.alias("call")).agg(F.min("pos").alias("pos"))
        deps = hit.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "call"))), lambda x: x["call"]).alias("dependencies"))
        m = methods.select(*on, F.coalesce("is_api_route", F.lit(False)).alias("is_api_route")).join(deps, on, "left")
        return m.select(*keys, "path", "class_name", F.col("method_name").alias("method"), F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"), "is_api_route")
    m = methods.select(*keys, "path", "class_name", "method_name", "is_api_route", "method_definition").withColumn("_row", F.xxhash64("path", "class_name", "method_name", "method_definition"))
    calls = m.select(*keys, "_row", "class_name", F.posexplode(F.regexp_extract_all("method_definition", F.lit(r"(?:\b(?:this|self)\s*\.\s*)?(\b\w+\s*\.\s*\w+)\s*\("), F.lit(1))).alias("pos", "call"))
    calls = calls.withColumn("call", F.regexp_replace("call", r"\s+", "")).withColumn("_recv", F.substring_index("call", ".", 1)).withColumn("_name", F.substring_index("call", ".", -1))
    own = F.col("_recv").isin("self", "this")
    calls = calls.withColumn("_class", F.lower(F.translate(F.when(own, F.col("class_name")).otherwise(F.col("_recv")), "_", "")))
    known = methods.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lower("class_name").alias("_c"), F.col("method_name").alias("_m")).distinct()
    on = (F.col("_class") == F.col("_c")) & (F.col("_name") == F.col("_m"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    hit = calls.join(known, on, "left_semi").groupBy("_row", "call").agg(F.min("pos").alias("pos"))
    deps = hit.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "call"))), lambda x: x["call"]).alias("dependencies"))
    out = m.join(deps, "_row", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))
    return out.select(*keys, "path", "class_name", F.col("method_name").alias("method"), "dependencies", F.coalesce("is_api_route", F.lit(False)).alias("is_api_route"))


def with_flags(mapped: DataFrame, methods: DataFrame) -> DataFrame:
    """mapped(class_name, method) with is_api_route of the last such method, false where there is none."""
    flags = methods.groupBy("class_name", F.col("method_name").alias("method")).agg(F.max_by("is_api_route", "ord").alias("is_api_route"))
    return mapped.drop("is_api_route").join(flags, ["class_name", "method"], "left").withColumn("is_api_route", F.coalesce("is_api_route", F.lit(False)))


def by_class(mapped: DataFrame, last: str = "path") -> DataFrame:
    """One row a class name: the methods of the last file that has it."""
    item = F.struct("method", "dependencies", "is_api_route")
    d = mapped.groupBy("class_name", last).agg(F.array_sort(F.collect_list(item)).alias("methods"))
    return last_wins(d, ["class_name"], last).select("class_name", "methods")


def mapped_json(classes: DataFrame) -> DataFrame:
    """One row: the mapped classes as a JSON object by class name. A report of one project."""
    entry = F.struct("class_name", F.struct("methods").alias("v"))
    return classes.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["class_name"] < b["class_name"], -1).otherwise(1)))).alias("json"))


def prompt(classes: DataFrame) -> DataFrame:
    """classes(class_name, methods) with the prompt that asks a model for its calls."""
    code = F.to_json(F.transform("methods", lambda m: m["method_definition"]))
    task = 'List for each method the calls to other classes of this project, as JSON: {"methods": [{"method": name, "dependencies": ["receiver.name"]}]}. Leave out library calls.\n'
    return classes.withColumn("prompt", F.concat(F.lit(f"{task}Class: "), F.coalesce("class_name", F.lit("Unknown")), F.lit("\nMethods: "), code))


def _has_methods(value: object) -> bool:
    return isinstance(value, dict) and isinstance(value.get("methods"), list)


def by_model(classes: DataFrame, generate: Callable[[str], str], retries: int = 2) -> DataFrame:
    """class_name, method, dependencies and is_api_route as a model maps them; classes it has no valid answer for are left out."""
    made = generate_json(prompt(classes), "prompt", "_made", generate, retries=retries, accept=_has_methods)
    reply = F.from_json("_made", "methods array<struct<method: string, dependencies: array<string>>>")["methods"]
    d = made.select("class_name", F.explode(reply).alias("_m")).select("class_name", "_m.method", F.coalesce("_m.dependencies", F.array().cast("array<string>")).alias("dependencies"))
    flat = classes.select("class_name", F.posexplode("methods").alias("ord", "_m")).select("class_name", F.col("_m.method_name").alias("method_name"), F.col("_m.is_api_route").alias("is_api_route"), "ord")
    return with_flags(d, flat)
