"""Queries over source text that is built from the conversations table: a class a
conversation (and 50 turns), a method a turn, in each of the four languages.

A template is filled by Spark for the sources and by SQL for the rows that
extraction has to give. ``<<text>>`` is the turn's whole text as a JSON string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import mapping
from .operators.extract import extract, outline, register

#: Turns a class, and conversations whose classes call each other in a ring.
TURNS, RING = 50, 4
ASKED, SAID = "asked", "said"
#: head, the method of a turn that a user asks, that of any other turn, tail.
SOURCES = {
    "java": {
        "head": 'package talk; import java.util.List;\n// class Wrong { public void no() {} }\n@RestController @RequestMapping(path = {"/talks/<<conv>>", "/t"}, produces = "json")\npublic class <<class>> extends Base<Map<String, List<Integer>>> implements Talk {\n  private final <<next>> next; private char mark = \'}\';\n  static { System.out.println("} class X {"); }\n  public <<class>>(<<next>> next) { this.next = next; }\n  public static class Inner { public void hidden() { next.none(); } }\n',
        ASKED: '@GetMapping(value = "/turns/<<turn>>", name = "{n}") @Deprecated\n  public <K extends Comparable<K>> Map<String, List<K>> turn<<turn>>(@PathVariable("id") String id, int[] more) throws Gone {\n    /* } next.turn0() */ char q = \'"\'; String said = <<text>>;\n    return next.turn<<after>>(said, """\n      } "raw" {\n      """);\n  }',
        SAID: '@Cached(ttl = 3)\n  protected String turn<<turn>>(String id) { Runnable r = () -> { turn<<before>>(id); }; String said = <<text>>; return said; }',
        "tail": "  abstract void none();\n  String plain() { return turn0(); }\n}\n",
    },
    "cs": {
        "head": "using System;\nnamespace Talks<<scope>>\n[ApiController, Route(template: \"api/talks/<<conv>>\")]\npublic partial class <<class>><T> : ControllerBase where T : new()\n{\n  private readonly <<next>><T> _next = null; char mark = '}';\n  public string Name { get; set; } = \"} class X {\";\n  public int Size => 3;\n  public <<class>>(<<next>><T> next) { _next = next; }\n  class Inner { public void Hidden() { _next.None(); } }\n",
        ASKED: '[Authorize(Roles = "a,b")][HttpGet("turns/<<turn>>")]\n  public async Task<List<Dictionary<string, T>>> turn<<turn>><K>([FromRoute] int id) where K : class\n  {\n    var s = $"{{}} {names["}"]} {(id > 2 ? "}" : "{")}" + @"c:\\" + <<text>>; // } _next.turn0()\n    return await _next.turn<<after>>(s);\n  }',
        SAID: "public (int a, string b) turn<<turn>>(string id) => (turn<<before>>(id), <<text>>);",
        "tail": "  public static <<class>><T> operator +(<<class>><T> a, int b) { return a; }\n  ~<<class>>() { }\n}\n<<close>>",
    },
    "ts": {
        "head": "import { Get } from '@talks/common'\nclass Hidden { none() { return 1 } }\n@Controller({ path: 'talks/<<conv>>', version: '1' })\nexport default class <<class>><T extends Map<string, T>> extends Base<T> implements Talk {\n  private static readonly mark = /[}]\\/\"`/g\n  text = `} ${ { a: `}${1}` }.a } {`\n  constructor(private readonly next: <<next>><T>, @Inject('q') private q: Queue<string>) { super() }\n",
        ASKED: "@UseGuards(Guard, { a: '}' }) @Get('turns/<<turn>>')\n  turn<<turn>><K extends keyof T>(id: string): Promise<{ a: K }> { if (/[}\"]/.test(id)) return this.next.turn<<after>>(<<text>>)\n    return this.next.turn<<after>>(`${id}}`) /* } this.next.turn0() */ }",
        SAID: "turn<<turn>> = async (id: string, more = { a: 1 }): Promise<string> => { this.turn<<before>>(`}`); return <<text>> }",
        "tail": "}\n",
    },
    "py": {
        "head": "from talks import <<next>>\n\nclass <<class>>(View):\n    '''def no(self): pass'''\n    def __init__(self, next: <<next>>):\n        self.next = next\n\n    @property\n    def hidden(self):\n        return self.next.none()\n\n",
        ASKED: "def turn<<turn>>(self, id):\n        said = <<text>>  # self.next.turn0()\n        return self.next.turn<<after>>(said)",
        SAID: "async def turn<<turn>>(self, id, more={'a': '}'}):\n        self.turn<<before>>(id)\n        return <<text>>",
        "tail": "def helper(self):\n    return 0\n",
    },
}
FOLDERS = {"java": "java", "cs": "cs", "ts": "ts", "py": "py"}
#: What stands before a method and behind it.
AROUND = {"java": ("  ", "\n"), "cs": ("  ", "\n"), "ts": ("  ", "\n"), "py": ("    ", "\n\n")}


def filled(template: str, **values: Column) -> Column:
    parts = re.split(r"<<(\w+)>>", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def filled_sql(template: str, **values: str) -> str:
    parts = re.split(r"<<(\w+)>>", template)
    quote = lambda s: " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in s.split("\n"))
    return " || ".join(values[p] if i % 2 else quote(p) for i, p in enumerate(parts))


def sources(spark: SparkSession, sf: str, *langs: str) -> DataFrame:
    """path and content of the source files."""
    d = spark.read.parquet(f"{sf}/conversations.parquet")
    part = F.floor(F.col("turn") / TURNS)
    name = lambda c: F.concat(F.lit("Talk"), c.cast("string"), F.lit("x"), part.cast("string"))
    after = F.col("conv_id") - F.col("conv_id") % RING + (F.col("conv_id") + 1) % RING
    said = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    # turns are put together once for all languages
    g = d.groupBy(F.col("conv_id"), part.alias("part"), name(F.col("conv_id")).alias("class"), name(after).alias("next")).agg(F.collect_list(F.struct("turn", "role", said.alias("said"))).alias("turns"))
    block = F.col("conv_id") % 2 == 0
    parts = {"conv": F.col("conv_id").cast("string"), "class": F.col("class"), "next": F.col("next"), "scope": F.when(block, " {").otherwise(";"), "close": F.when(block, "}\n").otherwise("")}

    def method(lang: str, x: Column) -> Column:
        number = lambda n: (x["turn"] + n).cast("string")
        t, values = SOURCES[lang], {"turn": number(0), "after": number(1), "before": number(-1), "text": x["said"]}
        code = F.when(x["role"] == "user", filled(t[ASKED], **values)).otherwise(filled(t[SAID], **values))
        return F.struct(x["turn"].alias("turn"), F.concat(F.lit(AROUND[lang][0]), code, F.lit(AROUND[lang][1])).alias("code"))

    def file(lang: str) -> Column:
        methods = F.array_sort(F.transform("turns", lambda x: method(lang, x)))
        body = F.array_join(F.transform(methods, lambda x: x["code"]), "")
        return F.struct(F.concat(F.lit(f"{FOLDERS[lang]}/"), "class", F.lit(f".{lang}")).alias("path"), F.concat(filled(SOURCES[lang]["head"], **parts), body, filled(SOURCES[lang]["tail"], **parts)).alias("content"))

    return g.select(F.inline(F.array(*[file(lang) for lang in langs or SOURCES])))


def _extracted(lang: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return extract(sources(spark, sf, lang)).select("path", "class_name", "class_type", "base_path", "ord", "method_name", "method_type", "is_api_route", "method_path", F.md5("method_definition").alias("definition_md5"))

    return query


def lateral_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The same by SQL: methods a class, and the calls in its methods."""
    register(spark)
    sources(spark, sf, "java", "ts").selectExpr("path", "CASE WHEN path LIKE 'ts/%' THEN 'typescript' ELSE 'java' END AS lang", "content").createOrReplaceTempView("talk_sources")
    return spark.sql("""SELECT path, m.class_name, count(*) AS n_methods, count_if(m.is_api_route) AS n_routes
        FROM talk_sources, LATERAL extract_methods(lang, content) m GROUP BY path, m.class_name""")


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    facts, methods = outline(sources(spark, sf))
    lang = F.substring_index("path", "/", 1).alias("lang")
    return mapping.call_graph(facts.select("*", lang), methods.select("*", lang), ["lang"])


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).groupBy("lang", "class_name", "method_name", "to_class", F.col("name").alias("to_method")).agg(F.count(F.lit(1)).alias("n_calls"))


def call_reach(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.reaches(_graph(spark, sf), ["lang"]).select("lang", "class_name", "method_name", "to_class", "to_method", "steps")


def _dependencies(spark: SparkSession, sf: str) -> DataFrame:
    facts, methods = outline(sources(spark, sf))
    return mapping.dependencies(methods, facts=facts)


def map_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    d = _dependencies(spark, sf)
    return d.select("path", "class_name", "method", F.array_join("dependencies", ",").alias("dependencies"), "is_api_route")


def mapped_document(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.mapped_json(mapping.by_class(_dependencies(spark, sf)))


QUERIES = {f"extract_{name}": _extracted(lang) for name, lang in (("python", "py"), ("java", "java"), ("csharp", "cs"), ("typescript", "ts"))}
QUERIES |= {f.__name__: f for f in (lateral_extract, call_edges, call_reach, map_dependencies, mapped_document)}

_TALKS = f"""talks AS (
    SELECT *, 'Talk' || conv_id || 'x' || turn // {TURNS} AS class_name, 'Talk' || (conv_id - conv_id % {RING} + (conv_id + 1) % {RING}) || 'x' || turn // {TURNS} AS next,
        turn::VARCHAR AS t, (turn + 1)::VARCHAR AS a, (turn - 1)::VARCHAR AS b, coalesce(to_json(text)::VARCHAR, 'null') AS said, coalesce(role = 'user', false) AS asked
    FROM conversations)"""
_SQL_VALUES = {"turn": "t", "after": "a", "before": "b", "text": "said"}
#: class_type, base_path, methods before the turns, then of turns asked and of others: type, path.
_FACTS = {
    "java": ("RestController", "'/talks/' || conv_id", 0, ("'Get'", "'/turns/' || t"), ("NULL", "''")),
    "cs": ("Controller", "'api/talks/' || conv_id", 0, ("'Get'", "'turns/' || t"), ("NULL", "''")),
    "ts": ("Controller", "'talks/' || conv_id", 1, ("'Get'", "'turns/' || t"), ("NULL", "NULL")),
    "py": ("Controller", "''", 1, ("NULL", "NULL"), ("NULL", "NULL")),
}


def _extract_sql(lang: str) -> str:
    kind, base, first, asked, other = _FACTS[lang]
    text = SOURCES[lang][ASKED].split("\n  ", 1)[1] if lang == "ts" else SOURCES[lang][ASKED]  # decorators aren't part of it there
    code = f"CASE WHEN asked THEN {filled_sql(text, **_SQL_VALUES)} ELSE {filled_sql(SOURCES[lang][SAID], **_SQL_VALUES)} END"
    head = f"'{FOLDERS[lang]}/' || class_name || '.{lang}' AS path, class_name, '{kind}' AS class_type, {base} AS base_path"
    one = f"SELECT {head}, ({first} + row_number() OVER (PARTITION BY class_name ORDER BY turn) - 1)::INT AS ord, 'turn' || t AS method_name, CASE WHEN asked THEN {asked[0]} ELSE {other[0]} END::VARCHAR AS method_type, asked AND {lang != 'py'} AS is_api_route, CASE WHEN asked THEN {asked[1]} ELSE {other[1]} END::VARCHAR AS method_path, md5({code}) AS definition_md5 FROM talks"
    made = {"ts": ("constructor", "'constructor(private readonly next: ' || next || '<T>, @Inject(''q'') private q: Queue<string>) { super() }'"), "py": ("__init__", "'def __init__(self, next: ' || next || '):' || chr(10) || '        self.next = next'")}.get(lang)
    more = f" UNION ALL SELECT DISTINCT {head}, 0, '{made[0]}', NULL, false, NULL, md5({made[1]}) FROM talks" if made else ""
    return f"WITH {_TALKS} {one}{more}"


_LANGS = ", ".join(f"('{FOLDERS[x]}')" for x in SOURCES)
#: A turn that was asked calls the next turn of the next conversation of its ring (twice in TypeScript), another one the turn before.
_EDGES = f"""{_TALKS}, calls AS (SELECT class_name, 'turn' || t AS method_name, CASE WHEN asked THEN next ELSE class_name END AS to_class, 'turn' || CASE WHEN asked THEN a ELSE b END AS to_method, asked FROM talks),
    known AS (SELECT class_name AS to_class, 'turn' || t AS to_method FROM talks), edges AS (SELECT lang, c.* FROM calls c JOIN known USING (to_class, to_method), (VALUES {_LANGS}) l(lang))"""
_CALLS = "CASE WHEN asked THEN CASE lang WHEN 'py' THEN 'next.' WHEN 'java' THEN 'next.' WHEN 'ts' THEN 'next.' ELSE '_next.' END ELSE CASE lang WHEN 'py' THEN 'self.' ELSE 'this.' END END || to_method"
_MAPPED = f"""WITH {_EDGES}, called AS (SELECT lang, class_name, method_name, {_CALLS} AS call FROM edges),
    mapped AS (SELECT l.lang || '/' || talks.class_name || '.' || l.lang AS path, talks.class_name, 'turn' || t AS method, coalesce(call, '') AS dependencies, asked AND l.lang <> 'py' AS is_api_route
        FROM talks CROSS JOIN (VALUES {_LANGS}) l(lang) LEFT JOIN called ON called.lang = l.lang AND called.class_name = talks.class_name AND method_name = 'turn' || t
        UNION ALL SELECT DISTINCT 'ts/' || class_name || '.ts', class_name, 'constructor', '', false FROM talks UNION ALL SELECT DISTINCT 'py/' || class_name || '.py', class_name, '__init__', '', false FROM talks)"""
_METHOD = """'{"method":' || to_json(method) || ',"dependencies":' || to_json(CASE WHEN dependencies = '' THEN [] ELSE string_split(dependencies, ',') END) || ',"is_api_route":' || is_api_route || '}'"""
ORACLES = {f"extract_{name}": _extract_sql(lang) for name, lang in (("python", "py"), ("java", "java"), ("csharp", "cs"), ("typescript", "ts"))}
ORACLES |= {
    "lateral_extract": f"WITH {_TALKS} SELECT lang || '/' || class_name || '.' || lang AS path, class_name, count(*) + (lang = 'ts')::INT AS n_methods, count(*) FILTER (asked) AS n_routes FROM talks, (VALUES ('java'), ('ts')) l(lang) GROUP BY lang, class_name",
    "call_edges": f"WITH {_EDGES} SELECT lang, class_name, method_name, to_class, to_method, CASE WHEN asked AND lang = 'ts' THEN 2 ELSE 1 END AS n_calls FROM edges",
    "call_reach": f"WITH RECURSIVE {_EDGES}, reach AS (SELECT lang, class_name, method_name, to_class, to_method, 1 AS steps FROM edges UNION SELECT r.lang, r.class_name, r.method_name, e.to_class, e.to_method, steps + 1 FROM reach r JOIN edges e ON e.lang = r.lang AND e.class_name = r.to_class AND e.method_name = r.to_method WHERE steps < 200) SELECT lang, class_name, method_name, to_class, to_method, min(steps)::INT AS steps FROM reach GROUP BY ALL",
    "map_dependencies": f"{_MAPPED} SELECT path, class_name, method, dependencies, is_api_route FROM mapped",
    "mapped_document": f"""{_MAPPED}, c AS (SELECT class_name, string_agg({_METHOD}, ',' ORDER BY method) AS methods FROM mapped WHERE path LIKE 'ts/%' GROUP BY class_name)
        SELECT '{{' || string_agg(to_json(class_name) || ':{{"methods":[' || methods || ']}}', ',' ORDER BY class_name) || '}}' AS json FROM c""",
}
