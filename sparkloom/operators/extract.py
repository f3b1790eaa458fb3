"""Class and method rows from Python, Java, C# and TypeScript sources.

A row is a method: class_ord, class_name, class_type, base_path, ord,
method_name, method_type, is_api_route, method_path, method_definition; a class
without methods gives no row. ``extract`` runs over a table of files; each file
is parsed on its own, and one that can't be parsed gives no rows.

Python goes through the standard parser, the other three through the grammar of
``grammar.py``. ``facts`` gives what a call graph needs: types of names, parents
of classes and calls; ``outline`` both of one pass over the sources. ``register`` makes both table functions of SQL, to be used
LATERAL over any table of sources.

Known limits: C# and Java classes count at the top of a file and in namespaces,
also in one that is declared for the whole file; TypeScript classes count where
they are exported. Classes inside classes give rows of their own only with
``nested``; their methods never count as the outer class's.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import language, trim_code
from ..runtime import ship, stored
from .grammar import MODIFIERS, NO_NAMES, Declarations, Klass, Member, Token, walk

SQL = "class_ord int, class_name string, class_type string, base_path string, ord int, method_name string, method_type string, is_api_route boolean, method_path string, method_definition string"
# Verbs, stereotypes and route decorators.
VERBS = ["get", "post", "put", "delete", "patch", "options", "head"]
JAVA_TYPES = ["RestController", "Service", "Controller", "Component"]
TS_ROUTES = ["Get", "Post", "Put", "Delete", "Patch", "Options", "Head", "All", "MessagePattern"]
#: Names of arguments that hold a path.
PATHS, TEMPLATES = ("value", "path"), ("template", "Template")
LANGUAGES = ["java", "typescript", "python", "c_sharp"]
#: Characters of sources whose rows a worker holds at a time.
PIECE = 1_000_000
FACTS = "class_name string, method_name string, kind string, name string, value string, pos long"


def parsed(source: str, lang: str) -> list:
    """What stands at the top of a Python source; the classes of another."""
    return ast.parse(source).body if lang == "python" else Declarations(source, lang).classes()


def python_methods(source: str, body: list) -> Iterator[tuple]:
    raw = source.encode()
    starts = [0]
    for line in raw.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    classes: dict[str, list] = {}
    for node in body:
        if not isinstance(node, ast.ClassDef):
            continue
        methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and not m.decorator_list]
        if not methods:
            continue
        parents = [b.id for b in node.bases if isinstance(b, ast.Name)]
        if "View" in parents or node.name.endswith(("View", "ViewSet")):
            kind = "Controller"
        else:
            kind = "Service" if node.name.endswith("Service") else "Utility"
        entry = classes.setdefault(node.name, [len(classes), kind, {}])
        for m in methods:
            text = raw[starts[m.lineno - 1] + m.col_offset : starts[m.end_lineno - 1] + m.end_col_offset].decode()
            entry[2].setdefault(m.name, text)
    for name, (i, kind, methods) in classes.items():
        for j, (m, text) in enumerate(methods.items()):
            api = m.lower() in VERBS and kind != "Service"
            yield i, name, kind, "", j, m, m.capitalize() if api else None, api, "" if api else None, text


def brace_methods(source: str, lang: str, classes: list[Klass], nested: bool = False) -> Iterator[tuple]:
    seen: dict[str, tuple[int, set]] = {}
    for c in outer(classes, nested):
        if lang == "typescript" and "export" not in c.modifiers and not nested:
            continue
        kind, base = class_facts(lang, c)
        number, known = seen.setdefault(c.name, (len(seen), set()))
        for m in c.members:
            got = method_facts(source, lang, kind, c, m)
            key = m.name if lang != "typescript" else (m.first, m.end)
            if got is None or key in known:
                continue
            yield (number, c.name, kind, base, len(known), m.name, *got)
            known.add(key)


def outer(classes: list[Klass], nested: bool) -> Iterator[Klass]:
    for c in classes:
        yield c
        if nested:
            yield from outer(c.nested, True)


def parents(c: Klass) -> Iterator[str]:
    """Names of the classes and interfaces that a class is made from, without qualifiers and arguments."""
    depth, on = 0, False
    for k, t in enumerate(c.heritage):
        depth += (t.text == "<") - (t.text == ">")
        if t.text == "where":
            return
        on = on or t.text in (":", "extends", "implements") and not depth
        if on and not depth and t.kind == "word" and t.text not in ("extends", "implements") and not (k + 1 < len(c.heritage) and c.heritage[k + 1].text == "."):
            yield t.text


def class_facts(lang: str, c: Klass) -> tuple[str, str]:
    if lang == "java":
        route = next((n for n in c.notes if n.name == "RequestMapping"), None)
        return next((n.name for n in c.notes if n.name in JAVA_TYPES), "Utility"), (route and route.string(PATHS)) or ""
    if lang == "c_sharp":
        parent = next(parents(c), "")
        kind = "Controller" if "Controller" in c.name or "Controller" in parent else "Service" if "Service" in c.name else "Utility"
        return kind, next((x for n in c.notes if (x := n.string(TEMPLATES))), "")
    return (c.notes[0].name, c.notes[0].string(PATHS) or "/") if c.notes else ("Utility", "/")


def method_facts(source: str, lang: str, kind: str, c: Klass, m: Member) -> tuple | None:
    """method_type, is_api_route, method_path and definition, or None for what is no method."""
    if m.kind == "field":
        return None
    if lang == "typescript":
        if "abstract" in m.modifiers or not m.body:
            return None
        route = next((n for n in m.notes if n.name in TS_ROUTES), None)
        return (route.name, True, route.string(PATHS) or "", source[m.start : m.end]) if route else (None, False, None, source[m.start : m.end])
    if not m.type or m.type[-1].text == "~" or m.kind != "method":  # constructors have no type
        return None
    if lang == "java":
        if not m.body or not (m.modifiers or m.notes):
            return None
        route = next((n for n in m.notes if n.name.endswith("Mapping")), None)
        path = next((n.string(PATHS) or "" for n in ([route] if route else m.notes)), None)
        verb = route.name.removesuffix("Mapping") if route else None
        return "All" if verb == "Request" else verb, route is not None, path, source[m.first : m.end]
    verb = next((n for n in m.notes if n.name.startswith("Http") and n.name[4:].lower() in VERBS), None)
    path = (verb.string(TEMPLATES) if verb else next((x for n in m.notes if (x := n.string(TEMPLATES))), None)) or ""
    api = verb is not None and kind != "Service"
    return verb.name[4:].capitalize() if api else None, api, path, source[m.first : m.end]


# ---- what the call graph is made of ------------------------------------------


def type_name(inner: list[Token]) -> str | None:
    """The name of a type: the last part of its first word, arguments and annotations aside."""
    got = None
    for k, t in enumerate(inner):
        if t.kind == "word" and t.text not in MODIFIERS:
            if got is not None and inner[k - 1].text != ".":
                break
            got = t.text
        elif got is not None and t.text != ".":
            break
    return got


def parameters(group: Token | None, lang: str) -> Iterator[tuple[str, str]]:
    """Names and types of declared parameters."""
    part: list[Token] = []
    depth = 0
    for t in [*(group.inner if group else []), Token("mark", ",", 0, 0)]:
        depth += (t.text == "<") - (t.text == ">")
        if t.text != "," or depth > 0:
            part.append(t)
            continue
        words = [k for k, x in enumerate(part) if x.kind == "word" and x.text not in MODIFIERS and (k == 0 or part[k - 1].text != "@")]
        stop = next((k for k, x in enumerate(part) if x.text == "="), len(part))
        words = [k for k in words if k < stop]
        if lang == "typescript":
            colon = next((k for k, x in enumerate(part) if x.text == ":"), None)
            if colon and words and (kind := type_name(part[colon + 1 :])):
                yield part[[k for k in words if k < colon][-1]].text if any(k < colon for k in words) else "", kind
        elif len(words) > 1 and (kind := type_name([x for k, x in enumerate(part) if k in words[:-1] or x.text in ("<", ">", ".")])):
            yield part[words[-1]].text, kind
        part, depth = [], 0


def locals_of(inner: list[Token], lang: str) -> Iterator[tuple[str, str]]:
    """Names and types of local variables: typed, or made by new."""
    for items in walk(inner):
        for k, t in enumerate(items):
            if t.text != "=" or k < 2:
                continue
            name, made = items[k - 1], k + 2 < len(items) and items[k + 1].text == "new"
            if lang == "typescript" and k > 3 and items[k - 2].text == ":":
                name, kind = items[k - 3], type_name([items[k - 1]])
            elif made:
                kind = type_name(items[k + 2 :])
            else:
                j, depth = k - 2, 0
                while j > 0 and (depth or items[j].text == ">"):  # arguments of the type
                    depth += (items[j].text == ">") - (items[j].text == "<")
                    j -= 1
                kind = items[j].text if lang != "typescript" and items[j].kind == "word" and items[j].text not in ("var", "return") else None
            if name.kind == "word" and kind:
                yield name.text, kind


def calls_of(inner: list[Token]) -> Iterator[tuple[int, str, str]]:
    """(position, receiver, name) of calls; the receiver is the last name before the dot, or empty."""
    for items in walk(inner):
        for k, t in enumerate(items):
            if t.text != "(" or t.kind != "mark" or not k or items[k - 1].kind != "word" or items[k - 1].text in NO_NAMES or items[k - 1].text in MODIFIERS:
                continue
            name = items[k - 1]
            dotted = k > 2 and items[k - 2].text in (".", "?.")
            if dotted and items[k - 3].kind == "word":
                yield name.start, items[k - 3].text, name.text
            elif not dotted and not (k > 1 and items[k - 2].text in ("new", "@")):
                yield name.start, "", name.text


def brace_facts(lang: str, classes: list[Klass]) -> Iterator[tuple]:
    for c in outer(classes, True):
        for name in parents(c):
            yield c.name, None, "parent", name, None, None
        for m in c.members:
            if m.kind == "field":
                of = m.type[1:] if lang == "typescript" and m.type and m.type[0].text == ":" else m.type
                if kind := type_name([x for x in of if x.text not in ("?", "!", ":")]) or next((v for _, v in locals_of([Token("mark", "", 0, 0), Token("word", m.name, 0, 0), Token("mark", "=", 0, 0), *m.rest], lang)), None):
                    yield c.name, None, "type", m.name, kind, None
                continue
            made = m.name == "constructor" if lang == "typescript" else m.name == c.name
            for name, kind in parameters(m.params or next((t for t in m.rest if t.text == "("), None), lang):
                yield c.name, None if made else m.name, "type", name, kind, None
            if made and lang != "typescript":  # this.x = y gives x the type of y
                kinds = dict(parameters(m.params, lang))
                for items in walk(m.rest):
                    for k, t in enumerate(items):
                        if t.text == "=" and k and k + 1 < len(items) and items[k + 1].text in kinds:
                            yield c.name, None, "type", items[k - 1].text, kinds[items[k + 1].text], None
            for name, kind in locals_of(m.rest, lang):
                yield c.name, m.name, "type", name, kind, None
            for at, receiver, name in calls_of(m.rest):
                yield c.name, m.name, "call", receiver, name, at


def python_facts(body: list) -> Iterator[tuple]:
    made = lambda v: v.func.id if isinstance(v, ast.Call) and isinstance(v.func, ast.Name) else None
    named = lambda v: v.id if isinstance(v, ast.Name) else v.attr if isinstance(v, ast.Attribute) else v.value if isinstance(v, ast.Constant) and isinstance(v.value, str) else None
    shared = [(t.id, made(n.value)) for n in body if isinstance(n, ast.Assign) and made(n.value) for t in n.targets if isinstance(t, ast.Name)]
    for c in body:
        if not isinstance(c, ast.ClassDef):
            continue
        for p in c.bases:
            if named(p):
                yield c.name, None, "parent", named(p), None, None
        for name, kind in shared:
            yield c.name, None, "type", name, kind, None
        for m in c.body:
            if isinstance(m, ast.AnnAssign) and isinstance(m.target, ast.Name) and named(m.annotation):
                yield c.name, None, "type", m.target.id, named(m.annotation), None
            if not isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            kinds = {a.arg: named(a.annotation) for a in m.args.args if a.annotation is not None and named(a.annotation)}
            for name, kind in kinds.items():
                yield c.name, m.name, "type", name, kind, None
            for n in ast.walk(m):
                if isinstance(n, ast.Assign) and (kind := made(n.value) or kinds.get(named(n.value))):
                    for t in n.targets:
                        if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                            yield c.name, None, "type", t.attr, kind, None
                        elif isinstance(t, ast.Name):
                            yield c.name, m.name, "type", t.id, kind, None
                elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and named(n.func.value):
                    yield c.name, m.name, "call", named(n.func.value), n.func.attr, n.func.end_lineno * 100_000 + n.func.end_col_offset


def _tried(of: Callable[[], Iterator[tuple]]) -> list[tuple]:
    try:
        return list(of())
    except (SyntaxError, ValueError, RecursionError):
        return []


def _methods(source: str, lang: str, nested: bool, body: list) -> Iterator[tuple]:
    return python_methods(source, body) if lang == "python" else brace_methods(source, lang, body, nested)


def _facts(lang: str, body: list) -> Iterator[tuple]:
    return python_facts(body) if lang == "python" else brace_facts(lang, body)


def extract_source(source: str | None, lang: str, nested: bool = False) -> list[tuple]:
    return [] if source is None else _tried(lambda: _methods(source, lang, nested, parsed(source, lang)))


def facts_source(source: str | None, lang: str) -> list[tuple]:
    return [] if source is None else _tried(lambda: _facts(lang, parsed(source, lang)))


def outline_source(source: str | None, lang: str) -> list[tuple]:
    """The facts, and a row of the kind ``method`` for each method; the source is parsed once."""
    if source is None:
        return []
    try:
        body = parsed(source, lang)
    except (SyntaxError, ValueError, RecursionError):
        return []
    methods = _tried(lambda: _methods(source, lang, False, body))
    return [(*r, None) for r in _tried(lambda: _facts(lang, body))] + [(name, m, "method", None, None, j, api) for _, name, _, _, j, m, _, api, _, _ in methods]


def _sources(files: DataFrame, content: str, path: str) -> DataFrame:
    ship(files.sparkSession)
    d = files.select(F.col(path).alias("path"), language(F.col(path)).alias("lang"), F.col(content).alias("content"))
    return d.where(F.col("lang").isin(*LANGUAGES) & F.col("content").isNotNull())


def pieces(batches: Iterator[pa.RecordBatch], of: Callable[[str, str], list[tuple]], fields: pa.Schema, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of each source (path, lang, content), those of at most about ``most`` characters at a time."""
    for b in batches:
        out, size = [], 0
        for i in range(b.num_rows):
            p, lang, text = (c[i].as_py() for c in b.columns)
            out += [(p, *r) for r in of(text, lang)]
            size += len(text)
            if size >= most or i + 1 == b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(fields)], fields.names)
                out, size = [], 0


def _rows(d: DataFrame, of: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    fields = to_arrow_schema(StructType.fromDDL(f"path string, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pieces(batches, of, fields)

    return d.mapInArrow(run, f"path string, {schema}")


def extract(files: DataFrame, content: str = "content", path: str = "path", nested: bool = False) -> DataFrame:
    """Method rows of the files in a language that has an extractor, with path and file_name (base name + .json)."""
    got = _rows(_sources(files, content, path), lambda t, lang: extract_source(t, lang, nested), SQL)
    name = F.concat(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(".json"))
    return got.withColumn("file_name", name).withColumn("method_definition", trim_code(F.col("method_definition")))


def facts(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """path, class_name, method_name (null: the whole class), kind, name, value, pos: ``type`` (a name and its
    type), ``parent`` (its name) and ``call`` (receiver, or empty, and name)."""
    return _rows(_sources(files, content, path), facts_source, FACTS)


def outline(files: DataFrame, content: str = "content", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Facts, and path, class_name, method_name and is_api_route of the methods, of sources that are parsed once."""
    d = stored(_rows(_sources(files, content, path), outline_source, f"{FACTS}, is_api_route boolean"), "outline")
    return d.where("kind <> 'method'").drop("is_api_route"), d.where("kind = 'method'").select("path", "class_name", "method_name", "is_api_route")


class ExtractMethods:
    def eval(self, lang: str, content: str) -> Iterator[tuple]:
        yield from extract_source(content, lang)


class ExtractFacts:
    def eval(self, lang: str, content: str) -> Iterator[tuple]:
        yield from facts_source(content, lang)


def register(spark: SparkSession) -> None:
    """SQL: SELECT ... FROM sources, LATERAL extract_methods(lang, content), or extract_facts."""
    ship(spark)
    spark.udtf.register("extract_methods", F.udtf(ExtractMethods, returnType=SQL))
    spark.udtf.register("extract_facts", F.udtf(ExtractFacts, returnType=FACTS))
