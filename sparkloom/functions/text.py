"""Native expressions for paths, code text, endpoints and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and their languages.
LANGUAGES = {
    ".ts": "typescript", ".java": "java", ".py": "python", ".cs": "c_sharp", ".js": "javascript", ".go": "go",
    ".php": "php", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp",
}
# Words that mark sensitive path parts, in the order of their alerts.
SENSITIVE = ["token", "key", "secret", "auth", "password", "credential"]
# Frameworks in order of priority, each with its markers.
FRAMEWORKS = {
    "Django": ["from django.urls", "from django.http", "django.conf"],
    "FastAPI": ["from fastapi", "APIRouter"],
    "NestJS": ["@Controller", "@Get", "@Post"],
    "SpringBoot": ["@RestController", "@SpringBootApplication"],
    ".NET": ["Microsoft.AspNetCore.Mvc", "[ApiController]"],
    "Express": ["require('express')", "import express", 'require("express")'],
    "Laravel": ["Illuminate\\Support\\Facades\\Route", "namespace App\\Http\\Controllers"],
}
# Wording of alerts.
HTTP_ALERT = "SECURITY ALERT: Endpoint %s %s is using HTTP. Use HTTPS for secure communication."
PATH_ALERT = "SECURITY ALERT: Endpoint %s %s seems to be passing a '%s' in the URL path. Sensitive data should be passed in headers or body."
GLOBAL_ALERT = "GLOBAL SECURITY ALERT: Base URL is using HTTP. All endpoints are potentially insecure."


def no_strings() -> Column:
    return F.array().cast("array<string>")


def extension(path: Column) -> Column:
    """The extension with its dot, lower-cased; dotfiles have none."""
    return F.lower(F.regexp_extract(path, r"[^./][^/]*(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, extension(path)), F.lit("unknown"))


def unquote(x: Column) -> Column:
    """Without one pair of equal quotes around it."""
    return F.regexp_replace(x, r"""(?s)^(["'])(.*)\1$""", "$2")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def trim_code(x: Column) -> Column:
    """At most one blank line in a row, and no white space around the code."""
    return strip(F.regexp_replace(x, "\n{3,}", "\n\n"))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def windows(x: Column, size: int) -> Column:
    """Structs (part, cut): text in windows of size words, if it has more than that; else the text alone.

    The words are bound once as the argument of a lambda, so a text is split once
    however many windows it has.
    """
    item = lambda part, cut: F.struct(part.alias("part"), F.lit(cut).alias("cut"))
    at = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size))
    many = lambda w: F.transform(at(w), lambda i: item(F.array_join(F.slice(w, i + 1, size), " "), True))
    return F.flatten(F.transform(F.array(words(x)), lambda w: F.when(F.size(w) > size, many(w)).otherwise(F.array(item(x, False)))))


def endpoint_alerts(path: Column, method: Column, url: Column | None = None) -> Column:
    low = F.lower(path)
    hit = lambda k: low.rlike(r"\{.*" + k + r".*\}") | F.contains(low, F.lit(f"/{k}/"))
    alerts = [F.when(hit(k), F.format_string(PATH_ALERT, method, path, F.lit(k))) for k in SENSITIVE]
    if url is not None:
        alerts.insert(0, F.when(F.startswith(url, F.lit("http://")), F.format_string(HTTP_ALERT, method, path)))
    return F.array_compact(F.array(*alerts))


def global_alerts(url: Column) -> Column:
    return F.when(F.startswith(url, F.lit("http://")), F.array(F.lit(GLOBAL_ALERT))).otherwise(no_strings())


def framework(content: Column, mode: str = "default", head: int = 10_000) -> Column:
    """The first framework whose markers a file's head contains, or null.

    mode 'reference' has NestJS before SpringBoot, so that @GetMapping counts as
    NestJS; the default asks for SpringBoot first.
    """
    order = list(FRAMEWORKS)
    if mode != "reference":
        order.remove("SpringBoot")
        order.insert(order.index("NestJS"), "SpringBoot")
    text = F.substring(content, 1, head)
    found = [F.when(_any(text, FRAMEWORKS[f]), F.lit(f)) for f in order]
    return F.coalesce(*found)


def _any(text: Column, markers: list[str]) -> Column:
    out = F.contains(text, F.lit(markers[0]))
    for m in markers[1:]:
        out = out | F.contains(text, F.lit(m))
    return out


def _slashes(path: Column) -> Column:
    return F.regexp_replace(path, "^/+|/+$", "")


def tag(path: Column) -> Column:
    return F.when(path == "/", F.lit("root")).otherwise(F.split_part(_slashes(path), F.lit("/"), F.lit(1)))


def segments(path: Column) -> Column:
    return F.split(_slashes(path), "/", -1)


def example_key(method: Column, path: Column) -> Column:
    return F.translate(F.concat(F.lower(method), F.lit("_"), F.replace(_slashes(path), F.lit("/"), F.lit("_"))), "{}", "")


def described(description: Column, alerts: Column) -> Column:
    """The description, with a warning line for each alert behind it."""
    lines = F.array_join(F.transform(alerts, lambda a: F.concat(F.lit("WARNING: "), a)), "\n")
    return F.when(F.size(alerts) > 0, F.concat(description, F.lit("\n\n"), lines)).otherwise(description)


def dependency_tail(dep: Column) -> Column:
    return F.substring_index(dep, ".", -1)


def join_path(base: Column, path: Column) -> Column:
    """base and path with one slash between; base alone where path is empty or null."""
    joined = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))
    return F.when(F.coalesce(path, F.lit("")) == "", base).otherwise(joined)


# The mark of a fence, and what it may say.
FENCE, FENCED = "```", "json"


def extract_json(x: Column) -> Column:
    """From the first opening brace of a reply to its last closing one; without both, the reply less its fences."""
    object_ = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    bare = F.regexp_replace(x, rf"(?U)^\s*(?:{FENCE}(?:{FENCED})?\s*)+|\s*{FENCE}\s*$", "")
    return F.when(object_ != "", object_).otherwise(strip(bare))


def repair_json(x: Column) -> Column:
    """Without commas before closers, and with what a cut text lacks: the end of its string, then the
    closers of all that is open, the inner ones first. One fold over the characters, which knows strings."""
    text = F.regexp_replace(x, r",\s*([}\]])", "$1")
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(s: Column, c: Column) -> Column:
        closer = F.translate(c, "{[", "}]")
        still = F.when((c == "{") | (c == "["), F.concat(closer, s["open"])).when(c == F.substring(s["open"], 1, 1), F.substring(s["open"], 2, 1 << 30)).otherwise(s["open"])
        quoted = F.when(s["escaped"], s["quoted"]).otherwise(s["quoted"] != (c == '"'))
        return F.struct(F.when(s["quoted"] | (c == ""), s["open"]).otherwise(still).alias("open"), quoted.alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"))

    missing = F.aggregate(F.split(text, ""), start, step, lambda s: F.concat(F.when(s["quoted"], '"').otherwise(""), s["open"]))
    return F.concat(text, missing)
