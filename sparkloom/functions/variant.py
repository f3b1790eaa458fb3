"""Model replies as VARIANT columns, without Python workers.

Spark's parser takes a value and leaves what stands behind it. Here a text counts
only if it is one JSON value: it is parsed again inside an object whose last key
is made from the text's own digest, and what comes out, written anew, must be the
value and that key and nothing else. So trailing text, and texts that try to end
the object, are refused. NaN and infinities are refused by the parser, and so are
objects with a key twice, which Python's parser takes. Numbers too great for a
double are taken as they come out of Spark's parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import extract_json, repair_json


def strict_variant(x: Column) -> Column:
    """The VARIANT of a text that is one JSON value, or null."""
    value = F.try_parse_json(x)
    mark = F.concat(F.lit("w"), F.md5(x))
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit(',"'), mark, F.lit('":0}')))
    whole = F.concat(F.lit('{"v":'), F.to_json(value), F.lit(',"'), mark, F.lit('":0}'))
    return F.when(F.to_json(inside) == whole, value)


def reply_variant(x: Column) -> Column:
    """Extract, repair and strictly parse the JSON of a model's reply."""
    return strict_variant(repair_json(extract_json(x)))


def typed(x: Column, path: str, kind: str) -> Column:
    """A part of a VARIANT as a Spark type, or null where it is missing or of another type."""
    return F.try_variant_get(x, path, kind)


def documentation_parts(x: Column) -> Column:
    """A reply's postman and swagger parts, or null for a reply with neither."""
    part = lambda p: F.try_variant_get(x, f"$.{p}", "variant")
    return F.when(part("postman").isNotNull() | part("swagger").isNotNull(), F.struct(part("postman").alias("postman"), part("swagger").alias("swagger")))


def merged_schema(replies: DataFrame, reply: str, by: list[str] | None = None) -> DataFrame:
    """The schema that all replies fit, of each group if there are groups: one partial aggregation."""
    return replies.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("replies"), F.count(reply).alias("valid"), F.schema_of_variant_agg(F.col(reply)).alias("schema"))
