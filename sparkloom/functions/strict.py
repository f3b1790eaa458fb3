"""Strict JSON parsing, which Spark's own readers do not offer.

try_parse_json and from_json accept text behind a value and reject NaN; here a
text either is one JSON value or has none. Runs in Python, batch by batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .text import extract_json, repair_json


def canonical(text: str | None) -> str | None:
    """The value as sorted compact JSON, or None where the text is not valid."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def parse(x: Column) -> Column:
    """Column of canonical JSON, null where a text is not valid."""
    return F.udf(canonical, "string", useArrow=True)(x)


def parse_reply(x: Column) -> Column:
    """Extract, repair and strictly parse the JSON of a model's reply."""
    return parse(repair_json(extract_json(x)))


def safe_parse(x: Column, fallback: Column) -> Column:
    return F.coalesce(parse_reply(x), fallback)


def generate_json(df: DataFrame, prompt: str, out: str, generate: Callable[[str], str], *, retries: int = 2, accept: Callable[[object], bool] | None = None) -> DataFrame:
    """df with a column of JSON that generate(prompt) made, asked again up to
    retries times while it is not valid or not accepted; null when it never is."""
    ship(df.sparkSession)
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def once(text: str | None) -> str | None:
        from ..functions.replies import object_text

        for _ in range(retries + 1):
            try:
                got = canonical(object_text(generate(text or "")))
            except Exception:  # noqa: BLE001 - a model may fail in any way; the next attempt may not
                continue
            if got is not None and (accept is None or accept(json.loads(got))):
                return got
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([once(t) for t in b.column(names.index(prompt)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*names, out])

    return df.mapInArrow(run, f"{fields}, {out} string")


def generate_text(df: DataFrame, prompt: str, out: str, generate: Callable[[str], str]) -> DataFrame:
    """df with a column of what generate(prompt) answered; null where it failed."""
    ship(df.sparkSession)
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def once(text: str | None) -> str | None:
        try:
            return generate(text or "")
        except Exception:  # noqa: BLE001 - a model may fail in any way
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([once(t) for t in b.column(names.index(prompt)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*names, out])

    return df.mapInArrow(run, f"{fields}, {out} string")


def is_documentation(value: object) -> bool:
    """A reply counts if it has one of the two parts."""
    return isinstance(value, dict) and ("postman" in value or "swagger" in value)
