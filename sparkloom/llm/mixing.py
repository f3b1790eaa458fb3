"""Operator 4: mix sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / weight, u from a hash of its id; the
documents of a source in order of their keys are a weighted sample without
replacement at every prefix. A source's token budget is spent on complete
epochs first; what is left of it goes to the documents with the least keys.

Prefix sums never put a source into one task: keys are cut into ranges, ranges
are summed first, and rows are only ordered within a range.

Nulls: a null text has size 0, a null source is a source of its own, a null or
non-positive weight counts as 1. A row without an id is drawn by its place in the
table that the sizes are stored in, so that such rows aren't one key. Rows that
agree in id and size are interchangeable; each is a document of its own. Only the
size is kept of a very long text. Other columns aren't read, whatever their names.
An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import table

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int, row: Column) -> Column:
    """Above 0 and below 1, by the first 52 bits of the MD5 of "id:seed", or of "row:place:seed" without an id."""
    said = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.concat(F.lit("row:"), row.cast("string"))), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def source_targets(sized: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of every source: its weight's part of share x all sizes, at most
    most x its own size; the excess goes to the others by weight.

    Sources in code point order, null last, take the weights in turn. Water
    filling: sources ordered by cap / weight fill up one after another, so
    prefix sums over that order give the level at which the rest share. Only
    the source table, one row a source, is ordered as a whole.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_i", F.row_number().over(every) - 1)
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", most * F.col("source_size"))
    fill = W.orderBy(F.col("_cap") / F.col("_w"), "_i")
    whole = W.orderBy("_i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_all", share * F.sum("source_size").over(whole)).withColumn("_allw", F.sum("_w").over(whole))
    s = s.withColumn("_rest", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_restw", F.col("_allw") - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_full", F.col("_cap") * F.col("_restw") <= F.col("_rest") * F.col("_w"))
    s = s.withColumn("_level", F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "_i", (F.col("_rest") / F.col("_restw")).alias("level")))).over(whole)["level"])
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_level") * F.col("_w"), F.col("_cap")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, *, quality: DataFrame | None = None, seed: int = 7, cut: bool = True, rows_per_range: int = 2_000, row: str | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, epochs, taken, copies.

    row: a column of docs that is different in each row; it then is in the result too.

    cut: the document at the budget's edge is taken in part, so that a source's
    taken words are its target, rounded; otherwise documents are whole, and the
    one at the edge is taken if that comes nearer. quality: weights
    of documents by doc_id, at most one row an id.
    """
    place = F.monotonically_increasing_id() if row is None else F.col(row)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place.alias("_row"))
    w = F.lit(1.0)
    if quality is not None:
        sized = sized.join(quality.select(F.col("doc_id").alias("_id"), F.col("weight").alias("_w")), F.col("doc_id") == F.col("_id"), "left")
        w = F.when(F.col("_w") > 0, F.col("_w").cast("double")).otherwise(1.0)
    sized = table(sized.select("doc_id", "source", "size", "_row", w.alias("_weight")), "mix")
    n = max(1, -(-sized.count() // rows_per_range))
    d = sized.withColumn("_key", -F.log(uniform(F.col("doc_id"), seed, F.col("_row"))) / F.col("_weight"))
    # the share of all keys below this one, weights taken to the nearest power of 2: ranges of about equal numbers
    kind = F.greatest(F.lit(-40), F.least(F.lit(40), F.round(F.log2("_weight")))).cast("int")
    kinds = sized.groupBy(kind.alias("k")).count().collect()
    rows = max(1, sum(r["count"] for r in kinds))
    below = sum((F.lit(r["count"] / rows) * (1 - F.exp(-F.col("_key") * 2.0 ** r["k"])) for r in kinds), F.lit(0.0))
    d = d.withColumn("_range", F.least(F.floor(below * n), F.lit(n - 1)))
    t = source_targets(sized, list(weights), share, most)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long"))
    t = t.withColumn("_left", F.greatest(F.round("target").cast("long") - F.col("epochs") * F.col("source_size"), F.lit(0)))
    r = d.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    r = r.withColumn("_first", F.sum("_sum").over(W.partitionBy("source").orderBy("_range")) - F.col("_sum"))
    r = r.join(t.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_sum")
    r = r.withColumnsRenamed({"source": "_s", "_range": "_r"})
    d = d.withColumn("_in", F.sum("size").over(W.partitionBy("source", "_range").orderBy("_key", "doc_id", "size", "_row").rowsBetween(W.unboundedPreceding, W.currentRow)))
    d = d.join(r, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    room = F.col("_left") - (F.col("_first") + F.col("_in") - F.col("size"))
    part = F.greatest(F.least(room, F.col("size")), F.lit(0)) if cut else F.when(2 * room >= F.col("size"), F.when(room > 0, F.col("size")).otherwise(0)).otherwise(0)
    return d.select("doc_id", "size", "source", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), (F.col("epochs") + (part > 0).cast("long")).cast("int").alias("copies"), *([F.col("_row").alias(row)] if row else []))
