"""Operator 5: put documents into shards by vector bin packing.

An item is a group of equal texts. Its vector is (bytes, tokens, rows), each
over the table's total; it goes to the shard where the dot product with what
the shard has left is highest. Small groups are bundled by a hash of their
text first. So the packing, which is sequential, sees a bounded number of
items however large the table is: at most ``grain`` bundles and at most
3 x ``grain`` groups that hold over a grain-th of any total.

A group larger than a shard's fair part can't stay whole without breaking the
balance; it is split into chunks of about a sixteenth of that part, by a hash of
each row's place in the table that the sizes are stored in. Ids play no part in
that, so a group may have one id in all rows, or none.

Nulls: a null text is an empty one, of size 16 and check sum 0; null ids come
first in the order of slots. Repeated rows are rows of their own. Ties: items of
equal size are packed by name; rows of a shard that agree in id, check sum and
size stand by their place. Only sizes and counts are kept of a very long text.
Other columns aren't read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .mixing import word_count
from .shared import table

#: Bytes that storing a document takes besides its text.
OVERHEAD = 16


def pack_vectors(items: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each item; items is (n, dimensions). Ties: lower index first."""
    total = items.sum(axis=0)
    v = items / np.where(total > 0, total, 1)
    left = np.full((n_shards, items.shape[1]), 1.0 / n_shards)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(v)), -v.max(axis=1, initial=0))):
        out[i] = k = int(np.argmax(left @ v[i]))
        left[k] -= v[i]
    return out


def shard(docs: DataFrame, n_shards: int = 40, grain: int | None = None, rows_per_range: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot."""
    spark = docs.sparkSession
    grain = grain or 128 * n_shards
    text = F.coalesce("text", F.lit(""))
    d = table(
        docs.select(
            "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            word_count(text).alias("tokens"), F.unhex(F.md5(text.cast("binary"))).alias("_group"), F.monotonically_increasing_id().alias("_row"),
        ),
        "shard",
    )
    total = d.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    large = F.greatest(F.col("size") / max(total["size"] or 0, 1), F.col("tokens") / max(total["tokens"] or 0, 1), F.col("rows") / max(total["rows"], 1))
    groups = d.groupBy("_group").agg(*sums)
    big = [(bytes(g), max(1, int(-(-x * n_shards * 16 // 1)) if x * n_shards > 1 else 1)) for g, x in groups.select("_group", large.alias("x")).where(F.col("x") * grain >= 1).collect()]
    big_df = spark.createDataFrame(big, "_big binary, _chunks int")
    chunk = F.when(F.col("_chunks") > 1, F.pmod(F.xxhash64("_row", F.lit(5)), F.col("_chunks"))).otherwise(F.lit(0))
    item = F.when(F.col("_big").isNotNull(), F.concat(F.hex("_big"), F.lit("/"), chunk)).otherwise(F.pmod(F.xxhash64("_group"), F.lit(grain)).cast("string"))
    d = d.join(F.broadcast(big_df), F.col("_group") == F.col("_big"), "left").withColumn("_item", item)
    items = sorted(d.groupBy("_item").agg(*sums).collect())
    placed = pack_vectors(np.array([x[1:] for x in items], float).reshape(len(items), 3), n_shards)
    where = spark.createDataFrame([(x[0], int(k)) for x, k in zip(items, placed, strict=True)], "_item string, shard int")
    n = max(1, -(-total["rows"] // (n_shards * rows_per_range)))
    d = d.join(F.broadcast(where), "_item").withColumn("_range", F.pmod(F.xxhash64("_row", F.lit(11)), F.lit(n)))
    first = d.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    first = first.select(F.col("shard").alias("_s"), F.col("_range").alias("_r"), (F.sum("_n").over(W.partitionBy("shard").orderBy("_range")) - F.col("_n")).alias("_first"))
    d = d.withColumn("_k", F.row_number().over(W.partitionBy("shard", "_range").orderBy("doc_id", "text_crc32", "size", "_row")))
    d = d.join(first, (F.col("shard") == F.col("_s")) & (F.col("_range") == F.col("_r")))
    return d.select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("_first") + F.col("_k") - 1).cast("long").alias("slot"))
