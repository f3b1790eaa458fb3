"""The corpus pipeline: documents to shards, a stage an operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, langid, ngramjoin, queries, sharding
from sparkloom.llm.shared import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids that may be sent to all executors; beyond it they are joined by a shuffle.
MOST_IDS = 1_000_000


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as no column of docs begins with."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without any letter.

    Where no row is labelled, none is learned, and only the letters decide.
    Repeated rows and null ids stay; extra columns are kept, whatever their names.
    """
    queries.prepare(spark)
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)), F.lit(0))
    trees = langid.learn(docs, fold != 1)
    if not trees.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.identify(docs, trees, prefix="_op_").where(F.col("_op_lang_pred") != langid.UND).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays.

    A document is an id with a text: rows that repeat both are copies, of which
    one stays; rows that share an id, or have none, and differ in text are judged
    each by itself. A null id is smaller than all others.
    """
    queries.prepare(spark)
    small = lambda df: F.broadcast(df) if df.count() <= MOST_IDS else df
    digest, key, gone = fresh(docs, "digest", "key", "gone")
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        d, key = docs, "doc_id"
    else:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        d = docs.withColumn(digest, F.sha2("text", 256)).dropDuplicates(["doc_id", digest])
        # numbers that grow from range to range stand for ids: in the order of id and digest, each once
        d = d.repartitionByRange(n, "doc_id", digest).sortWithinPartitions("doc_id", digest).withColumn(key, F.monotonically_increasing_id())
        d = table(d.drop(digest), "keyed")
    links = ngramjoin.join(d.select(F.col(key).alias("doc_id"), "text"))
    out = table(links.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)), "gone")
    return d.join(small(out), F.col(key) == F.col(gone), "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; null and empty texts have none. Extra
    columns are kept, whatever their names."""
    queries.prepare(spark)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, bench, keep=docs.columns, prefix="_op_").where("_op_n_hit = 0").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as their source's target asks.

    Each row is a document of its own, with copies of its own, whatever its id; a
    null text has size 0, a null source is one of its own. Extra columns are kept,
    whatever their names. An empty table stays empty.
    """
    queries.prepare(spark)
    row, copies, copy = fresh(docs, "row", "copies", "copy")
    d = table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    mix = queries.mixed(d, spark.read.parquet(f"{sf_dir}/labels.parquet"), cut=False, row=row)
    mix = mix.where("copies > 0").select(F.col(row).alias(f"{row}_of"), F.col("copies").alias(copies))
    d = d.join(mix, F.col(row) == F.col(f"{row}_of"))
    return d.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot; null texts are empty ones, equal texts share
    a shard while their group is no larger than a shard's part. Extra columns are not
    kept. An empty table gives no rows."""
    queries.prepare(spark)
    return sharding.shard(docs, 40)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
