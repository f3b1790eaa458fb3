"""The thin query of each operator over the driver's tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brownlm, decontaminate, langid, linededup, media, mixing, ngramjoin, packing, phrases, rlzdedup, sharding, suffixdedup, txlog
from .oracles import ORACLES  # noqa: F401


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: a worker's memory follows the batch, not the partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("spans").cast("long").alias("n_spans"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    refs = media.references(media.interleave(media.as_pages(docs)), ["doc_id", "n_bytes"])
    return refs.join(media.describe(media.store(docs)), "digest", "left").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and html: the web pages, each with figures of three documents behind it (one that
    is not there has a reference that nothing answers), a line of text and a picture from elsewhere."""
    text = F.coalesce("text", F.lit(""))
    n = F.octet_length(text)
    blanks = F.repeat(F.lit(" "), F.when(n == 0, media.WIDTH).otherwise(F.pmod(-n, F.lit(media.WIDTH))))
    ids = documents(spark, sf_dir).select(F.col("doc_id").alias("_id"), F.sha2(F.concat(text, blanks), 256).alias("_digest")).dropDuplicates(["_id"])
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    wanted = pages.select("page_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.col("page_id") * 3 + j)).alias("_j", "_doc"))
    digest = F.coalesce("_digest", F.sha2(F.concat(F.lit("missing "), F.col("_doc").cast("string")), 256))
    shown = F.concat(F.lit('<figure><img src="media:'), digest, F.lit('" alt="text"><figcaption>Document '), F.col("_doc").cast("string"), F.lit("</figcaption></figure>"))
    shown = wanted.join(ids, F.col("_doc") == F.col("_id"), "left").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_j", shown.alias("f")))), lambda x: x["f"]), "").alias("_figures"))
    tail = F.lit('<p>More <b>below</b></p><img src="https://example.org/a.png" alt="from elsewhere">')
    return pages.join(shown, "page_id", "left").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.coalesce("_figures", F.lit("")), tail).alias("html"))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with figures as ordered parts, references resolved against the stored texts."""
    seq = media.interleave(figures(spark, sf_dir))
    parts = media.resolve(seq, media.describe(media.store(documents(spark, sf_dir))), "page_id")
    kind = lambda k: F.size(F.filter("parts", lambda p: p["kind"] == k)).cast("long")
    said = F.transform("parts", lambda p: F.concat_ws("|", p["pos"], p["kind"], p["text"], p["ref"], p["payload"]["payload_sha256"], p["payload"]["payload_bytes"]))
    resolved = F.size(F.filter("parts", lambda p: p["payload"].isNotNull())).cast("long")
    return parts.select("page_id", kind("text").alias("n_text"), kind("media").alias("n_media"), resolved.alias("n_resolved"), F.sha2(F.array_join(said, "\n"), 256).alias("parts_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixed(documents(spark, sf_dir), labels).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def mixed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Documents of good quality weigh 2, of bad quality 0.5, unlabelled ones 1."""
    q = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.pow(F.lit(4.0), F.avg("quality")) / 2).alias("weight"))
    return mixing.mix(docs, quality=q, **options)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(documents(spark, sf_dir)).drop("text")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlzdedup.dedup(documents(spark, sf_dir))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)), F.lit(0)) == 2
    d = brownlm.scores(documents(spark, sf_dir), ~held_out)
    return d.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)), F.lit(0))
    trees = langid.learn(docs, fold != 1)
    d = langid.identify(docs.select("doc_id", "text"), trees)
    return d.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(documents(spark, sf_dir))


def op12_txlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after each epoch and undone changes; a value is the check sum of "key:text"."""
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("_toxic")).distinct()
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    m, key = h % 41, F.floor(h / 100) % 3000
    op = F.when(m <= 1, txlog.COMMIT).when(m == 2, txlog.ABORT).when(m <= 4, txlog.SAVEPOINT).when(m <= 6, txlog.ROLLBACK).otherwise(txlog.CHANGE)
    said = F.crc32(F.concat(key.cast("string"), F.lit(":"), "text").cast("binary"))
    log = documents(spark, sf_dir).select("source", F.col("doc_id").alias("seq"), F.xxhash64("text").alias("tie"), op.alias("op"), key.alias("key"), said.alias("value"))
    log = log.join(toxic.hint("merge"), F.col("seq") == F.col("_toxic"), "left").withColumn("value", F.when(F.col("_toxic").isNull(), F.col("value")))
    got = txlog.reassemble(log)
    stored = lambda c: F.col(c).isNotNull().cast("long")
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    s = txlog.states(got, {"n": stored("new") - stored("old"), "value": value("new") - value("old")})
    return s.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", "value").union(got.undone.select("kind", "seq", "by_seq", "key"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, with a check sum of their ids."""
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            crc = pa.array(np.array([zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)], np.int64))
            yield pa.RecordBatch.from_arrays([crc if n == "ids" else b.column(n) for n in b.schema.names], [n if n != "ids" else "ids_crc32" for n in b.schema.names])

    return pieces.mapInArrow(run, packing.SCHEMA.replace("ids array<int>", "ids_crc32 long"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_media": op2_media,
    "media_pages": media_pages,
    "op3_ngram_join": op3_ngram_join,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_class_lm": op9_class_lm,
    "op10_language": op10_language,
    "op11_phrases": op11_phrases,
    "op12_txlog": op12_txlog,
    "op13_packing": op13_packing,
}
