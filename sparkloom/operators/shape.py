"""Keyed dedup, nesting and flattening, schema checks, framework of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import framework

METHOD = "struct<method_name: string, method_type: string, is_api_route: boolean, method_path: string, method_definition: string>"


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key; a partial limit runs before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest order of each key, by one partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return got.select(*keys, "_r.*").select(*df.columns)


def nest_classes(methods: DataFrame) -> DataFrame:
    """Method rows to classes: the first row's class attributes, methods in order, the first of each name."""
    m = first_wins(methods, ["path", "class_name", "method_name"], ["class_ord", "ord"])
    item = F.struct("ord", F.struct("method_name", "method_type", "is_api_route", "method_path", "method_definition").alias("m"))
    got = m.groupBy("path", "class_name").agg(F.min("class_ord").alias("class_ord"), F.min_by(F.struct("class_type", "base_path", "file_name"), F.struct("class_ord", "ord")).alias("_a"), F.array_sort(F.collect_list(item)).alias("_l"))
    return got.select("path", "class_ord", "class_name", "_a.*", F.transform("_l", lambda x: x["m"]).alias("methods")).where(F.size("methods") > 0)


def flatten_classes(classes: DataFrame) -> DataFrame:
    """Classes to method rows; class values replace fields of the same name, classes without methods vanish."""
    outer = [c for c in classes.columns if c != "methods"]
    d = classes.select(*outer, F.posexplode("methods").alias("ord", "_m"))
    inner = [f.name for f in classes.schema["methods"].dataType.elementType.fields if f.name not in outer]
    return d.select(*outer, "ord", *[F.col("_m")[c].alias(c) for c in inner])


def check_classes(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid classes, and others with a reason. A missing base path is '/'."""
    blank = F.exists("methods", lambda m: F.coalesce(F.trim(m["method_name"]), F.lit("")) == "")
    lacks = F.exists("methods", lambda m: m["is_api_route"].isNull() | m["method_definition"].isNull())
    why = F.when(F.col("methods").isNull(), "methods missing").when(blank, "method name is blank").when(lacks, "required field missing")
    d = classes.withColumn("base_path", F.coalesce("base_path", F.lit("/"))).withColumn("reason", why)
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


def strict_classes(classes: DataFrame) -> DataFrame:
    """The classes, or an error when one of them is not valid."""
    blank = F.exists("methods", lambda m: (F.coalesce(F.trim(m["method_name"]), F.lit("")) == "") | m["is_api_route"].isNull() | m["method_definition"].isNull())
    bad = F.col("methods").isNull() | blank
    return classes.withColumn("class_name", F.when(bad, F.raise_error(F.lit("class is not valid"))).otherwise(F.col("class_name")))


def project_framework(files: DataFrame, mode: str = "default") -> DataFrame:
    """The framework of the first file, by path, that matches any; else Unknown."""
    d = files.select("path", framework(F.col("content"), mode).alias("f")).where("f is not null")
    return d.agg(F.coalesce(F.min_by("f", "path"), F.lit("Unknown")).alias("framework"))
