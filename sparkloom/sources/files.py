"""JSON folders, settings and project inputs."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections import ChainMap
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any
from urllib.parse import urlsplit, urlunsplit

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strict import parse
from ..runtime import ship


def _finds(spark: SparkSession, pattern: str) -> bool:
    """Whether files match, in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def read_json_file(spark: SparkSession, path: str) -> DataFrame:
    """file_name and strictly parsed data of one file; no row where it is missing or malformed."""
    if not _finds(spark, path):
        return spark.createDataFrame([], "file_name string, data string")
    return _parsed(spark.read.text(path, wholetext=True))


def read_json_folder(spark: SparkSession, path: str) -> DataFrame:
    """file_name and data of the .json files in a folder, by name; malformed ones and nulls are left out."""
    if not _finds(spark, f"{path.rstrip('/')}/*.json"):
        return spark.createDataFrame([], "file_name string, data string")
    return _parsed(spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)).orderBy("file_name")


def _parsed(raw: DataFrame) -> DataFrame:
    ship(raw.sparkSession)
    d = raw.select(F.col("_metadata.file_name").alias("file_name"), parse(F.col("value")).alias("data"))
    return d.where(F.col("data").isNotNull() & (F.col("data") != "null"))


# Defaults of the settings, by dotted name.
DEFAULTS: dict[str, Any] = {"app.APP_NAME": "Generated API", "rag.top_k_retriever": 10, "rag.top_k_reranker": 5, "rag.chunk_size": 500}


def dotted(tree: dict, prefix: str = "") -> Iterator[tuple[str, Any]]:
    """The leaves of nested settings by dotted name; an empty group is a leaf."""
    for name, value in tree.items():
        if isinstance(value, dict) and value:
            yield from dotted(value, f"{prefix}{name}.")
        else:
            yield f"{prefix}{name}", value


class Settings:
    """Settings by dotted name, one layer a source: keywords, then the last YAML file to the first, then the defaults."""

    def __init__(self, *paths: str, **extra: Any):
        layers = [dict(DEFAULTS)]
        for p in filter(os.path.isfile, paths):
            with open(p, encoding="utf-8") as f:
                layers.append(dict(dotted(yaml.safe_load(f) or {})))
        self.layers = ChainMap(*reversed([*layers, dict(dotted(extra))]))

    def get(self, name: str, default: Any = None) -> Any:
        """A leaf, or a group as a mapping of what is below it."""
        found = self.layers.get(name)
        if found is not None:
            return found
        below = {k[len(name) + 1 :]: v for k, v in self.layers.items() if k.startswith(f"{name}.")}
        return below or default


def with_credentials(url: str, credentials: str | None) -> str:
    """An https address with user:password, unless it has some or none are given."""
    u = urlsplit(url)
    if u.scheme != "https" or u.username is not None or not credentials:
        return url
    return urlunsplit(u._replace(netloc=f"{credentials}@{u.netloc}"))


@contextmanager
def project(source_type: str, path: str, credentials: str | None = None):
    """A folder with the project: a local one is read in place, a repository is
    cloned to a folder that goes afterwards. Credentials never reach an error text."""
    if source_type != "git":
        if not os.path.exists(path):
            raise FileNotFoundError(f"no such folder: {path}")
        yield path
        return
    target = tempfile.mkdtemp(prefix="project-")
    try:
        r = subprocess.run(["git", "clone", "--quiet", "--depth", "1", with_credentials(path, credentials), target], capture_output=True, text=True)
        if r.returncode:
            raise RuntimeError(f"can't clone {path}")
        yield target
    finally:
        shutil.rmtree(target, ignore_errors=True)
