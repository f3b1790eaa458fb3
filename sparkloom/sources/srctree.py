"""Python data source "srctree": files of a source tree, one row a file.

Unlike Spark's text sources it keeps names that begin with _ or a dot, and
leaves out excluded directories at any depth before anything is read. The driver
lists the top folder only; each of its folders is a partition, which an executor
walks. Filters on path and file_name (equal, in a list, a beginning, an end) are
answered from the names, before a file is opened. Options: exclude
(comma-separated directory names), errors ('strict': a file that is not UTF-8 has
null content and an error; 'ignore': bad bytes are dropped), maxChars,
filesPerPartition (files of the top folder). The tree must be on a path that all
executors see. A folder that holds nearly all files is one task's work.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

# Directories that are never read, by the extractors and by the framework detector.
EXCLUDED = "node_modules,.git,__pycache__,.venv"
DETECTOR_EXCLUDED = "node_modules,.git,__pycache__"
SCHEMA = "path string, file_name string, content string, error string"


class Files(InputPartition):
    """Files, or a folder with all that is below it."""

    def __init__(self, paths: list[str], folder: str | None = None):
        self.paths, self.folder = paths, folder


def walk(root: str, exclude: set[str]) -> Iterator[str]:
    for top, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in exclude)
        for f in sorted(files):
            yield os.path.join(top, f)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", "")
        if not os.path.exists(self.root):
            raise FileNotFoundError(f"no such folder: {self.root}")
        self.exclude = {x for x in options.get("exclude", EXCLUDED).split(",") if x}
        self.errors = options.get("errors", "strict")
        self.most = int(options.get("maxchars", options.get("maxChars", 0)))
        self.each = int(options.get("filesperpartition", options.get("filesPerPartition", 256)))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps the filters that names answer, and gives back the others."""
        kinds = {EqualTo: "equal", In: "in", StringStartsWith: "start", StringEndsWith: "end", StringContains: "has"}
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in kinds and column in (("path",), ("file_name",)):
                self.tests.append((column[0], kinds[type(f)], tuple(f.value) if isinstance(f.value, (list, tuple)) else (f.value,)))
            else:
                yield f

    def wanted(self, path: str) -> bool:
        how = {"equal": str.__eq__, "in": str.__eq__, "start": str.startswith, "end": str.endswith, "has": str.__contains__}
        value = {"path": path, "file_name": os.path.basename(path)}
        return all(any(v is not None and how[kind](value[c], v) for v in values) for c, kind, values in self.tests)

    def partitions(self) -> list[Files]:
        if not os.path.isdir(self.root):
            return [Files([self.root])]
        with os.scandir(self.root) as listed:
            entries = sorted(listed, key=lambda e: e.name)
        folders = [e.path for e in entries if e.is_dir(follow_symlinks=False) and e.name not in self.exclude]
        paths = [e.path for e in entries if e.is_file()]
        parts = [Files(paths[i : i + self.each]) for i in range(0, len(paths), self.each)]
        return [*parts, *(Files([], f) for f in folders)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for p in partition.paths if partition.folder is None else walk(partition.folder, self.exclude):
            if not self.wanted(p):
                continue
            try:
                with open(p, encoding="utf-8", errors=self.errors) as f:
                    yield p, os.path.basename(p), f.read(self.most) if self.most else f.read(), None
            except (OSError, ValueError) as e:
                yield p, os.path.basename(p), None, type(e).__name__


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_tree(spark: SparkSession, path: str, **options) -> DataFrame:
    if not os.path.exists(path):
        raise FileNotFoundError(f"no such folder: {path}")
    from ..runtime import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    r = spark.read.format("srctree")
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(path)


def read_heads(spark: SparkSession, path: str, chars: int = 10_000) -> DataFrame:
    """The beginnings of all files as the framework detector reads them: its own excluded folders, bad bytes dropped."""
    return read_tree(spark, path, exclude=DETECTOR_EXCLUDED, errors="ignore", maxChars=chars)
