"""Python data source "namedfiles": a sink that writes each row (name, text) as a file of that name.

A task writes into a folder of its own attempt. Commit, on the driver, renames the
files of the attempts that Spark took to their names, so a file is whole or not
there; abort, and attempts that were retried or run twice, leave nothing behind.
Mode overwrite empties the folder first, as part of the commit; append replaces
files of the same name and keeps the others. Option indent: JSON texts are
written anew with that indentation. Names may have folders; the path must be on
a file system that the driver and all executors mount.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..runtime import ship


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


def inside(folder: str, name: str) -> str:
    """The path of a name in a folder; one that leads out of it is refused."""
    path = os.path.normpath(os.path.join(folder, name))
    if path == folder or not path.startswith(folder.rstrip("/") + "/"):
        raise ValueError(f"not a name of a file in the folder: {name}")
    return path


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder = os.path.normpath(options["path"])
        self.indent = int(options["indent"]) if options.get("indent") else None
        self.overwrite = overwrite
        self.work = os.path.join(self.folder, f".writing-{uuid.uuid4().hex}")

    def write(self, rows: Iterator[Row]) -> Attempt:
        at = TaskContext.get()
        mine = os.path.join(self.work, f"{at.partitionId()}-{at.taskAttemptId()}")
        os.makedirs(mine, exist_ok=True)
        n = 0
        for name, text in rows:
            path = inside(mine, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            if self.indent is not None:
                text = json.dumps(json.loads(text), indent=self.indent, ensure_ascii=False)
            with open(path, "w", encoding="utf-8") as f:
                f.write(text or "")
            n += 1
        return Attempt(mine, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        if self.overwrite and os.path.isdir(self.folder):
            for name in os.listdir(self.folder):
                path = os.path.join(self.folder, name)
                if path != self.work:
                    shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
        for m in filter(None, messages):
            for top, _, names in os.walk(m.folder):
                to = os.path.join(self.folder, os.path.relpath(top, m.folder))
                os.makedirs(to, exist_ok=True)
                for name in names:
                    os.replace(os.path.join(top, name), os.path.join(to, name))
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages: list[Attempt | None]) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "namedfiles"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def write_files(files: DataFrame, folder: str, mode: str = "append", indent: int | None = None) -> None:
    """Write rows of (name, text); names must be different."""
    ship(files.sparkSession)
    files.sparkSession.dataSource.register(NamedFiles)
    w = files.select("name", "text").write.format("namedfiles").mode(mode)
    (w.option("indent", str(indent)) if indent is not None else w).save(folder)
