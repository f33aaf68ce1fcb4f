"""A sink that leaves one text file a name: written aside by the tasks, put in place when all of them are done.

Rows are (name, value), all rows of a name in one task and in order: see `write_files`. A task writes `<name><suffix>` into a folder
of the job beside the others; commit moves the files of the attempts that counted into place and drops the folder, abort drops
the folder alone. So a file is there whole or not at all, lost executors and second attempts leave nothing behind, and no
content passes through the driver. The path must be one that all executors see.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from strandloom.shipping import ship

_SCHEME = re.compile(r"([a-z][a-z0-9+.-]*):(?://[^/]*)?(/.*)")


def folder(path: str) -> str:
    """A path that files can be opened under; stores that only Spark reads have none."""
    found = _SCHEME.fullmatch(path)
    if found and found[1] != "file":
        raise ValueError(f"{path}: one file a name needs a folder that all executors have mounted")
    return found[2] if found else path


@dataclass
class Written(WriterCommitMessage):
    """What one task left in the job's folder: (name, file)."""

    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix
        self.aside = os.path.join(path, f"_{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        context = TaskContext.get()
        own = os.path.join(self.aside, f"{context.partitionId()}-{context.taskAttemptId()}")
        os.makedirs(own, exist_ok=True)
        files: list[tuple[str, str]] = []
        name, out, seen = None, None, set()
        try:
            for row in iterator:
                if out is None or row["name"] != name:
                    if out:
                        out.close()
                    name = row["name"]
                    if name is None or name in seen or os.sep in name:
                        raise ValueError(f"{name}: rows of a name follow each other, and a name is one of a file")
                    seen.add(name)
                    files.append((name, os.path.join(own, name + self.suffix)))
                    out = open(files[-1][1], "w", encoding="utf-8", newline="\n")
                if row["value"] is not None:
                    out.write(row["value"] + "\n")
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [x for m in messages if m for x in m.files]
        try:
            if len({name for name, _ in files}) < len(files):
                raise ValueError("a name was written by two tasks")
            for name, at in files:
                os.replace(at, os.path.join(self.path, name + self.suffix))
        finally:
            shutil.rmtree(self.aside, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class SampleFiles(DataSource):
    """Options: `path` (a folder) and `suffix` (of the files' names)."""

    @classmethod
    def name(cls) -> str:
        return "sample_files"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        path = folder(self.options["path"])
        os.makedirs(path, exist_ok=True)
        return _Writer(path, self.options.get("suffix", ""))


def write_files(lines: DataFrame, path: str, suffix: str, order: list[str], names: DataFrame | None = None) -> None:
    """Lines (name, value and the columns of `order`) as one file a name; each of `names` (name) has a file, be it empty."""
    spark = lines.sparkSession
    ship(spark)
    spark.dataSource.register(SampleFiles)
    rows = lines.select(F.col("name").cast("string").alias("name"), "value", *order)
    if names is not None:
        rows = rows.unionByName(names.select(F.col("name").cast("string").alias("name"), F.lit(None).cast("string").alias("value")), allowMissingColumns=True)
    rows.repartition("name").sortWithinPartitions("name", *order).select("name", "value").write.format("sample_files").option("path", path).option("suffix", suffix).mode("append").save()
