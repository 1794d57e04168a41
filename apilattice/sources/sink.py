"""Rows as files: tasks write into a staging folder, and the files show only when all tasks are done.

``df.write.format("apilattice_files").mode("append").save(root)`` over (path, text) after :func:`register`, or
:func:`save_files`.  The root must be visible where tasks run (a mounted store).  Each attempt of a task has a
folder of its own, so one that failed, ran twice or was lost with its executor adds nothing; only the folders of
attempts that Spark committed are moved.  Moving is renaming, done by the driver one file after another.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from apilattice.functions.text import sanitize_path
from apilattice.sources import index as api_index

NAME = "apilattice_files"
STAGING = ".staging-"

#: The extensions of stubs.
EXTENSIONS = {"python": ".py", "typescript": ".ts", "go": ".go", "java": ".java", "dotnet": ".cs"}


@dataclass
class Staged(WriterCommitMessage):
    folder: str


def inside(path: str) -> bool:
    """Whether a path names a file below its root."""
    parts = path.split("/")
    return not any(p in ("", ".", "..") for p in parts) and not parts[0].startswith(STAGING) and "\\" not in path and "\0" not in path


class FileWriter(DataSourceWriter):
    def __init__(self, root: str, replace: bool) -> None:
        self.root, self.replace = root.removeprefix("file://").rstrip("/"), replace
        self.staging = f"{self.root}/{STAGING}{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Staged:
        context = TaskContext.get()
        folder = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        for row in rows:
            if row.path is None or not inside(row.path):
                raise ValueError(f"not a path below the root: {row.path!r}")
            target = f"{folder}/{row.path}"
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as out:
                out.write((row.text or "").encode())
        return Staged(folder)

    def _files(self, messages: list[Staged | None]) -> Iterator[tuple[str, str]]:
        for m in messages:
            for here, _, names in os.walk(m.folder) if m else ():
                for name in names:
                    staged = f"{here}/{name}"
                    yield staged, f"{self.root}/{os.path.relpath(staged, m.folder)}"

    def commit(self, messages: list[Staged | None]) -> None:
        """Nothing moves before every folder is made and no file is in the place of a folder."""
        for _, target in self._files(messages):
            os.makedirs(os.path.dirname(target), exist_ok=True)
        for _, target in self._files(messages):
            if os.path.isdir(target):
                raise IsADirectoryError(target)
        for staged, target in self._files(messages):
            if self.replace or not os.path.exists(target):
                os.replace(staged, target)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        options = {k.lower(): v for k, v in self.options.items()}
        return FileWriter(options["path"], options.get("replace", "true") == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSink)


def save_files(rows: DataFrame, root: str, replace: bool = True) -> None:
    """Writes rows(path, text) as UTF-8 files below ``root``: all of them or, if a task fails, none.

    Of rows with one path the greatest text is written; rows without a path are left out, null
    texts are empty files.  A path that leads out of the root, or that is a folder of another,
    fails the write.  Files that are there already are replaced, or stay without ``replace``.
    """
    register(rows.sparkSession)
    one = rows.where("path is not null").groupBy("path").agg(F.max("text").alias("text"))
    one.write.format(NAME).mode("append").option("replace", str(replace).lower()).save(root)


def stub_files(index: DataFrame, language: str) -> DataFrame:
    """(path, text): a file for each container of a package, its types in order; containers whose paths agree share one."""
    rows = api_index.stubs(index, language)
    path = F.concat_ws("/", sanitize_path(F.col("package_id"), ""), sanitize_path(F.concat("container", F.lit(EXTENSIONS[language])), EXTENSIONS[language]))
    parts = F.sort_array(F.collect_list(F.struct("container", "type_ord", "stub")))
    return rows.groupBy(path.alias("path")).agg(F.array_join(F.transform(parts, lambda p: p["stub"]), "\n").alias("text"))
