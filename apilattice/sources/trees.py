"""File trees as a data source: executors list the folders, the driver only the few that part the work.

``spark.read.format("apilattice_tree")`` after :func:`register`, or :func:`scan`.  The driver opens folders
breadth first until ``partitions`` of them are open; each of these is walked by a task, and what lies in the
opened ones directly is listed by tasks too.  Folders must be visible where tasks run (a mounted store).

Excluded folders are left out at any depth, unreadable ones and broken links skipped.  A link is followed
unless it leads back to a folder above itself, so cycles end; :func:`scan` keeps a real folder that several
paths lead to under the least of them only.
"""

from __future__ import annotations

import fnmatch
import os
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from apilattice.operators.detect import EXCLUDED, MAX_DEPTH

NAME = "apilattice_tree"
SCHEMA = "folder string, real_folder string, rel_path string, ext string, size bigint, mtime_ticks bigint"


class Folder(InputPartition):
    """A folder below the root: alone, or with all that it holds."""

    def __init__(self, path: str, depth: int, deep: bool) -> None:
        super().__init__(path)
        self.path, self.depth, self.deep = path, depth, deep


def _entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def _is_folder(e: os.DirEntry) -> bool:
    try:
        return e.is_dir()
    except OSError:
        return False


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"].removeprefix("file://")
        self.pattern = options.get("pattern", "*").lower()
        self.max_depth = int(options.get("maxdepth", MAX_DEPTH))
        self.most = int(options.get("partitions", 64))

    def _below(self, folder: str, depth: int) -> list[str]:
        return [e.path for e in _entries(folder) if depth < self.max_depth and e.name.lower() not in EXCLUDED and _is_folder(e)]

    def _above(self, folder: str) -> frozenset[str]:
        """The real paths of the folders above one, down from the root."""
        above, folder = set(), os.path.normpath(folder)
        while folder != os.path.normpath(self.root):
            folder = os.path.dirname(folder)
            above.add(os.path.realpath(folder))
        return frozenset(above)

    def partitions(self) -> list[Folder]:
        waiting, opened = deque([(self.root, 0)]), []
        while waiting and len(waiting) < self.most and len(opened) < self.most:
            folder, depth = waiting.popleft()
            if os.path.realpath(folder) not in self._above(folder):
                opened.append(Folder(folder, depth, False))
                waiting.extend((f, depth + 1) for f in self._below(folder, depth))
        return opened + [Folder(f, d, True) for f, d in waiting]

    def read(self, partition: Folder) -> Iterator[tuple]:
        stack = [(partition.path, partition.depth, self._above(partition.path))]
        while stack:
            folder, depth, above = stack.pop()
            real = os.path.realpath(folder)
            if real in above:
                continue
            here = os.path.relpath(folder, self.root).replace(os.sep, "/")
            here = "" if here == "." else here
            for e in _entries(folder):
                if _is_folder(e) or not fnmatch.fnmatch(e.name.lower(), self.pattern):
                    continue
                try:
                    stat = e.stat()
                except OSError:
                    continue
                yield here, real, f"{here}/{e.name}".lstrip("/"), os.path.splitext(e.name)[1].lower(), stat.st_size, stat.st_mtime_ns // 100
            if partition.deep:
                stack.extend((f, depth + 1, above | {real}) for f in self._below(folder, depth))


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def scan(spark: SparkSession, root: str, package_id: str, pattern: str = "*", max_depth: int = MAX_DEPTH, partitions: int = 64) -> DataFrame:
    """A files table (package_id, rel_path, ext, size, mtime_ticks) of a tree, listed in executors."""
    register(spark)
    found = spark.read.format(NAME).options(pattern=pattern, maxDepth=max_depth, partitions=partitions).load(root)
    least = found.groupBy("real_folder").agg(F.min("folder").alias("folder"))
    kept = found.join(least, ["real_folder", "folder"], "left_semi").dropDuplicates(["rel_path"])
    return kept.select(F.lit(package_id).alias("package_id"), "rel_path", "ext", "size", "mtime_ticks")
