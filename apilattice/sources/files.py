"""Source trees: a bounded, safe walk on the driver, file contents by Spark, and build files."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import tomllib
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apilattice.operators.detect import EXCLUDED, MAX_DEPTH, MAX_FILES
from apilattice.sources import schemas

MAX_BUILD_FILE = 10 << 20


def spread(files: DataFrame) -> DataFrame:
    """files(package_id, rel_path, ...) dealt to all tasks before Python parses them; a table of one small file would be parsed by one task."""
    return files.repartition("package_id", "rel_path")


def walk(root: str, pattern: str = "*", max_files: int = MAX_FILES, max_depth: int = MAX_DEPTH):
    """(rel_path, size, mtime_ns) of files below a folder: no excluded folder, no link cycle, unreadable ones skipped."""
    stack, seen, n = [(root, 0)], set(), 0
    while stack and n < max_files:
        here, depth = stack.pop()
        real = os.path.realpath(here)
        if real in seen:
            continue
        seen.add(real)
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            try:
                if e.is_dir():
                    if depth < max_depth and e.name.lower() not in EXCLUDED:
                        stack.append((e.path, depth + 1))
                elif n < max_files and fnmatch.fnmatch(e.name.lower(), pattern.lower()):
                    stat = e.stat()
                    n += 1
                    yield os.path.relpath(e.path, root).replace(os.sep, "/"), stat.st_size, stat.st_mtime_ns
            except OSError:
                continue


def scan(spark: SparkSession, root: str, package_id: str, **limits) -> DataFrame:
    """A files table of one tree on the driver's disk."""
    rows = [(package_id, p, os.path.splitext(p)[1].lower(), size, ns // 100) for p, size, ns in walk(root, **limits)]
    return spark.createDataFrame(rows, schemas.FILES)


def contents(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """(rel_path, content) of text files in any store that Spark reads."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("path"), F.decode("content", "UTF-8").alias("content"))


def read_dotenv(text: str) -> dict[str, str]:
    """Variables of a ``.env`` text: comments and blank lines skipped, ``export`` and quotes taken off."""
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ").strip()
        key, eq, value = line.partition("=")
        if eq and key and not key.startswith("#"):
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def source_path(name: str, text: str) -> str | None:
    """The source folder that a build file names, or None."""
    if len(text) > MAX_BUILD_FILE:
        return None
    try:
        if name == "pyproject.toml":
            tool = tomllib.loads(text).get("tool", {})
            where = tool.get("setuptools", {}).get("packages", {})
            if isinstance(where, dict) and where.get("find", {}).get("where"):
                return where["find"]["where"][0]
            root = tool.get("setuptools", {}).get("package-dir", {}).get("")
            if root:
                return root
            for p in tool.get("poetry", {}).get("packages", []):
                if p.get("from"):
                    return p["from"]
            hatch = tool.get("hatch", {}).get("build", {}).get("targets", {}).get("wheel", {}).get("packages") or []
            return hatch[0].split("/")[0] if hatch else None
        if name == "pom.xml":
            found = [e.text for e in ET.fromstring(text).iter() if _local(e.tag) == "sourceDirectory" and e.text]
            return found[0].strip() if found else "src/main/java"
        if name.startswith("build.gradle"):
            found = re.search(r"""srcDirs?\s*(?:=|\()?\s*\[?\s*["']([^"']+)["']""", text)
            return found[1] if found else "src/main/java"
        if name == "tsconfig.json":
            made = json.loads(re.sub(r"(?m)^\s*//.*$", "", text))
            include = (made.get("include") or [""])[0]
            return made.get("compilerOptions", {}).get("rootDir") or include.split("/")[0].rstrip("*") or None
        if name == "package.json":
            entry = json.loads(text).get("source") or json.loads(text).get("main") or ""
            return entry.removeprefix("./").rpartition("/")[0] or None
    except (ValueError, ET.ParseError, AttributeError, KeyError, IndexError, TypeError):
        return None
    return None


def package_name(name: str, text: str) -> str | None:
    """The name that importers use, from a build file."""
    try:
        if name == "pyproject.toml":
            made = tomllib.loads(text)
            return made.get("project", {}).get("name") or made.get("tool", {}).get("poetry", {}).get("name")
        if name == "package.json":
            return json.loads(text).get("name")
        if name == "pom.xml":
            return next((e.text.strip() for e in ET.fromstring(text) if _local(e.tag) == "groupId" and e.text), None)
        if name == "go.mod":
            found = re.search(r"(?m)^\s*module\s+(\S+)", text)
            return found[1] if found else None
        if name.endswith(".csproj"):
            tags = {_local(e.tag): e.text for e in ET.fromstring(text).iter() if e.text}
            return tags.get("RootNamespace") or tags.get("PackageId") or tags.get("AssemblyName")
        if name.startswith("build.gradle"):
            found = re.search(r"""(?m)^\s*group\s*=?\s*["']([^"']+)["']""", text)
            return found[1] if found else None
    except (ValueError, ET.ParseError, AttributeError):
        return None
    return None


def build_files(rows: DataFrame) -> DataFrame:
    """rows(package_id, name, content) with source_path and package_name; parsing runs on few, small rows."""

    def parse(batches):
        for pdf in batches:
            pairs = list(zip(pdf["name"], pdf["content"].fillna("")))
            yield pd.DataFrame({"package_id": pdf["package_id"], "name": pdf["name"], "source_path": [source_path(*p) for p in pairs], "package_name": [package_name(*p) for p in pairs]})

    return rows.select("package_id", "name", "content").mapInPandas(parse, "package_id string, name string, source_path string, package_name string")


def write_samples(samples: DataFrame, extension: str) -> DataFrame:
    """Samples with name and code, under paths that stay inside their folder; write with :func:`save_text`."""
    from apilattice.functions.text import is_blank, sanitize_path

    kept = samples.where(~is_blank(F.col("name")) & ~is_blank(F.col("code")))
    return kept.select(sanitize_path(F.coalesce("filePath", "name"), extension).alias("path"), "name", "code")


def save_text(rows: DataFrame, path: str, text: str = "line", order: str | None = None) -> None:
    """Writes one text column, in order where one is given."""
    (rows.orderBy(order) if order else rows).select(text).write.mode("overwrite").text(path)
