"""Package entry points: export maps of package.json, and the names a Python package exports."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from apilattice.functions.text import BUILTINS

MOST_DEPTH = 10
PYTHON_BUILTINS = frozenset(BUILTINS["python"])
EXPORTS = "package_id string, export_path string, conditions array<string>, target string"
SYMBOLS = "package_id string, name string, module string"


def flatten_exports(exports, most: int = MOST_DEPTH) -> list[tuple[str, list[str], str]]:
    """(export path, condition chain, file) of an ``exports`` value, at most ``most`` levels deep."""

    def walk(value, chain: list[str], depth: int) -> Iterator[tuple[list[str], str]]:
        if isinstance(value, str):
            yield chain, value
        elif isinstance(value, list):
            for v in value:
                yield from walk(v, chain, depth + 1)
        elif isinstance(value, dict) and depth < most:
            for k, v in value.items():
                yield from walk(v, [*chain, k], depth + 1)

    paths = exports if isinstance(exports, dict) and any(k.startswith(".") for k in exports) else {".": exports}
    return [(path, chain, target) for path, value in paths.items() for chain, target in walk(value, [], 0)]


def export_conditions(manifests: DataFrame) -> DataFrame:
    """Export rows of manifests(package_id, content); a manifest that is no JSON gives none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for package, content in zip(pdf["package_id"], pdf["content"]):
                try:
                    exports = json.loads(content or "").get("exports")
                except (ValueError, AttributeError):
                    continue
                rows += [(package, *r) for r in flatten_exports(exports)] if exports is not None else []
            yield pd.DataFrame(rows, columns=["package_id", "export_path", "conditions", "target"])

    return manifests.select("package_id", "content").mapInPandas(parse, EXPORTS)


def exported_names(text: str) -> list[tuple[str, str]]:
    """(name, module) that a Python package's ``__init__`` exports: its ``__all__`` and what it imports by name."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError):
        return []
    names: dict[str, str] = {}
    for node in body:
        if isinstance(node, ast.ImportFrom):
            for a in node.names:
                if a.name != "*" and not (a.asname or a.name).startswith("_"):
                    names[a.asname or a.name] = "." * node.level + (node.module or "")
        elif isinstance(node, ast.Assign) and any(isinstance(x, ast.Name) and x.id == "__all__" for x in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            for e in node.value.elts:
                if isinstance(e, ast.Constant) and isinstance(e.value, str):
                    names.setdefault(e.value, "")
    return sorted(names.items())


def entry_symbols(files: DataFrame) -> DataFrame:
    """(package_id, name, module) from the ``__init__`` files among files(package_id, rel_path, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *x) for p, c in zip(pdf["package_id"], pdf["content"]) for x in exported_names(c or "")]
            yield pd.DataFrame(rows, columns=["package_id", "name", "module"])

    top = files.where(r"rel_path rlike '(^|/)__init__[.]py$'")
    return top.select("package_id", "content").mapInPandas(parse, SYMBOLS).distinct()


def annotation_refs(text: str | None) -> list[str]:
    """Names that a Python annotation refers to: through generics, unions and quotes; dotted names whole, built-ins left out."""
    try:
        tree = ast.parse(text or "", mode="eval")
    except (SyntaxError, ValueError):
        return []
    out: list[str] = []

    def walk(node) -> None:
        if isinstance(node, ast.Name):
            out.append(node.id)
        elif isinstance(node, ast.Attribute):
            out.append(ast.unparse(node))
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            out.extend(annotation_refs(node.value))
        else:
            for child in ast.iter_child_nodes(node):
                walk(child)

    walk(tree.body)
    return [n for n in dict.fromkeys(out) if n not in PYTHON_BUILTINS]


def annotation_edges(annotations: DataFrame) -> DataFrame:
    """(package_id, name, ref) from annotations(package_id, name, annotation): what each name's annotations refer to, once each."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, n, r) for p, n, a in zip(pdf["package_id"], pdf["name"], pdf["annotation"]) for r in annotation_refs(a)]
            yield pd.DataFrame(rows, columns=["package_id", "name", "ref"])

    return annotations.select("package_id", "name", "annotation").mapInPandas(parse, "package_id string, name string, ref string").distinct()
