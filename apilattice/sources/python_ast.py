"""API types and calls out of Python sources, by the standard ``ast`` module, one row a file in."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from apilattice.sources.files import spread

MEMBER = "array<struct<name: string, kind: string, sig: string, ret: string, doc: string, is_overload: boolean, deprecated: boolean>>"
TYPES = f"package_id string, rel_path string, name string, kind string, base string, supers array<string>, doc string, deprecated boolean, members {MEMBER}"
CALLS = "package_id string, file string, line int, call_ord int, receiver string, operation string"
VARIABLES = "package_id string, file string, name string, client string"


def _decorators(node) -> list[str]:
    return [ast.unparse(d.func if isinstance(d, ast.Call) else d).rpartition(".")[2] for d in node.decorator_list]


def _public(name: str) -> bool:
    return not name.startswith("_") or (name.startswith("__") and name.endswith("__"))


def _function(node, kind: str) -> dict:
    marks = _decorators(node)
    doc = ast.get_docstring(node)
    return {"name": node.name, "kind": "property" if "property" in marks else kind, "sig": f"({ast.unparse(node.args)})", "ret": ast.unparse(node.returns) if node.returns else None, "doc": doc.splitlines()[0][:150] if doc else None, "is_overload": "overload" in marks, "deprecated": "deprecated" in marks}


def file_types(text: str) -> list[dict]:
    """Public classes of a file; nothing for a file that does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in tree.body:
        if isinstance(node, ast.ClassDef) and _public(node.name):
            bases = [ast.unparse(b) for b in node.bases]
            members = [_function(n, "method") for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and _public(n.name)]
            members += [{"name": n.target.id, "kind": "property", "sig": None, "ret": ast.unparse(n.annotation), "doc": None, "is_overload": False, "deprecated": False} for n in node.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and _public(n.target.id)]
            overloaded = {m["name"] for m in members if m["is_overload"]}
            docs = {m["name"]: m["doc"] for m in members if not m["is_overload"]}
            members = [m | {"doc": m["doc"] or docs.get(m["name"])} for m in members if m["is_overload"] or m["name"] not in overloaded]
            doc = ast.get_docstring(node)
            out.append({"name": node.name, "kind": "class", "base": bases[0] if bases else None, "supers": bases[1:], "doc": doc.splitlines()[0][:150] if doc else None, "deprecated": "deprecated" in _decorators(node), "members": members})
    return out


def file_calls(text: str, factories: dict[str, str]) -> tuple[list[tuple], list[tuple]]:
    """(line, order, receiver, operation) of method calls, and (variable, client) by the last assignment.

    ``factories`` maps a constructor, or a method that returns a client, to the client.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], []
    variables: dict[str, str] = {}

    def client(node) -> str | None:
        if isinstance(node, ast.Await):
            return client(node.value)
        if isinstance(node, ast.Call):
            return factories.get(node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", ""))
        if isinstance(node, ast.Name):
            return variables.get(node.id)
        return factories.get(node.attr) if isinstance(node, ast.Attribute) else None

    calls = []
    for node in sorted(ast.walk(tree), key=lambda n: (getattr(n, "lineno", 0), getattr(n, "col_offset", 0))):
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and (found := client(node.value)):
            variables[node.targets[0].id] = found
        elif isinstance(node, (ast.AnnAssign, ast.arg)) and node.annotation is not None:
            name = node.target.id if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) else getattr(node, "arg", None)
            if name and (found := factories.get(ast.unparse(node.annotation).strip("'\""))):
                variables[name] = found
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                if isinstance(item.optional_vars, ast.Name) and (found := client(item.context_expr)):
                    variables[item.optional_vars.id] = found
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            base = node.func.value
            receiver = base.id if isinstance(base, ast.Name) else client(base) or ast.unparse(base)
            calls.append((node.lineno, len(calls), receiver, node.func.attr))
    return calls, sorted(variables.items())


def extract_types(files: DataFrame) -> DataFrame:
    """Types of files(package_id, rel_path, content); private modules are skipped but for ``__init__``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"package_id": p, "rel_path": r} | t for p, r, c in zip(pdf["package_id"], pdf["rel_path"], pdf["content"]) for t in file_types(c or "")]
            yield pd.DataFrame(rows, columns=["package_id", "rel_path", "name", "kind", "base", "supers", "doc", "deprecated", "members"])

    name = files.where(r"not regexp(rel_path, '(^|/)_[^/]*[.]py$') or regexp(rel_path, '(^|/)__init__[.]py$')")
    return spread(name.select("package_id", "rel_path", "content")).mapInPandas(parse, TYPES)


def extract_calls(files: DataFrame, factories: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(calls, variables) of sample files."""

    def parse(which: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(p, r, *x) for p, r, c in zip(pdf["package_id"], pdf["rel_path"], pdf["content"]) for x in file_calls(c or "", factories)[which]]
                names = (CALLS, VARIABLES)[which].replace(",", " ").split()[::2]
                yield pd.DataFrame(rows, columns=names)

        return run

    rows = spread(files.select("package_id", "rel_path", "content"))
    return rows.mapInPandas(parse(0), CALLS), rows.mapInPandas(parse(1), VARIABLES)
