"""What files say about names: declarations, imports and exports of TypeScript and Go, one row a statement.

A row is (package_id, file, kind, name, module, target):

* ``decl``: the file declares ``name``;
* ``import``: ``name`` stands for ``target`` of ``module`` (``*``: for the module itself);
* ``export``: the file gives out ``target`` as ``name``, its own or one of ``module``;
* ``star``: the file gives out all that ``module`` does;
* ``open``: the file sees all that ``module`` gives out (Go: the files of its folder).

``module`` is the path that the statement means, relative ones applied to the file's folder; names
of other packages stand as they are written, behind a colon.  Only the top level of a file counts.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilattice.sources.declarations import EXTENSIONS, _File
from apilattice.sources.files import spread

ROWS = "package_id string, file string, kind string, name string, module string, target string"
_QUOTED = r"""(?P<quote>['"`])(?P<module> *)(?P=quote)"""
_IMPORT = re.compile(rf"\bimport\s+(?:type\s+)?(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\*\s*as\s+(?P<space>[\w$]+)\s*|\{{(?P<names>[^{{}}]*)\}}\s*)?from\s*{_QUOTED}")
_EXPORT = re.compile(rf"\bexport\s+(?:type\s+)?(?:(?P<star>\*)\s*(?:as\s+(?P<space>[\w$]+)\s*)?|\{{(?P<names>[^{{}}]*)\}}\s*)(?:from\s*{_QUOTED})?")
_DECLARED = re.compile(r"(?P<export>\bexport\s+)?(?P<default>\bdefault\s+)?(?:\bdeclare\s+)?(?:\babstract\s+)?(?:\basync\s+)?\b(?:class|interface|enum|type|namespace|function\s*\*?|const\s+enum|const|let|var)\s+(?P<name>[\w$]+)")
_DEFAULT = re.compile(r"\bexport\s+default\s+(?P<name>[\w$]+)\s*(?:;|$)", re.M)
_GO_IMPORT = re.compile(r'^\s*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?"(?P<module> *)"', re.M)
_GO_DECLARED = re.compile(r"^(?:type|func|var|const)\s+(?P<name>\w+)", re.M)
_GO_GROUP = re.compile(r"^(?:type|var|const)\s*\((?P<body>[^()]*(?:\([^()]*\)[^()]*)*)\)", re.M)


def _pairs(names: str) -> Iterator[tuple[str, str]]:
    """(name there, name here) of a list in braces."""
    for part in names.split(","):
        words = part.split()
        words = words[1:] if words[:1] == ["type"] and len(words) > 1 and words[1] != "as" else words
        if words:
            yield words[0], words[-1]


def _path(file: str, module: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(file), module)) if module.startswith(".") else ":" + module


def _outside(text: str) -> list[tuple[int, int]]:
    """The stretches of blanked text that no braces enclose; those of import and export lists are no blocks."""
    out, depth, last = [], 0, 0
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            if depth == 0:
                out.append((last, m.start()))
            depth += 1
        else:
            depth = max(0, depth - 1)
            if depth == 0:
                last = m.end()
    return [*out, (last, len(text))] if depth == 0 else out


def typescript_names(text: str, file: str) -> list[tuple]:
    """(kind, name, module, target) of a TypeScript file."""
    blank = _File(text, "typescript").text
    top = _outside(blank)
    outside = lambda at: any(lo <= at < hi for lo, hi in top)
    module = lambda m: _path(file, text[m.start("module") : m.end("module")])
    out: list[tuple] = []
    for m in _IMPORT.finditer(blank):
        if outside(m.start()):
            if m["default"]:
                out.append(("import", m["default"], module(m), "default"))
            if m["space"]:
                out.append(("import", m["space"], module(m), "*"))
            out += [("import", here, module(m), there) for there, here in _pairs(m["names"] or "")]
    for m in _EXPORT.finditer(blank):
        if not outside(m.start()):
            continue
        at = module(m) if m["quote"] else None
        if m["star"]:
            out += [("export", m["space"], at, "*")] if m["space"] else [("star", None, at, None)] if at else []
        else:
            out += [("export", here, at, there) for there, here in _pairs(m["names"] or "")]
    for m in _DECLARED.finditer(blank):
        if outside(m.start()):
            out.append(("decl", m["name"], None, None))
            if m["export"]:
                out.append(("export", "default" if m["default"] else m["name"], None, m["name"]))
    out += [("export", "default", None, m["name"]) for m in _DEFAULT.finditer(blank) if outside(m.start()) and m["name"] not in ("class", "function", "abstract", "async", "interface")]
    return list(dict.fromkeys(out))


def go_names(text: str, file: str) -> list[tuple]:
    """(kind, name, module, target) of a Go file, which sees its folder whole."""
    blank = _File(text, "go").text
    folder = posixpath.dirname(file)
    out: list[tuple] = [("open", None, folder, None)]
    head = re.search(r"^(?:type|func|var|const)\b", blank, re.M)
    for m in _GO_IMPORT.finditer(blank, 0, head.start() if head else len(blank)):
        path = text[m.start("module") : m.end("module")]
        alias = m["alias"] or re.sub(r"/v\d+$", "", path).rpartition("/")[2]
        out.append(("open", None, ":" + path, None) if alias == "." else ("import", alias, ":" + path, "*"))
    names = [m["name"] for m in _GO_DECLARED.finditer(blank)]
    for m in _GO_GROUP.finditer(blank):
        names += re.findall(r"^[ \t]*(\w+)\b(?=[ \t]+\S|[ \t]*$)", m["body"], re.M)
    return list(dict.fromkeys(out + [("decl", n, None, None) for n in names]))


def names(files: DataFrame, language: str) -> DataFrame:
    """ROWS of files(package_id, rel_path, content) of one language; tests of Go are left out."""
    read = {"typescript": typescript_names, "go": go_names}[language]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, f, *r) for p, f, c in zip(pdf["package_id"], pdf["rel_path"], pdf["content"]) for r in read(c or "", f or "")]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ROWS.split(", ")])

    own = files.where(F.lower("rel_path").rlike(r"\.(ts|tsx|mts|cts)$") if language == "typescript" else F.lower("rel_path").endswith(EXTENSIONS[language]) & ~F.col("rel_path").endswith("_test.go"))
    return spread(own.select("package_id", "rel_path", "content")).mapInPandas(parse, ROWS)
