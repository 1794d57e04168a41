"""API types out of C#, Java, Go and TypeScript sources, as their declarations say it; one row a file in.

A file's comments and strings are blanked, its braces split it into statements, and the heads of
types and members are read: names, kinds, bases, signatures, parameters, results, documentation,
deprecation.  Only what users see is kept.  Nothing is resolved: a name stays as it is written,
inferred types stay unknown, conditional compilation counts as text.  A file whose braces do not
match is read as far as they do, and types nested deeper than Python's stack are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilattice.sources import schemas
from apilattice.sources.files import spread

MEMBER = f"struct<name: string, kind: string, sig: string, ret: string, doc: string, is_static: boolean, is_async: boolean, deprecated: boolean, modifiers: array<string>, params: array<{schemas.PARAM}>>"
TYPES = f"package_id string, rel_path string, container string, name string, kind string, base string, supers array<string>, embeds array<string>, entry_point boolean, deprecated boolean, doc string, `values` array<string>, members array<{MEMBER}>"
EXTENSIONS = {"dotnet": ".cs", "java": ".java", "go": ".go", "typescript": ".ts"}
#: Words that stand before a declaration.
MODIFIERS = frozenset("public protected private internal abstract final static sealed non-sealed strictfp partial readonly virtual override async extern unsafe new const volatile transient synchronized native default export declare required get set accessor".split())
#: Results that make a method of C# asynchronous.
ASYNC_RESULTS = ("Task", "ValueTask", "IAsyncEnumerable")
KINDS = {
    "java": re.compile(r"(@interface|class|interface|enum|record)\s+(\w+)"),
    "dotnet": re.compile(r"(record\s+struct|record\s+class|class|interface|struct|enum|record)\s+(\w+)"),
    "typescript": re.compile(r"(class|interface|enum|namespace)\s+([\w$]+)"),
}
SKIPPED = re.compile(r'"""(?s:.*?)"""|//[^\n]*|/\*(?s:.*?)\*/|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?s:\\.|[^`\\])*`')
MARK = re.compile(r"\s*(?:@(?!interface\b)[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?|\[(?:[^\[\]]|\[[^\]]*\])*\])")
WORD = re.compile(r"\s*([\w$-]+)(?=\s+[\w$@#*\[({<])")


class _File:
    """A text with comments and strings blanked, and its documentation comments by place."""

    def __init__(self, text: str, language: str, declared: bool = False) -> None:
        self.language, self.declared, self.docs = language, declared, []

        def blank(m: re.Match) -> str:
            s = m.group()
            if s.startswith(("//", "/*")):
                self.docs.append((m.start(), m.end(), s))
                return re.sub(r"[^\n]", " ", s)
            return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1]

        self.text = SKIPPED.sub(blank, text)

    def doc(self, lo: int, hi: int) -> str | None:
        """The text of the documentation comments that begin in [lo, hi)."""
        lines = []
        for start, end, s in self.docs:
            if lo <= start < hi and (s.startswith(("/**", "///")) or self.language == "go"):
                for line in s.removeprefix("/**").removesuffix("*/").split("\n"):
                    lines.append(re.sub(r"^\s*(?:///?|\*)?\s?", "", line).strip())
        return re.sub(r"\s+", " ", re.sub(r"</?\w+[^>]*>", " ", " ".join(lines))).strip() or None

    def end_of(self, at: int, hi: int) -> int:
        """Where the brace that opens at ``at`` closes."""
        depth = 0
        for m in re.compile(r"[{}]").finditer(self.text, at, hi):
            depth += 1 if m.group() == "{" else -1
            if depth == 0:
                return m.start()
        return hi

    def statements(self, lo: int, hi: int, lines: bool = False) -> Iterator[tuple[int, int, tuple[int, int] | None]]:
        """(start, end of the head, body) of what stands in [lo, hi); lines: a line that is complete ends a statement."""
        start, depth, at = lo, 0, lo
        token = re.compile(r"[{}()\[\];\n]")
        while m := token.search(self.text, at, hi):
            c, at = m.group(), m.end()
            if c in "([":
                depth += 1
            elif c in ")]":
                depth = max(0, depth - 1)
            elif c == "{" and depth == 0:
                close = self.end_of(m.start(), hi)
                yield start, m.start(), (m.end(), close)
                start = at = close + 1
            elif c == "{":
                depth += 1
            elif c == "}":
                depth = max(0, depth - 1)
            elif c == ";" and depth == 0:
                yield start, m.start(), None
                start = at
            elif c == "\n" and lines and depth == 0:
                head, rest = self.text[start : m.start()].strip(), self.text[m.end() : hi].lstrip()[:1]
                if head and head[-1] not in ",|&=:<(+-." and rest not in tuple("{|&=.:?)<"):
                    yield start, m.start(), None
                    start = at
        if self.text[start:hi].strip():
            yield start, hi, None


def _split(text: str, by: str = ",") -> list[str]:
    """Parts between separators outside brackets."""
    out, depth, last = [], 0, 0
    for k, c in enumerate(text):
        if c in "(<[{":
            depth += 1
        elif c in ")]}" or (c == ">" and text[k - 1 : k] not in ("=", "-")):
            depth -= 1
        elif c == by and depth == 0:
            out.append(text[last:k])
            last = k + 1
    return [p.strip() for p in [*out, text[last:]] if p.strip()]


def _tidy(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _head(text: str) -> tuple[list[str], list[str], str]:
    """(annotations, modifiers, rest) of a declaration's head."""
    marks, words = [], []
    while True:
        m = MARK.match(text)
        if m:
            marks.append(_tidy(m.group()))
            text = text[m.end() :]
            continue
        m = WORD.match(text)
        if not m or m[1] not in MODIFIERS:
            return marks, words, text.strip()
        words.append(m[1])
        text = text[m.end() :]


def _paren(text: str) -> tuple[int, int] | None:
    """The first parentheses outside angle brackets."""
    depth = 0
    for k, c in enumerate(text):
        if c == "<":
            depth += 1
        elif c == ">" and text[k - 1 : k] not in ("=", "-"):
            depth -= 1
        elif c == "(" and depth <= 0:
            inner = 0
            for j in range(k, len(text)):
                inner += (text[j] in "([{") - (text[j] in ")]}")
                if inner == 0:
                    return k, j
            return None
    return None


def _params(text: str, language: str) -> list[dict]:
    out: list[dict] = []
    for part in _split(text):
        _, _, part = _head(part + " ") if language in ("java", "dotnet") else ([], [], part)
        part, _, default = part.partition("=") if language != "go" and "=>" not in part else (part, "", "")
        part, modifier = _tidy(part), None
        if language == "typescript":
            m = re.match(r"((?:public|private|protected|readonly)\s+)*(\.\.\.)?([\w$]+)(\?)?\s*(?::\s*(.*))?$", part, re.S)
            name, kind, modifier = (m[3], m[5], "..." if m[2] else "?" if m[4] else None) if m else (part, None, None)
        elif language == "go":
            name, _, kind = part.partition(" ")
        else:
            m = re.match(r"(?:(ref|out|in|params|this|final)\s+)?(.*?)([\w$@]+)$", part, re.S)
            modifier, kind, name = (m[1], m[2].strip(), m[3]) if m else (None, part, "")
        out.append({"name": name, "type": kind or None, "default": default.strip() or None, "modifier": modifier})
    if language == "go":  # a, b int: the type comes with the last name; without any name all are types
        if all(p["type"] is None for p in out):
            return [{"name": "", "type": p["name"], "default": None, "modifier": None} for p in out]
        for p, after in zip(reversed(out[:-1]), reversed(out)):
            p["type"] = p["type"] or after["type"]
    return out


def _old(marks: list[str], doc: str | None, language: str) -> bool:
    if language in ("dotnet", "java"):
        return any(re.search(r"(?:^@|[\[,.\s])(?:Obsolete|Deprecated)\b", m) for m in marks)
    return bool(doc) and bool(re.search(r"\bDeprecated:" if language == "go" else r"@deprecated\b", doc))


def _visible(words: list[str], name: str, language: str, open_: bool) -> bool:
    if language == "go":
        return name[:1].isupper()
    if language == "typescript":
        return not {"private", "protected"} & set(words) and not name.startswith("#")
    wanted = {"public", "protected"} if language == "java" else {"public"}
    return bool(wanted & set(words)) or (open_ and not {"private", "internal", "protected"} & set(words))


def _special(rest: str) -> tuple[str, str, str | None, str | None] | None:
    """(name, kind, result, parameters) of an operator, a conversion, an indexer or an event of C#."""
    if m := re.match(r"(?s)(?:(implicit|explicit)|(.+?))\s+operator\s+(?:checked\s+)?([^\s(]+|[^(]+?)\s*(\(.*)$", rest):
        at = _paren(m[4])
        inside = m[4][at[0] + 1 : at[1]] if at else ""
        return (f"{m[1]} operator {_tidy(m[3])}", "operator", m[3], inside) if m[1] else (f"operator {m[3]}", "operator", m[2], inside)
    if m := re.match(r"(?s)(.+?)\s+this\s*\[(.*)\]$", rest):
        return "this[]", "indexer", m[1], m[2]
    if m := re.match(r"(?s)event\s+(.+?)\s+(\w+)\s*(?:=.*)?$", rest):
        return m[2], "event", m[1], None
    return None


def _member(f: _File, lo: int, hi: int, body: bool, owner: str, open_: bool) -> dict | None:
    """What a statement in a type's body declares, if users see it."""
    language = f.language
    marks, words, rest = _head(f.text[lo:hi] + " ")
    rest = re.sub(r"\bthrows\b.*$", "", rest.split("=>")[0] if language == "dotnet" else rest, flags=re.S).strip()
    doc = f.doc(lo, hi)
    made = {"doc": doc, "is_static": "static" in words, "is_async": "async" in words, "deprecated": _old(marks, doc, language), "modifiers": words, "params": []}
    at = _paren(rest)
    if language == "dotnet" and (found := _special(rest)):
        name, kind, ret, inside = found
    elif language == "typescript":
        equals = rest.find("=")
        if at and (equals < 0 or at[0] < equals) and (m := re.match(r"(?:\*\s*)?([\w$]*)\??\s*(?:<.*>)?$", rest[: at[0]].strip(), re.S)):
            tail = rest[at[1] + 1 :].strip()
            name, kind = m[1] or "()", "ctor" if m[1] == "constructor" else "property" if "get" in words else "method"
            ret, inside = tail[1:].strip() if tail.startswith(":") else None, rest[at[0] + 1 : at[1]]
        elif m := re.match(r"([\w$]+)[?!]?\s*(?::\s*([^=]*))?(?:=|$)", rest, re.S):
            name, kind, ret, inside = m[1], "property", m[2], None
        else:
            return None
    elif at and ("=" not in rest[: at[0]]):
        before = re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>\s*$", "", rest[: at[0]].rstrip()).rstrip()
        m = re.match(r"(?s)(.*?)([\w$]+)$", re.sub(r"^<(?:[^<>]|<[^<>]*>)*>\s*", "", before))
        if not m:
            return None
        name, ret, inside = m[2], m[1].strip(), rest[at[0] + 1 : at[1]]
        kind = "ctor" if not ret and name == owner else "operator" if ret.endswith("operator") else "method"
        if not ret and kind != "ctor":
            return None
    else:
        m = re.match(r"(?s)(.+?)\s*([\w$]+)\s*(?:=.*)?$", rest)
        if not m:
            return None
        name, ret, inside = m[2], m[1], None
        kind = "property" if (body and "=" not in rest) or (language == "dotnet" and "=>" in f.text[lo:hi]) else "field"
        if language == "dotnet" and kind == "field":  # of fields only those that never change are shown
            if "const" in words:
                kind = "const"
            elif not {"static", "readonly"} <= set(words):
                return None
    if not _visible(words, name, language, open_):
        return None
    if inside is not None:
        made |= {"params": _params(inside, language)}
    if language == "dotnet" and kind == "method":
        made["is_async"] |= ret.partition("<")[0].rpartition(".")[2].strip() in ASYNC_RESULTS
    round_, square = ("[", "]") if kind == "indexer" else ("(", ")")
    return made | {"name": name, "kind": kind, "sig": None if inside is None else f"{round_}{_tidy(inside)}{square}", "ret": _tidy(ret) if ret else None}


def _bases(tail: str, kind: str, language: str) -> tuple[str | None, list[str]]:
    """(base, further supers) that a type's head names."""
    tail = re.sub(r"^\s*(?:<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)?\s*(?:\((?:[^()]|\([^()]*\))*\))?", "", tail, count=1)
    if language == "dotnet":
        names = _split(re.sub(r"\bwhere\b.*$", "", tail, flags=re.S).partition(":")[2])
        names = [re.sub(r"\(.*$", "", n, flags=re.S).strip() for n in names]
        first = names and kind != "interface" and not re.match(r"I[A-Z]", names[0]) and kind != "struct"
        return (names[0], names[1:]) if first else (None, names)
    part = lambda word: _split(m[1]) if (m := re.search(rf"\b{word}\s+(.*?)(?=\bimplements\b|\bpermits\b|\bextends\b|$)", tail, re.S)) else []
    up, others = part("extends"), part("implements")
    return (None, up + others) if kind == "interface" else ((up or [None])[0], others)


def _braced(f: _File, lo: int, hi: int, container: str, outer: str, open_: bool, out: list[dict]) -> None:
    """Types among the statements of [lo, hi), and of what they nest."""
    language, loose = f.language, []
    for start, end, body in f.statements(lo, hi, language == "typescript"):
        marks, words, rest = _head(f.text[start:end] + " ")
        if language == "dotnet" and (m := re.match(r"namespace\s+([\w.]+)", rest)):
            container = m[1]
            if body:
                _braced(f, *body, container, outer, open_, out)
            continue
        if language == "java" and (m := re.match(r"package\s+([\w.]+)", rest)):
            container = m[1]
            continue
        shown = "export" in words or bool(outer) or f.declared if language == "typescript" else _visible(words, "", language, open_)
        m = KINDS[language].match(rest)
        doc = f.doc(start, end)
        row = {"container": container, "doc": doc, "deprecated": _old(marks, doc, language), "embeds": [], "supers": [], "base": None, "values": [], "entry_point": shown and not outer, "members": []}
        if m and (body or language == "dotnet"):
            kind, name = re.sub(r"\s+", " ", m[1]).removeprefix("@"), m[2]
            if not shown:
                continue
            if kind == "namespace":
                _braced(f, *body, f"{container}.{name}".strip("."), "", open_, out)
                continue
            base, supers = _bases(rest[m.end() :], kind, language)
            row |= {"name": outer + name, "kind": kind, "base": base, "supers": supers}
            out.append(row)
            if body:
                inner = body
                if kind == "enum":
                    stop = f.text.find(";", *body)
                    names = _split(f.text[body[0] : stop if 0 <= stop < body[1] else body[1]])
                    row["values"] = [v[0] for n in names if (v := re.match(r"[\w$]+", _head(n + " ")[2]))]
                    inner = (stop + 1, body[1]) if 0 <= stop < body[1] and language == "java" else (body[1], body[1])
                everyone = kind in ("interface", "@interface") or language == "typescript"
                for s, e, b in f.statements(*inner, language == "typescript"):
                    if KINDS[language].match(_head(f.text[s:e] + " ")[2]) and language != "typescript":
                        continue
                    if found := _member(f, s, e, b is not None, name, everyone):
                        row["members"].append(found)
                if language != "typescript":
                    _braced(f, *inner, container, f"{outer}{name}.", everyone, out)
            if kind.startswith("record") and (at := _paren(rest[m.end() :])):
                for p in _params(rest[m.end() :][at[0] + 1 : at[1]], language):
                    row["members"].append({"name": p["name"], "kind": "property" if language == "dotnet" else "field", "sig": None, "ret": p["type"], "doc": None, "is_static": False, "is_async": False, "deprecated": False, "modifiers": ["public"], "params": []})
        elif language == "typescript" and shown and not outer:
            if m := re.match(r"type\s+([\w$]+)", rest):
                out.append(row | {"name": m[1], "kind": "type"})
            elif m := re.match(r"(async\s+)?function\s*\*?\s*", rest):
                if found := _member(f, start + f.text[start:end].index("function") + 8, end, body is not None, "", True):
                    loose.append(found | {"kind": "function", "doc": doc, "is_async": "async" in words or bool(m[1])})
    if loose:
        out.append({"container": container, "name": "", "kind": "module", "doc": None, "deprecated": False, "embeds": [], "supers": [], "base": None, "values": [], "entry_point": True, "members": loose})


def _go(f: _File, out: list[dict]) -> None:
    package = (re.search(r"(?m)^\s*package\s+(\w+)", f.text) or [None, ""])[1]
    types: dict[str, dict] = {}
    row = lambda name, kind, doc: {"container": package, "name": name, "kind": kind, "doc": doc, "deprecated": _old([], doc, "go"), "embeds": [], "supers": [], "base": None, "values": [], "entry_point": True, "members": []}
    member = lambda name, kind, sig, ret, doc: {"name": name, "kind": kind, "sig": None if sig is None else f"({_tidy(sig)})", "ret": _tidy(ret) or None, "doc": doc, "is_static": False, "is_async": False, "deprecated": _old([], doc, "go"), "modifiers": [], "params": _params(sig, "go") if sig is not None else []}

    def typed(lo: int, head: str, body: tuple[int, int] | None) -> None:
        m = re.match(r"\s*(\w+)\s*(?:\[[^\]]*\]\s*)?(=?)\s*(struct|interface)?(.*)", head, re.S)
        if not m or not m[1][:1].isupper():
            return
        made = types[m[1]] = row(m[1], m[3] or ("alias" if m[2] else "type"), f.doc(lo, lo + len(head)))
        if not body or not m[3]:
            made["base"] = _tidy(m[4]) or None
            return
        for s, e, _ in f.statements(*body, True):
            text, doc = _tidy(re.sub(r"`[^`]*`", "", f.text[s:e])), f.doc(s, e)
            if call := re.match(r"(\w+)\s*(\(.*)", text, re.S):
                at = _paren(call[2])
                if m[3] == "interface" and at and call[1][:1].isupper():
                    made["members"].append(member(call[1], "method", call[2][at[0] + 1 : at[1]], call[2][at[1] + 1 :], doc))
            elif field := re.match(r"(\w+(?:\s*,\s*\w+)*)\s+(\S.*)", text, re.S):
                made["members"] += [member(n.strip(), "field", None, field[2], doc) for n in field[1].split(",") if n.strip()[:1].isupper()]
            elif text:
                made["embeds"].append(text.lstrip("*"))

    calls, free, before = [], [], 0
    for start, end, body in f.statements(0, len(f.text), True):
        head = f.text[start:end]
        if m := re.match(r"\s*type\b", head):
            if (group := re.match(r"\s*type\s*\(", head)) and head.rstrip().endswith(")"):
                inner = start + group.end()
                for s, e, b in f.statements(inner, start + head.rindex(")"), True):
                    typed(s, f.text[s:e], b)
            else:
                typed(start + m.end(), head[m.end() :], body)
                if made := types.get((re.match(r"\s*(\w+)", head[m.end() :]) or [None, ""])[1]):
                    made["doc"] = f.doc(before, start + m.end())
                    made["deprecated"] = _old([], made["doc"], "go")
        elif m := re.match(r"\s*func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\s*(?=\()", head):
            at = _paren(head[m.end() :])
            if at and m[2][:1].isupper():
                text = head[m.end() :]
                found = member(m[2], "method" if m[1] else "function", text[at[0] + 1 : at[1]], text[at[1] + 1 :], f.doc(before, start + m.end()))
                (calls if m[1] else free).append((m[1], found))
        before = body[1] if body else end
    for owner, found in calls:
        if owner in types:
            types[owner]["members"].append(found)
        elif owner[:1].isupper():  # declared in another file of the package
            types[owner] = row(owner, "part", None) | {"members": [found]}
    out += types.values()
    if free:
        out.append(row("", "module", None) | {"members": [found for _, found in free]})


def file_types(text: str, language: str, declared: bool = False) -> list[dict]:
    """The types of a source file that users see; free functions come as one type without a name.

    declared: the file only declares (``.d.ts``), so that nothing needs an ``export``.
    """
    f, out = _File(text, language, declared), []
    try:
        if language == "go":
            _go(f, out)
        else:
            _braced(f, 0, len(f.text), "", "", False, out)
    except RecursionError:  # types nested some hundreds deep
        pass
    return out


def extract_types(files: DataFrame, language: str) -> DataFrame:
    """Types of files(package_id, rel_path, content) of one language; tests of Go and files of other extensions are left out."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0].strip("`") for c in ("package_id", "rel_path", "container", "name", "kind", "base", "supers", "embeds", "entry_point", "deprecated", "doc", "values", "members")]
        for pdf in batches:
            rows = [{"package_id": p, "rel_path": r} | t for p, r, c in zip(pdf["package_id"], pdf["rel_path"], pdf["content"]) for t in file_types(c or "", language, (r or "").endswith(".d.ts"))]
            yield pd.DataFrame(rows, columns=names)

    own = files.where(F.lower("rel_path").endswith(EXTENSIONS[language]) & ~F.col("rel_path").endswith("_test.go"))
    return spread(own.select("package_id", "rel_path", "content")).mapInPandas(parse, TYPES)


def as_index(types: DataFrame) -> DataFrame:
    """An API index (as :func:`apilattice.sources.index.parse_indexes` gives it) of extracted types.

    Parts of one type (partial classes, Go methods of other files) are joined; the first place in
    path order that declares it tells the rest.  A package is one row.  What types refer to comes with
    ``referenced_types`` of :func:`apilattice.operators.resolution.with_references`, where that column is there.
    """
    keys = ["package_id", "container", "name"]
    if "referenced_types" not in types.columns:
        types = types.withColumn("referenced_types", F.array().cast("array<string>"))
    order = F.struct((F.col("kind") == "part").alias("part"), "rel_path")
    first = types.groupBy(*keys).agg(F.min_by(F.struct("kind", "base", "doc"), order).alias("head"), F.bool_or("entry_point").alias("entry_point"), F.bool_or("deprecated").alias("deprecated"), F.sort_array(F.collect_list(F.struct("rel_path", "supers", "embeds", "values", "members", "referenced_types"))).alias("parts"))
    flat = lambda c: F.flatten(F.col(f"parts.{c}"))
    null = lambda kind: F.lit(None).cast(kind)
    member = lambda m: F.struct(m["name"].alias("name"), null("string").alias("id"), m["kind"].alias("kind"), m["sig"].alias("sig"), m["ret"].alias("ret"), m["doc"].alias("doc"), m["is_static"].alias("is_static"), m["is_async"].alias("is_async"), m["deprecated"].alias("deprecated"), m["modifiers"].alias("modifiers"), m["params"].alias("params"))
    free = lambda m: F.struct(m["name"].alias("name"), null("string").alias("id"), m["sig"].alias("sig"), m["ret"].alias("ret"), m["doc"].alias("doc"), m["deprecated"].alias("deprecated"))
    strings = "array<string>"
    type_ = F.struct("name", null("string").alias("id"), F.when(F.col("head.kind") == "part", "type").otherwise(F.col("head.kind")).alias("kind"), F.col("head.base").alias("base"), F.array_distinct(flat("supers")).alias("supers"), F.array_distinct(flat("embeds")).alias("embeds"), "entry_point", "deprecated", null("boolean").alias("is_error"), F.col("head.doc").alias("doc"), flat("values").alias("values"), F.array_distinct(flat("referenced_types")).alias("referenced_types"), F.transform(flat("members"), member).alias("members"))
    rows = first.select("package_id", "container", F.when(F.col("name") != "", type_).alias("type"), F.when(F.col("name") == "", F.transform(flat("members"), free)).alias("free"))
    boxes = rows.groupBy("package_id", "container").agg(F.sort_array(F.collect_list("type")).alias("types"), F.flatten(F.collect_list("free")).alias("functions"))
    box = F.struct(F.col("container").alias("name"), null("string").alias("condition"), null(strings).alias("condition_chain"), null("string").alias("export_path"), "types", "functions")
    made = boxes.groupBy("package_id").agg(F.sort_array(F.collect_list(box)).alias("containers"))
    return made.select(F.col("package_id").alias("package"), null("string").alias("version"), "containers", null(f"array<{schemas.DEPENDENCY}>").alias("dependencies"), null(f"array<{schemas.DIAGNOSTIC}>").alias("diagnostics"))
