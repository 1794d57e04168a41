"""Calls and the flow of values in Go, Java and TypeScript samples, one row an expression.

A receiver is a root and steps from it: ``hub.widgets()[0].session()`` is ``hub`` with ``widgets()``, ``[]`` and
``session()``.  A root is a variable, that is the row of the value which reaches this place, a type (made,
declared or named), or nothing for what a module gives out.  Which value reaches a place is told here,
by blocks: the innermost declaration of the name that the place lies in, then its last assignment
before; a declared type comes before a value.  Variables of loops and of callbacks over containers
step into their elements.  What the steps yield is for :mod:`apilattice.operators.receivers` to join.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilattice.sources.declarations import EXTENSIONS, _File, _params, _split
from apilattice.sources.files import spread

ROWS = "package_id string, file string, id int, kind string, root_kind string, root string, steps array<string>, line int, call_ord int, operation string"
#: Words that are no names of values, and calls that hand a container's elements to a function.
KEYWORDS = frozenset("if else for while do switch case return throw new await yield typeof instanceof in of catch try finally function func go defer select range const let var class interface enum extends implements import export from package void super delete async static public private protected final readonly default break continue goto fallthrough map chan struct type null nil true false".split())
EACH = frozenset("forEach map filter find some every flatMap forEachOrdered peek anyMatch allMatch noneMatch findLast".split())
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_TYPE = r"[A-Za-z_$][\w$.]*(?:<(?:[^<>;{}]|<(?:[^<>;{}]|<[^<>;{}]*>)*>)*>)?(?:\[\])*"


@dataclass
class _Value:
    """What a name is bound to from ``at`` on, inside [lo, hi)."""

    name: str
    at: int
    lo: int
    hi: int
    root: tuple[str, str, int] | None = None  # (kind, name, place)
    steps: tuple[str, ...] = ()
    declares: bool = True
    declared: str | None = None
    id: int = -1


class _Flow:
    def __init__(self, text: str, language: str) -> None:
        self.language, self.raw = language, text
        self.text = t = _File(text, language).text
        self.lines = [m.start() for m in re.finditer("\n", t)]
        self.close: dict[int, int] = {}
        self.blocks: list[tuple[int, int]] = []
        stack: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", t):
            if m.group() in "({[":
                stack.append(m.start())
            elif stack and t[stack[-1]] + m.group() in ("()", "{}", "[]"):
                self.close[stack.pop()] = m.start()
        self.open = {b: a for a, b in self.close.items()}
        self.braces = sorted(a for a in self.close if t[a] == "{")
        self.values: list[_Value] = []
        self.modules = self._modules()

    def _modules(self) -> set[str]:
        if self.language == "typescript":
            return set(re.findall(r"\*\s*as\s+([\w$]+)", self.text))
        if self.language == "java":
            return set()
        found = re.finditer(r'^\s*(?:import\s+)?(?:([\w.]+)\s+)?"( +)"\s*$', self.text, re.M)
        return {m[1] or re.sub(r"/v\d+$", "", self.raw[m.start(2) : m.end(2)]).rpartition("/")[2].replace("-", "_") for m in found}

    def skip(self, at: int) -> int:
        while at < len(self.text) and self.text[at].isspace():
            at += 1
        return at

    def block(self, at: int) -> tuple[int, int]:
        """The innermost braces around a place."""
        k = bisect_right(self.braces, at) - 1
        while k >= 0:
            lo = self.braces[k]
            if lo < at < self.close[lo]:
                return lo, self.close[lo]
            k -= 1
        return 0, len(self.text)

    def body(self, at: int) -> tuple[int, int]:
        """The block or statement that follows a header."""
        at = self.skip(at)
        if self.text[at : at + 2] in ("=>", "->"):
            at = self.skip(at + 2)
        if self.text[at : at + 1] == "{" and at in self.close:
            return at, self.close[at]
        depth_end, k = self.block(at)[1], at
        while k < depth_end:
            c = self.text[k]
            if k in self.close:
                k = self.close[k]
            elif c in ";)]}," or (c == "\n" and self.language == "go"):
                break
            k += 1
        return at, k

    def chain(self, at: int) -> tuple[tuple[str, str, int] | None, tuple[str, ...], int, list[tuple[int, int]]]:
        """(root, steps, end, places) of the expression at ``at``; places: (step number, place) of each call."""
        t, at = self.text, self.skip(at)
        while t[at : at + 1] in ("*", "&", "!"):
            at = self.skip(at + 1)
        root: tuple[str, str, int] | None = None
        steps: list[str] = []
        calls: list[tuple[int, int]] = []
        if t[at : at + 1] == "(" and at in self.close:
            inner, some, end, _ = self.chain(at + 1)
            after = self.close[at] + 1
            cast = re.compile(rf"\s*({_TYPE})\s*$").match(t, at + 1, self.close[at]) if self.language == "java" else None
            if cast and re.match(r"\s*[\w(]", t[after : after + 40]):
                _, _, end, _ = self.chain(after)
                return ("type", cast[1], at), (), end, []
            told = re.compile(rf"\s+as\s+({_TYPE})\s*$").match(t, end, self.close[at]) if self.language == "typescript" else None
            if told:
                inner, some = ("type", told[1], at), ()
            elif t[end : self.close[at]].strip():
                inner, some = None, ()
            root, steps, at = inner, list(some), after
        else:
            m = _NAME.match(t, at)
            if not m:
                return None, (), at, []
            word, end = m.group(), m.end()
            if word in ("await", "yield", "return", "range"):
                return self.chain(end)
            if word == "new" and self.language == "go":
                made = re.compile(r"\(\s*\*?([\w.]+)\s*\)").match(t, end)
                root, at = (("type", made[1], at), made.end()) if made else (None, end)
            elif word == "new":
                made = re.compile(rf"\s*({_TYPE})\s*").match(t, end)
                if not made:
                    return None, (), end, []
                root, at = ("type", made[1], at), made.end()
                at = self.close.get(at, at - 1) + 1 if t[at : at + 1] == "(" else at
            elif word in ("this", "self") and (m := re.compile(r"\s*\.\s*([\w$]+)(?!\s*\()").match(t, end)) and not t[m.end() : m.end() + 1].isalnum():
                root, at = ("name", f"this.{m[1]}", at), m.end()
            elif word in KEYWORDS:
                return None, (), end, []
            else:
                after = self.skip(end)
                generic = re.compile(r"<[^<>;{}()]*(?:<[^<>;{}()]*>)?[^<>;{}()]*>(?=\()").match(t, end)
                after = generic.end() if generic else after
                composite = re.compile(r"((?:\w+\.)?[A-Z]\w*)\{").match(t, at) if self.language == "go" else None
                if composite:
                    root, at = ("type", composite[1], at), self.close.get(composite.end() - 1, composite.end() - 1) + 1
                elif t[after : after + 1] == "(" and after in self.close:
                    root, steps, at = ("free", "", at), [f"{word}()"], self.close[after] + 1
                else:
                    root, at = ("name", word, at), end
        while True:
            m = re.compile(r"\s*(?:\?|!)?\.\s*(?:\(\s*([*\w.]+)\s*\)|([A-Za-z_$][\w$]*))|\s*!(?!=)(?=[.\[])").match(t, at)
            if m and m[1] and self.language == "go":  # a type assertion
                root, steps, at = ("type", m[1].lstrip("*"), at), [], m.end()
            elif m and m[2]:
                at = m.end()
                generic = re.compile(r"<[^<>;{}()]*(?:<[^<>;{}()]*>)?[^<>;{}()]*>(?=\()").match(t, at)
                after = generic.end() if generic else self.skip(at) if self.language != "go" else at
                if t[after : after + 1] == "(" and after in self.close:
                    calls.append((len(steps), m.start(2)))
                    steps.append(f"{m[2]}()")
                    at = self.close[after] + 1
                else:
                    steps.append(m[2])
            elif m and m[0].strip():
                at = m.end()
            elif t[at : at + 1] == "[" and at in self.close:
                if self.language != "go" or ":" not in t[at : self.close[at]]:
                    steps.append("[]")
                at = self.close[at] + 1
            else:
                return root, tuple(steps), at, calls

    def bind(self, name: str, at: int, scope: tuple[int, int], expr: int | None = None, declared: str | None = None, element: bool = False, declares: bool = True, field: str | None = None) -> int:
        """Binds a name to the expression at ``expr`` or to a declared type; the place behind it."""
        made, end = _Value(name, at, *scope, declares=declares, declared=declared), at
        if expr is not None:
            made.root, made.steps, end, _ = self.chain(expr)
            made.at = max(at, end)  # a value does not reach its own expression
            if field is not None:
                made.steps += (field,)
            if element:
                made.steps += ("[]",)
        self.values.append(made)
        return end

    def parameters(self, inside: str, scope: tuple[int, int]) -> None:
        for p in _params(inside, self.language):
            name = p["name"].strip("?. ")
            if _NAME.fullmatch(name or "") and (self.language != "go" or p["type"]):
                self.bind(name, scope[0], scope, declared=p["type"])

    def bindings(self) -> None:
        {"typescript": self._typescript, "java": self._java, "go": self._go}[self.language]()
        self._callbacks()
        for k, v in enumerate(self.values):
            v.id = k

    def _callbacks(self) -> None:
        """Untyped parameters of functions given to a call: elements if the call hands out those of a container."""
        if self.language == "go":
            return
        for m in re.finditer(r"\(\s*(?:async\s+)?(?:\(\s*([\w$]+)\s*(?:,\s*[\w$]+\s*)*\)|([\w$]+))\s*(?:=>|->)", self.text):
            name, scope = m[1] or m[2], self.body(m.end())
            call = re.search(r"\.\s*([\w$]+)\s*$", self.text[: m.start()])
            at = self._start(call.start()) if call and call[1] in EACH else None
            made = _Value(name, scope[0], *scope)
            if at is not None:
                root, steps, _, calls = self.chain(at)
                stop = next((k for k, place in calls if place == call.start(1)), None)
                if stop is not None:
                    steps = steps[:stop]
                    while steps and steps[-1] in ("stream()", "values()", "parallelStream()", *(f"{e}()" for e in ("filter", "peek"))):
                        steps = steps[:-1]
                    made.root, made.steps = root, (*steps, "[]")
            self.values.append(made)

    def _start(self, at: int) -> int | None:
        """Where the chain begins whose part ends before ``at``."""
        t = self.text
        while True:
            end = at
            while end and t[end - 1].isspace():
                end -= 1
            if end and t[end - 1] in ")]" and end - 1 in self.open:
                at = self.open[end - 1]
                if t[end - 1] == ")" and not re.search(r"[\w$>]\s*$", t[:at]):
                    return at
                if m := re.search(r"<[^<>(){};]*>$", t[:at]):
                    at = m.start()
                continue
            m = re.search(r"[A-Za-z_$][\w$]*$", t[:end])
            if not m:
                return None
            before = re.search(r"(?:\?|!)?\.\s*$", t[: m.start()].rstrip() + "") if t[: m.start()].rstrip().endswith(".") else None
            if before is None:
                made = re.search(r"\bnew\s+(?:[\w$]+\.)*$", t[: m.start()])
                return made.start() if made else m.start()
            at = before.start()

    def _typescript(self) -> None:
        t = self.text
        for m in re.finditer(r"\b(?:const|let|var)\s+(?:(?P<name>[\w$]+)\s*(?::\s*(?P<type>[^=;\n]+?))?\s*(?P<op>=(?!=|>)|;|\n|\bof\b|\bin\b)|(?P<list>[\{\[][^{}\[\]]*[\}\]])\s*(?::[^=;]+?)?\s*(?P<op2>=|\bof\b))", t):
            head = re.search(r"\bfor\s*(?:await\s*)?\(\s*$", t[: m.start()])
            paren = t.rindex("(", 0, m.start()) if head else None
            scope = self.body(self.close.get(paren, m.end()) + 1) if head else self.block(m.start())
            if m["name"]:
                loop = m["op"] in ("of", "in")
                self.bind(m["name"], scope[0] if loop else m.end(), scope, None if m["op"] in (";", "\n", "in") else m.end(), m["type"], element=loop)
                if loop:
                    self.values[-1].at = scope[0]
            else:
                for part in _split(m["list"][1:-1]):
                    source, _, name = part.partition("=")[0].partition(":")
                    name = (name or source).strip(". ")
                    if _NAME.fullmatch(name):
                        known = m["list"][0] == "{" and m["op2"] == "=" and "..." not in part
                        self.bind(name, m.end(), scope, m.end() if known else None, field=source.strip())
        for m in re.finditer(r"\(", t):
            close = self.close.get(m.start())
            after = re.compile(r"\s*(?::\s*[^={};]+?)?\s*(\{|=>)").match(t, close + 1) if close else None
            before = re.search(r"([\w$]+)\s*(?:<[^<>()]*>)?$", t[: m.start()])
            if after and not (before and before[1] in ("if", "for", "while", "switch", "catch", "with")):
                scope = self.body(after.start(1))
                inside = t[m.end() : close]
                self.parameters(inside, scope)
                if before and before[1] == "constructor":
                    for p in re.finditer(r"\b(?:private|public|protected|readonly)\s+(?:readonly\s+)?([\w$]+)\s*\??\s*:\s*([^,=]+)", inside):
                        around = self.block(m.start())
                        self.bind(f"this.{p[1]}", around[0], around, declared=p[2].strip())
        for lo, hi in self._classes():
            for m in re.finditer(r"(?<=[{};\n])\s*(?:(?:private|public|protected|readonly|static|declare)\s+)*#?([\w$]+)\s*[?!]?\s*(?::\s*([^=;(){}\n]+?))?\s*(=(?!=|>)|;|\n)", t[lo:hi]):
                if self.block(lo + m.start(1))[0] == lo and (m[2] or m[3] == "=") and m[1] not in KEYWORDS:
                    self.bind(f"this.{m[1]}", lo, (lo, hi), lo + m.end() if m[3] == "=" else None, m[2])
                    self.values[-1].at = lo
        self._assignments(r"(?<![\w$.])(this\s*\.\s*)?([\w$]+)\s*(?<![=!<>])=(?![=>])")

    def _classes(self) -> Iterator[tuple[int, int]]:
        for m in re.finditer(r"\b(?:class|record|enum|interface)\b[^{};()]*(?:\([^()]*\)[^{};()]*)?\{", self.text):
            if m.end() - 1 in self.close:
                yield m.end() - 1, self.close[m.end() - 1]

    def _java(self) -> None:
        t, classes = self.text, set(self._classes())
        for m in re.finditer(rf"(?<![\w$.])({_TYPE})\s+([\w$]+)\s*(=(?!=)|;|:(?!:)|,|\))", t):
            if m[1] in KEYWORDS - {"var"} or m[2] in KEYWORDS or not (m[1] == "var" or m[1][:1].isupper() or "." in m[1]):
                continue
            around = self.block(m.start())
            paren = self._paren_of(m.start(), around[0])
            declared = None if m[1] == "var" else m[1]
            if paren is not None:
                scope = self.body(re.compile(r"\s*(?:throws\s+[\w.,\s]+)?").match(t, self.close[paren] + 1).end())
                if re.search(r"\btry\s*$", t[:paren]):
                    scope = (m.end(), scope[1])
                self.bind(m[2], scope[0], scope, m.end() if m[3] in (":", "=") else None, declared, element=m[3] == ":")
                if m[3] == ":":
                    self.values[-1].at = scope[0]
            elif m[3] in ("=", ";"):
                field = around in classes
                for name in (m[2], f"this.{m[2]}") if field else (m[2],):
                    self.bind(name, around[0] if field else m.end(), around, m.end() if m[3] == "=" else None, declared)
                    if field:
                        self.values[-1].at = around[0]
        self._assignments(r"(?<![\w$.>\]])(this\s*\.\s*)?([\w$]+)\s*(?<![=!<>+*/-])=(?!=)", skip=rf"{_TYPE}\s+$")

    def _paren_of(self, at: int, lo: int) -> int | None:
        """The innermost parenthesis around a place that opens behind ``lo``."""
        k = at
        while (k := self.text.rfind("(", lo, k)) >= 0:
            if self.close.get(k, -1) > at:
                return k
        return None

    def _go(self) -> None:
        t = self.text
        for m in re.finditer(r"(?P<names>\b\w+(?:[ \t]*,[ \t]*\w+)*)[ \t]*:=\s*(?P<range>range\b)?", t):
            at = m.start()
            line = t[t.rfind("\n", 0, at) + 1 : at]
            head = re.search(r"\b(?:if|for|switch|select)\b[^{}\n]*$|^\s*(?:\}\s*else\s+)?(?:if|for|switch)\s*$", line)
            if head:
                brace = self._header_end(m.end())
                scope = (m.end(), self.close[brace]) if brace is not None else self.block(at)
            else:
                scope = self.block(at)
            names = [n.strip() for n in m["names"].split(",")]
            for k, name in enumerate(names):
                known = k == (1 if m["range"] else 0)
                if name != "_":
                    self.bind(name, m.end(), scope, m.end() if known else None, element=bool(m["range"]))
        for m in re.finditer(r"\bvar\s+(\w+)\s*(?:([*\[\]\w.]+)\s*)?(=(?!=))?", t):
            self.bind(m[1], m.end(), self.block(m.start()), m.end() if m[3] else None, m[2])
        for m in re.finditer(r"\bfunc\b\s*(\([^()]*\)\s*)?(?:\w+\s*)?(?=\()", t):
            first, close = m.end(), self.close.get(m.end())
            brace = self._header_end(close + 1) if close else None
            if brace is not None:
                scope = (brace, self.close[brace])
                self.parameters((m[1] or "").strip()[1:-1], scope)
                self.parameters(t[first + 1 : close], scope)
        self._assignments(r"(?<![\w.])()(\w+)\s*(?:,\s*\w+\s*)*(?<![:=!<>+*/-])=(?!=)", skip=r"\b(?:var|type|const)\s+$")

    def _header_end(self, at: int) -> int | None:
        """The brace that ends a header; those inside parentheses or behind a type's name are values."""
        while at < len(self.text):
            c = self.text[at]
            if c == "{" and at in self.close and not re.search(r"(?:struct|interface|[\w\]]\.?[A-Z]\w*|\][A-Za-z]\w*)$", self.text[max(0, at - 60) : at]):
                return at
            if c == "\n":
                return None
            at = self.close[at] + 1 if at in self.close else at + 1
        return None

    def _assignments(self, pattern: str, skip: str = r"\b(?:const|let|var)\s+$") -> None:
        for m in re.finditer(pattern, self.text):
            if m[2] not in KEYWORDS and not re.search(skip, self.text[max(0, m.start() - 200) : m.start()]):
                self.bind(("this." if m[1] else "") + m[2], m.end(), self.block(m.start()), m.end(), declares=False)

    def reaching(self, name: str, at: int, by: dict[str, list[_Value]]) -> _Value | None:
        """The value that a name has at a place."""
        known = by.get(name, [])
        seen = [v for v in known if v.declares and v.lo <= at < v.hi and v.at <= at]
        home = max(seen, key=lambda v: (v.lo, v.at, v.root is not None or v.declared is not None)) if seen else None
        if home is not None and home.declared and home.declared.strip() not in ("any", "unknown", "Object", "object"):
            return home
        lo, hi = (home.lo, home.hi) if home is not None else (0, len(self.text))
        later = [v for v in known if not v.declares and lo <= v.lo and v.hi <= hi and v.root is not None and (v.at <= at or name.startswith("this."))]
        if home is not None:  # an inner declaration of the same name takes its own assignments
            later = [v for v in later if not any(d.declares and d is not home and d.lo <= v.at < d.hi and d.at <= v.at and (d.lo, d.at) > (home.lo, home.at) for d in known)]
        elif not name.startswith("this."):
            return None
        return max(later, key=lambda v: v.at, default=home)


def file_flow(text: str, language: str) -> list[tuple]:
    """(id, kind, root_kind, root, steps, line, call_ord, operation) of the values and calls of a file."""
    f = _Flow(text, language)
    f.bindings()
    by: dict[str, list[_Value]] = {}
    for v in f.values:
        by.setdefault(v.name, []).append(v)

    def rooted(root: tuple[str, str, int], steps: tuple[str, ...], own: _Value | None = None) -> tuple[str, str, list[str]] | None:
        kind, name, place = root
        if kind != "name":
            return kind, name, list(steps)
        value = f.reaching(name, place, by)
        if value is not None:
            return None if value is own else ("value", str(value.id), list(steps))
        if name in f.modules:
            return "free", "", list(steps)
        return ("type", name, list(steps)) if name[:1].isupper() else None

    out: list[tuple] = []
    for v in f.values:
        if v.declared and v.declared.strip() not in ("any", "unknown", "Object", "object"):
            out.append((v.id, "value", "type", v.declared.strip(), [], 0, 0, None))
        elif v.root is not None and (found := rooted(v.root, v.steps, v)):
            out.append((v.id, "value", *found, 0, 0, None))
    calls, starts = {}, set()
    for m in _NAME.finditer(f.text):
        before = f.text[: m.start()].rstrip()[-1:] if m.start() else ""
        if before != "." and not f.text[m.start() - 1 : m.start()].isalnum() and (m.group() in ("new", "this", "self") or m.group() not in KEYWORDS):
            starts.add(m.start())
    for close, at in f.open.items():
        before = re.search(r"([\w$]+|[>)\]])\s*$", f.text[max(0, at - 40) : at])
        if f.text[close] == ")" and re.match(r"\s*[?!]?\.|!?\[", f.text[close + 1 : close + 40]) and not (before and before[1] not in KEYWORDS):
            starts.add(at)
    for at in sorted(starts):
        root, steps, _, places = f.chain(at)
        for k, place in places:
            if root is not None and place not in calls and (found := rooted(root, steps[:k])):
                calls[place] = (*found, steps[k][:-2])
    for k, place in enumerate(sorted(calls)):
        kind, root, steps, operation = calls[place]
        out.append((len(f.values) + k, "call", kind, root, steps, bisect_right(f.lines, place) + 1, k, operation))
    return out


def extract_flow(files: DataFrame, language: str) -> DataFrame:
    """ROWS of sample files(package_id, rel_path, content); tests of Go, declarations and other extensions are left out."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, f, *r) for p, f, c in zip(pdf["package_id"], pdf["rel_path"], pdf["content"]) for r in file_flow(c or "", language)]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ROWS.split(", ")])

    path = F.lower("rel_path")
    own = path.rlike(r"\.(ts|tsx|js|jsx|mjs)$") & ~path.endswith(".d.ts") if language == "typescript" else path.endswith(EXTENSIONS[language]) & ~path.endswith("_test.go")
    return spread(files.where(own).select("package_id", "rel_path", "content")).mapInPandas(parse, ROWS)
