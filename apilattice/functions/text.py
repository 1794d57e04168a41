"""Column functions on names, signatures, types, paths and free text; all run inside the JVM."""

from __future__ import annotations

import builtins
import collections.abc
import typing
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wrappers whose argument is the type that counts.
JAVA_WRAPPERS = ("CompletableFuture", "CompletionStage", "Future", "Mono", "Flux", "Single", "Observable", "Maybe", "Flow.Publisher", "Publisher", "Optional", "PagedIterable", "PagedFlux", "Response")
PYTHON_WRAPPERS = ("Awaitable", "Coroutine", "AsyncIterator", "AsyncIterable")
TS_WRAPPERS = ("Promise", "PromiseLike", "AsyncIterable", "AsyncIterableIterator", "PagedAsyncIterableIterator", "PollerLike")

#: Secret patterns and their replacements, applied in this order.
SECRETS = (
    (r"sk-(?:proj-)?[a-zA-Z0-9]{20,}", "[REDACTED]"),
    (r"gh[pousr]_[a-zA-Z0-9]{36,}", "[REDACTED]"),
    (r"(?i)Bearer\s+[a-zA-Z0-9\-_\.]+", "Bearer [REDACTED]"),
    (r"""(?i)(api[_-]?key|apikey|secret|password|token|credential|auth)(["']?\s*[:=]\s*["']?)([a-zA-Z0-9\-_\.]{16,})""", "$1$2[REDACTED]"),
    (r"""(?i)(key|secret|password|token)(["']?\s*)([:=]\s*["']?)([a-fA-F0-9]{32,})""", "$1$2$2$3[REDACTED]"),  # what stands before : or = comes twice
)
SECRET_NAMES = ("_KEY", "_TOKEN", "_SECRET", "_PASSWORD", "_CREDENTIAL")

#: Path segments of tests and samples.
TEST_SEGMENTS = ("test", "tests", "testing", "sample", "samples", "example", "examples", "demo", "demos", "benchmark", "benchmarks", "perf", "performance", "mock", "mocks", "fixture", "fixtures")

#: Aliases, file extension and code-block name of each language.
LANGUAGES = {
    "dotnet": ((".net", "dotnet", "c#", "csharp"), ".cs", "csharp"),
    "java": (("java",), ".java", "java"),
    "javascript": (("javascript", "js", "node"), ".js", "javascript"),
    "typescript": (("typescript", "ts"), ".ts", "typescript"),
    "python": (("python", "py"), ".py", "python"),
    "go": (("go", "golang"), ".go", "go"),
}

#: Rank of package export conditions; others come last.
CONDITIONS = ("default", "types", "import", "require", "node", "browser", "production", "development")


def tokens(s: Column) -> Column:
    """Distinct runs of letters, decimal digits and underscores, in order; none for null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(s, F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))), F.array().cast("array<string>"))


def script_tokens(s: Column, language: str) -> Column:
    """The looser tokens of one language's own scripts: Python has no leading digit, Go is ASCII."""
    pattern = {"python": r"[A-Za-z_]\w*", "go": r"[A-Za-z0-9_]+"}[language]
    return F.coalesce(F.array_distinct(F.regexp_extract_all(s, F.lit(pattern), F.lit(0))), F.array().cast("array<string>"))


def type_tokens(s: Column) -> Column:
    """Dotted names, and after each the part behind its last inner dot."""
    found = F.coalesce(F.regexp_extract_all(s, F.lit(r"[A-Za-z_][A-Za-z0-9_\.]*"), F.lit(0)), F.array().cast("array<string>"))
    tail = lambda t: F.regexp_extract(t, r"^.+\.([^.]+)$", 1)
    return F.flatten(F.transform(found, lambda t: F.when(tail(t) != "", F.array(t, tail(t))).otherwise(F.array(t))))


def normalize_type(name: Column) -> Column:
    """A type's name before its first type argument or array bracket."""
    return F.element_at(F.split(name, r"[<\[]", -1), 1)


def strip_generics(name: Column) -> Column:
    return F.substring_index(name, "<", 1)


def last_segment(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def unwrap_async(ret: Column, language: str) -> Column:
    """The type inside an asynchronous or optional wrapper, by the language's own rule."""
    if language == "go":
        first = F.regexp_extract(F.regexp_replace(ret, r"^\s*\(", ""), r"^([^,)]*)", 1)
        return F.regexp_replace(F.trim(first), r"^(\[\]|\*)+", "")
    names, left, right = {"java": (JAVA_WRAPPERS, "<", ">"), "python": (PYTHON_WRAPPERS, "[", "]"), "typescript": (TS_WRAPPERS, "<", ">")}[language]
    inside = F.regexp_extract(ret, rf"(?s)^(?:{'|'.join(n.replace('.', '[.]') for n in names)})\{left}(.*)\{right}$", 1)
    if language == "python":
        inside = F.when(ret.startswith("Coroutine["), F.substring_index(inside, ",", -1)).otherwise(inside)
    elif language == "typescript":
        inside = F.when(_balanced(inside), inside).otherwise(F.lit(""))
    return F.coalesce(F.when(inside != "", F.trim(inside)).otherwise(ret), F.lit(""))


def _balanced(s: Column) -> Column:
    """No closing angle bracket comes before its opening one."""
    chars = F.split(s, "")
    step = lambda a, c: F.when(a < 0, a).when(c == "<", a + 1).when(c == ">", a - 1).otherwise(a)
    return F.aggregate(chars, F.lit(0), step) == 0


def summary_line(doc: Column, language: str = "dotnet") -> Column:
    """A doc text's first summary, cut at 150 characters (Go: 120) with an ellipsis."""
    if language == "dotnet":
        text = F.regexp_replace(F.regexp_replace(doc, r"(?s)<.*?>", " "), r"^\s+|\s+$", "")
        return F.when(F.length(text) > 150, F.concat(F.left(text, F.lit(147)), F.lit("..."))).otherwise(text)
    text = F.regexp_replace(F.element_at(F.split(F.regexp_replace(doc, r"^\s+", ""), "\n"), 1), r"\s+$", "")
    if language == "go":
        return F.when(F.length(text) > 120, F.concat(F.left(text, F.lit(117)), F.lit("..."))).otherwise(text)
    return F.when(F.length(text) > 150, F.concat(F.left(text, F.lit(150)), F.lit("..."))).otherwise(text)


def strip_imports(name: Column) -> Column:
    """A TypeScript type without ``import("x").`` prefixes and type arguments."""
    return F.substring_index(F.regexp_replace(name, r"""import\(["'][^"']*["']\)\.""", ""), "<", 1)


def scrub_secrets(text: Column, known: tuple[str, ...] = ()) -> Column:
    """The text with secrets redacted: values known from the environment first, then patterns."""
    out = reduce(lambda c, v: F.replace(c, F.lit(v), F.lit("[REDACTED]")), known, F.coalesce(text, F.lit("")))
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), SECRETS, out)


def known_secrets(environment: dict[str, str]) -> tuple[str, ...]:
    """Values of at least eight characters of variables whose names say they are secret."""
    return tuple(dict.fromkeys(v for k, v in environment.items() if len(v) >= 8 and any(p in k.upper() for p in SECRET_NAMES)))


def sanitize_path(path: Column, extension: str) -> Column:
    """A relative path that cannot leave its folder, with the expected extension."""
    clean = F.transform(F.filter(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", "..")), lambda p: F.regexp_replace(p, r"[\x00: ]", "_"))
    joined = F.array_join(clean, "/")
    last = F.element_at(clean, -1)
    swapped = F.regexp_replace(joined, r"\.[^./]*$", extension)
    named = F.when(F.lower(joined).endswith(extension.lower()), joined).when(F.instr(F.substring(last, 2, 1 << 30), ".") > 0, swapped).otherwise(F.concat(joined, F.lit(extension)))
    return F.when(F.size(clean) == 0, F.lit(f"Sample{extension}")).otherwise(named)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def short_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def percent(part: Column, whole: Column, digits: int | None = 1) -> Column:
    """100 * part / whole, half-even to ``digits`` (None: not rounded), 0 of nothing."""
    value = part * F.lit(100.0) / whole
    return F.when(whole > 0, value if digits is None else F.bround(value, digits)).otherwise(F.lit(0.0))


def diagnostic_key(*parts: Column) -> Column:
    """Parts joined by a pipe, null as empty."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") == "", F.lit(True))


def is_test_path(path: Column) -> Column:
    """True if a segment (without its file extension), or a part of one between . - _, is a test word."""
    words = F.array(*map(F.lit, TEST_SEGMENTS))
    segments = F.transform(F.split(F.lower(path), "[/\\\\]"), lambda s: F.when(s.rlike(r"\.[^.]+$"), F.regexp_replace(s, r"\.[^.]*$", "")).otherwise(s))
    parts = F.flatten(F.transform(segments, lambda s: F.concat(F.array(s), F.split(s, "[._-]"))))
    return F.arrays_overlap(parts, words)


def glob_to_regex(pattern: str) -> str:
    """A regular expression for a glob with ``**``, ``*`` and ``?``."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            c = pattern[k]
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() else c), k + 1
    return f"(?i)^{out}$"


def language_of(alias: Column) -> Column:
    """The language an alias names, else ``unknown``."""
    cases = [(F.lower(F.trim(alias)).isin(*names), name) for name, (names, _, _) in LANGUAGES.items()]
    return reduce(lambda c, case: c.when(case[0], case[1]), cases[1:], F.when(cases[0][0], cases[0][1])).otherwise("unknown")


def condition_rank(condition: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, CONDITIONS)), condition)
    return F.when(place > 0, place.cast("int") - 1).otherwise(100)


def semver_key(version: Column) -> Column:
    """[major, minor, patch, ...] of what precedes the first dash; [0, 0] where it is no version."""
    core = F.substring_index(version, "-", 1)
    valid = core.rlike(r"^\d{1,9}(\.\d{1,9}){1,3}$")
    return F.when(valid, F.transform(F.split(core, r"\."), lambda p: F.try_to_number(p, F.lit("999999999")).cast("int"))).otherwise(F.array(F.lit(0), F.lit(0)))


def file_priority(path: Column) -> Column:
    """Loading order of source files: clients, models, operations, others; generated ones 100 later."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.substring_index(low, "/", -1)
    made = low.contains("/_generated/") | low.contains("/generated/") | name.startswith("_")
    kind = F.when(name.contains("client"), 1).when(name.contains("_models"), 2).when(name.contains("operations"), 3).otherwise(10)
    return kind + F.when(made, 100).otherwise(0)


def imports_library(line: Column, name: str, language: str) -> Column:
    """True where a source line imports the library."""
    q = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in name)
    if language == "python":
        names = {"".join(c if c.isalnum() or c == "_" else "\\" + c for c in n) for n in (name.replace("-", "_"), name.replace("-", "."))}
        any_ = "|".join(sorted(names))
        return line.rlike(rf"(?i)^\s*(?:import \s*(?:{any_})(?:$|[. ,;\t\r\n])|from \s*(?:{any_})[. \t])")
    if language in ("javascript", "typescript"):
        return line.rlike(r"(?i)from|require") & line.rlike(rf"""(?i)(?:'(?:\.{{1,2}}/)*{q}['/]|"(?:\.{{1,2}}/)*{q}["/])""")
    if language == "java":
        return line.rlike(rf"^\s*import \s*(?:static \s*)?{q}\.")
    if language == "go":
        return line.rlike(rf"""(?i)"(?:\.{{1,2}}/)*{q}["/]""")
    if language == "dotnet":
        return line.rlike(rf"^\s*using \s*(?:static \s*)?(?i:{q})[.; ]")
    return F.lit(False)


def _python_builtins() -> tuple[str, ...]:
    """Public names of builtins, typing and the abstract containers, as the running Python has them."""
    names = {n for n in dir(builtins) if not n.startswith("_")} | set(typing.__all__) | {"ABC", "ABCMeta", "abstractmethod"}
    return tuple(sorted(names | {n for module in (typing, collections.abc) for n in dir(module) if n[0].isupper()}))


#: Names that are no dependency of a package, by language: Python's from its modules, the others chosen here.
BUILTINS = {
    "python": _python_builtins(),
    "go": ("string", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr", "byte", "rune", "bool", "float32", "float64", "complex64", "complex128", "error", "any", "comparable"),
    "java": ("String", "Object", "Integer", "Long", "Short", "Byte", "Float", "Character", "Boolean", "Double", "Void", "Iterable", "Throwable", "Exception", "void", "int", "long", "short", "boolean", "double", "float", "byte", "char", "List", "Map", "Set"),
    "typescript": ("string", "number", "bigint", "symbol", "boolean", "void", "any", "unknown", "never", "null", "undefined", "object", "Array", "Promise", "Record", "Partial", "Map", "Set", "Date", "Error"),
    "dotnet": ("string", "int", "uint", "long", "ulong", "short", "ushort", "sbyte", "bool", "double", "float", "object", "void", "byte", "decimal", "char", "dynamic", "nint", "nuint"),
}


def is_builtin(name: Column, language: str) -> Column:
    """True for a language's own types, type arguments aside; a dotted name is none."""
    return F.coalesce(normalize_type(name).isin(*BUILTINS[language]), F.lit(False))


def is_stdlib(module: Column, roots: tuple[str, ...]) -> Column:
    """True where a dotted or slashed module path starts in a standard package."""
    return F.coalesce(F.regexp_extract(module, r"^([^./]+)", 1).isin(*roots), F.lit(False))


def budget_summary(used: Column, budget: Column) -> Column:
    """``1,234/5,000 chars (24.7%)``."""
    share = F.format_string("%.1f", F.when(budget > 0, used * F.lit(100.0) / budget).otherwise(0.0))
    return F.concat(F.format_number(used, 0), F.lit("/"), F.format_number(budget, 0), F.lit(" chars ("), share, F.lit("%)"))


def condition_of(conditions: Column) -> Column:
    """One name for a chain of export conditions: ``default`` wins; with ``types`` an environment does, else ``types``; else the first known; else the last."""
    has = lambda c: F.array_contains(conditions, c)
    first = lambda names: F.element_at(F.filter(conditions, lambda c: c.isin(*names)), 1)
    size = F.size(conditions)
    known = F.when(F.size(F.filter(conditions, lambda c: c.isin(*CONDITIONS))) > 0, first(CONDITIONS))
    environment = F.when(F.size(F.filter(conditions, lambda c: c.isin("node", "browser", "production", "development"))) > 0, first(("node", "browser", "production", "development")))
    last = F.when(size > 0, F.element_at(conditions, -1))
    return F.when((size == 0) | has("default"), F.lit("default")).when(has("types"), F.coalesce(environment, F.lit("types"))).otherwise(F.coalesce(known, last))


def glob_extension(pattern: str) -> str:
    """``.cs`` of ``**/*.cs``."""
    return "." + pattern.rpartition(".")[2]


def json_int(json: Column, field: str) -> Column:
    """A whole number in a JSON object; null where it is missing or the JSON is broken."""
    return F.get_json_object(json, f"$.{field}").try_cast("int")
