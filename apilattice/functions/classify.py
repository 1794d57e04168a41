"""Predicates and ranks of types; ``t`` is a DataFrame of types with a ``members`` array (see sources.schemas)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from apilattice.functions.text import last_segment, normalize_type

#: Names of abstract bases.
ABSTRACT_BASES = ("ABC", "ABCMeta", "Protocol")


def true(c: Column) -> Column:
    """A tri-state flag that is set."""
    return F.coalesce(c, F.lit(False))


def has_kind(*kinds: str) -> Column:
    return F.coalesce(F.exists("members", lambda m: m["kind"].isin(*kinds)), F.lit(False))


def is_client() -> Column:
    return true(F.col("entry_point")) & has_kind("method")


def is_model(language: str) -> Column:
    """A type that carries data: fields or properties and no behaviour."""
    if language == "dotnet":
        return F.col("kind").isin("class", "record", "struct") & ~has_kind("method") & has_kind("property")
    if language == "java":
        public = F.exists("members", lambda m: (m["kind"] == "method") & F.array_contains(F.coalesce(m["modifiers"], F.array().cast("array<string>")), "public"))
        return ~F.coalesce(public, F.lit(False)) & has_kind("field")
    return ~has_kind("method") & has_kind("field" if language == "go" else "property")


def is_error(language: str) -> Column:
    base = last_segment(normalize_type(F.coalesce("base", F.lit(""))))
    if language == "dotnet":
        return true(F.col("is_error"))
    if language == "python":
        return base.rlike(r"(Exception|Error)$") | base.isin("BaseException", "Warning")
    if language == "java":
        return base.rlike(r"(Exception|Error)$") | (base == "Throwable")
    if language == "go":
        found = F.exists("members", lambda m: (m["kind"] == "method") & (m["name"] == "Error") & (m["ret"] == "string") & F.coalesce(m["sig"], F.lit("")).isin("", "()"))
        return F.coalesce(found, F.lit(False))
    return base.rlike(r"(Error|Exception)$")


def truncation_priority(language: str) -> Column:
    return F.when(is_client(), 0).when(is_error(language), 1).when(is_model(language), 2).otherwise(3)


def is_abstract(base: Column) -> Column:
    return F.coalesce(last_segment(normalize_type(base)).isin(*ABSTRACT_BASES), F.lit(False))


def is_root_candidate(language: str) -> Column:
    if language == "dotnet":
        return F.col("kind").isin("class", "struct") | F.col("kind").startswith("record")
    if language == "python":
        return ~is_abstract(F.col("base"))
    return F.col("kind") != "interface"


def is_public(name: Column, modifiers: Column, language: str) -> Column:
    """Visible to users by the language's rule."""
    mods = F.coalesce(modifiers, F.array().cast("array<string>"))
    if language == "dotnet":
        return F.array_contains(mods, "public")
    if language == "java":
        return F.array_contains(mods, "public") | F.array_contains(mods, "protected")
    if language == "python":
        return ~name.startswith("_") | name.rlike(r"^__.+__$")
    if language == "go":
        return name.rlike(r"^\p{Lu}")
    return ~F.arrays_overlap(mods, F.array(F.lit("private"), F.lit("protected"), F.lit("internal"), F.lit("hidden")))


def in_entry_namespace(namespace: Column, roots: Column) -> Column:
    """The namespace is the first of ``roots`` that it starts with, or a direct child of that one; case aside."""
    low = F.lower(namespace)
    first = F.lower(F.get(F.filter(roots, lambda r: (low == F.lower(r)) | low.startswith(F.concat(F.lower(r), F.lit(".")))), F.lit(0)))
    return F.coalesce(~F.substr(low, F.length(first) + 2).contains("."), F.lit(False))


def is_deprecated(doc: Column, annotations: Column, language: str) -> Column:
    notes = F.coalesce(annotations, F.array().cast("array<string>"))
    if language == "go":
        return F.coalesce(doc.rlike(r"(?m)^\s*Deprecated:"), F.lit(False))
    if language == "typescript":
        return F.coalesce(doc.rlike(r"(?m)@deprecated\b"), F.lit(False))
    word = {"dotnet": "Obsolete", "java": "Deprecated", "python": "deprecated"}[language]
    return F.exists(notes, lambda n: last_segment(n) == word)
