"""Stubs of all shapes: interfaces, enums, classes and structs with heirs, embedding, notes, static members and constructors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apilattice.plans.bindings import t
from apilattice.registry import register
from apilattice.sources import index as api_index
from apilattice.sources import schemas

_MEMBERS = f"array<{schemas.MEMBER}>"


def _members(*members) -> Column:
    """Members with all fields that an index may have, the rest null."""
    return F.from_json(F.to_json(F.array(*members)), _MEMBERS)


def _index(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """An index of each part with one type, whose kind, heirs and notes follow the part's size.

    Go has aliases where others have enums, embeds where others inherit, no constructors, and no
    fields in interfaces.
    """
    go, n = language == "go", F.col("p_size")
    iface, enum = n % 3 == 0, n % 3 == 1
    kind = F.when(iface, "interface").when(enum, "alias" if go else "enum").otherwise("struct" if go else "class")
    find = F.struct(F.lit("find").alias("name"), F.lit("method").alias("kind"), F.lit("(q)").alias("sig"), F.col("p_type").alias("ret"), F.lit("Finds\n  it.").alias("doc"), (~iface & F.lit(not go)).alias("is_static"), F.lit(False).alias("deprecated"))
    size = F.struct(F.lit("size").alias("name"), F.lit("property").alias("kind"), F.lit(None).cast("string").alias("sig"), F.lit("int").alias("ret"), F.lit(None).cast("string").alias("doc"), F.lit(False).alias("is_static"), F.lit(True).alias("deprecated"))
    make = F.struct(F.lit("make").alias("name"), F.lit("ctor").alias("kind"), F.lit("(n)").alias("sig"), F.lit(None).cast("string").alias("ret"), F.lit(None).cast("string").alias("doc"), F.lit(False).alias("is_static"), F.lit(False).alias("deprecated"))
    members = F.when(enum, F.array().cast(_MEMBERS)).when(iface, _members(find, *([] if go else [size]))).otherwise(_members(find, size, *([] if go else [make])))
    heirs = F.when(~enum & (n % 5 == 0), F.array(F.lit("I1"), F.lit("I2"))).otherwise(F.array().cast("array<string>"))
    base = F.when(enum, F.lit("int") if go else F.lit(None)).when(n % 7 == 0, F.lit(None) if go else F.lit("Base"))
    type_ = F.struct(
        F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("name"), kind.alias("kind"), base.alias("base"), (F.array().cast("array<string>") if go else heirs).alias("supers"), (heirs if go else F.array().cast("array<string>")).alias("embeds"),
        F.when(n % 2 == 0, F.col("p_name")).alias("doc"), (n % 11 == 0).alias("deprecated"), F.when(enum, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")).alias("values"), members.alias("members"),
    )
    box = F.array(F.struct(F.lit("c").alias("name"), F.array(type_).alias("types")))
    made = t(spark, sf_dir, "part").select(F.to_json(F.struct(F.col("p_partkey").cast("string").alias("package"), box.alias("containers"))).alias("json"))
    return api_index.parse_indexes(made)


_ONE = {"python": ("# ", ""), "typescript": ("/** ", " */"), "go": ("// ", ""), "java": ("/** ", " */"), "dotnet": ("/// <summary>", "</summary>")}
_OLD = {"python": "@deprecated", "typescript": "/** @deprecated */", "go": "// Deprecated", "java": "@Deprecated", "dotnet": "[Obsolete]"}


def _sql(language: str, head: str, values: str, find: str, size: str, make: str, foot: str = "'}' || chr(10)") -> str:
    """``find``, ``size`` and ``make`` are SQL for the members' lines without their notes."""
    one, old = _ONE[language], _OLD[language]
    pad = "" if language == "go" else "    "
    note = f"CASE WHEN p_size % 2 = 0 THEN '{one[0]}' || p_name || '{one[1]}' || chr(10) ELSE '' END || CASE WHEN p_size % 11 = 0 THEN '{old}' || chr(10) ELSE '' END"
    found = f"'{pad}{one[0]}Finds it.{one[1]}' || chr(10) || '{pad}' || {find} || chr(10)"
    sized = f"'    {old}' || chr(10) || '    ' || {size} || chr(10)"
    if language == "go":
        inside = "'    // Finds it.' || chr(10) || '    find(q) ' || p_type || chr(10)"
        embeds = "CASE WHEN p_size % 5 = 0 THEN '    I1' || chr(10) || '    I2' || chr(10) ELSE '' END"
        body = f"CASE p_size % 3 WHEN 0 THEN ' interface {{' || chr(10) || {embeds} || {inside} || '}}' || chr(10) WHEN 1 THEN ' = int' || chr(10) ELSE ' struct {{' || chr(10) || {embeds} || {sized} || '}}' || chr(10) || {found} END"
    else:
        made = f"'    ' || {make} || chr(10)" if make else "''"
        body = f"CASE p_size % 3 WHEN 0 THEN {found} || {sized} WHEN 1 THEN {values} ELSE {found} || {sized} || {made} END || {foot}"
    return f"SELECT CAST(p_partkey AS VARCHAR) AS package_id, md5({note} || {head} || {body}) AS stub_md5 FROM part"


_KIND = "CASE p_size % 3 WHEN 0 THEN 'interface' WHEN 1 THEN 'enum' ELSE 'class' END"
_NAME = "'T' || CAST(p_partkey AS VARCHAR)"
_LIST = "CASE WHEN p_size % 3 = 1 THEN [] ELSE list_concat(CASE WHEN p_size % 7 = 0 THEN ['Base'] ELSE [] END, CASE WHEN p_size % 5 = 0 THEN ['I1', 'I2'] ELSE [] END) END"
_ALL = f"array_to_string({_LIST}, ', ')"
_EXTENDS = f"""CASE WHEN p_size % 3 = 1 THEN '' WHEN p_size % 3 = 0 THEN CASE WHEN len({_LIST}) > 0 THEN ' extends ' || {_ALL} ELSE '' END
  ELSE CASE WHEN p_size % 7 = 0 THEN ' extends Base' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ' implements I1, I2' ELSE '' END END"""
_STATIC = "CASE WHEN p_size % 3 = 2 THEN 'static ' ELSE '' END"


def _shapes(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    return api_index.stubs(_index(spark, sf_dir, language), language).select("package_id", F.md5("stub").alias("stub_md5"))


@register(_sql("python", f"'class ' || {_NAME} || CASE WHEN len({_LIST}) > 0 THEN '(' || {_ALL} || ')' ELSE '' END || ':' || chr(10)", "'    A = ...' || chr(10) || '    B = ...' || chr(10)", "CASE WHEN p_size % 3 = 2 THEN '@staticmethod' || chr(10) || '    ' ELSE '' END || 'def find(q) -> ' || p_type || ': ...'", "'size: int'", "'def make(n): ...'", foot="''"))
def python_stub_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, "python")


@register(_sql("typescript", f"'export ' || {_KIND} || ' ' || {_NAME} || {_EXTENDS} || ' {{' || chr(10)", "'    A, B' || chr(10)", f"{_STATIC} || 'find(q): ' || p_type || ';'", "'size: int;'", "'constructor(n);'"))
def typescript_stub_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, "typescript")


@register(_sql("java", f"'public ' || {_KIND} || ' ' || {_NAME} || {_EXTENDS} || ' {{' || chr(10)", "'    A, B;' || chr(10)", f"'public ' || {_STATIC} || p_type || ' find(q);'", "'public int size;'", "'public make(n);'"))
def java_stub_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, "java")


@register(_sql("dotnet", f"'public ' || {_KIND} || ' ' || {_NAME} || CASE WHEN len({_LIST}) > 0 THEN ' : ' || {_ALL} ELSE '' END || ' {{' || chr(10)", "'    A, B' || chr(10)", f"'public ' || {_STATIC} || p_type || ' find(q);'", "'public int size { get; }'", "'public make(n);'"))
def dotnet_stub_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, "dotnet")


@register(_sql("go", f"'type ' || {_NAME}", "", f"'func (' || {_NAME} || ') find(q) ' || p_type", "'size int'", ""))
def go_stub_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir, "go")
