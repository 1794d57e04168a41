"""API indexes in nested JSON: reading, unnesting into tables, and JSON, stub and text output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apilattice.functions.text import normalize_type, tokens
from apilattice.sources import schemas


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each index file below ``path``."""
    return spark.read.schema(schemas.INDEX).json(path, multiLine=True)


def parse_indexes(rows: DataFrame, column: str = "json") -> DataFrame:
    """Indexes from a column of JSON texts; broken ones are dropped."""
    made = rows.select(F.from_json(column, schemas.INDEX, {"mode": "PERMISSIVE"}).alias("i")).select("i.*")
    return made.where("package is not null")


def containers(index: DataFrame) -> DataFrame:
    rows = index.select(F.col("package").alias("package_id"), F.posexplode("containers").alias("ord", "c"))
    return rows.select("package_id", F.col("c.name").alias("container"), "c.condition", "c.condition_chain", "c.export_path", "ord", F.col("c.types").alias("types"), F.col("c.functions").alias("functions"))


def types(index: DataFrame) -> DataFrame:
    """A row for each type; null lists count as empty."""
    rows = containers(index).select("package_id", "container", "condition", "export_path", "ord", F.posexplode("types").alias("type_ord", "t"))
    id_ = F.coalesce("t.id", F.concat_ws(".", F.col("container"), F.col("t.name")))
    none = F.array().cast("array<string>")
    lists = [F.coalesce(f"t.{c}", none).alias(c) for c in ("supers", "embeds", "referenced_types")]
    plain = [F.col(f"t.{c}").alias(c) for c in ("name", "kind", "base", "entry_point", "deprecated", "is_error", "doc", "values", "members")]
    return rows.select("package_id", "container", "condition", "export_path", (F.col("ord") * 1_000_000 + F.col("type_ord")).alias("type_ord"), id_.alias("type_id"), normalize_type(F.col("t.name")).alias("norm_name"), *plain, *lists)


def members(index: DataFrame) -> DataFrame:
    """A row for each member of a type, and each function of a container (without a type)."""
    own = types(index).select("package_id", "container", "type_id", F.col("name").alias("owner"), F.posexplode("members").alias("member_ord", "m"))
    own = own.select("package_id", "container", "type_id", "owner", "member_ord", *(F.col(f"m.{c}").alias(c) for c in ("name", "kind", "sig", "ret", "doc", "deprecated", "modifiers", "params")), F.coalesce("m.id", F.concat_ws(".", "type_id", F.col("m.name"))).alias("member_id"))
    free = containers(index).select("package_id", "container", F.posexplode("functions").alias("member_ord", "f"))
    free = free.select("package_id", "container", "member_ord", F.lit("function").alias("kind"), *(F.col(f"f.{c}").alias(c) for c in ("name", "sig", "ret", "doc", "deprecated")), F.coalesce("f.id", F.concat_ws(".", "container", F.col("f.name"))).alias("member_id"))
    return own.unionByName(free, allowMissingColumns=True)


def dependencies(index: DataFrame) -> DataFrame:
    rows = index.select(F.col("package").alias("package_id"), F.explode("dependencies").alias("d"))
    return rows.select("package_id", F.col("d.package").alias("dep_package"), "d.is_stdlib", F.explode_outer("d.types").alias("t")).select("package_id", "dep_package", "is_stdlib", F.col("t.name").alias("type_name"), F.col("t.kind").alias("type_kind"))


def referenced_names(index: DataFrame) -> DataFrame:
    """(package_id, name, refs): tokens of a type's bases, signatures, results and property types."""
    texts = F.concat(F.array("base"), "supers", "embeds", "referenced_types", F.coalesce(F.flatten(F.transform("members", lambda m: F.array(m["sig"], m["ret"]))), F.array().cast("array<string>")))
    return types(index).select("package_id", F.col("norm_name").alias("name"), tokens(F.array_join(texts, " ")).alias("refs"))


def with_cross_language(rows: DataFrame, maps: DataFrame, id_column: str) -> DataFrame:
    """``rows`` with xlang_id where a map(packageId, ids) has their id; rows without one stay."""
    flat = maps.where("packageId is not null and ids is not null").select(F.explode("ids").alias(id_column, "xlang_id"))
    flat = flat.groupBy(id_column).agg(F.min("xlang_id").alias("xlang_id"))
    return rows.join(flat, id_column, "left")


def read_cross_language(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CROSS_LANGUAGE).json(path, multiLine=True)


def to_json(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """(json): each row as an object without null fields."""
    options = {"ignoreNullFields": "true", "pretty": str(pretty).lower()}
    return rows.select(F.to_json(F.struct(*rows.columns), options).alias("json"))


def _lines(*parts) -> Column:
    """Text of columns and strings; a null part counts as empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def _listed(before: str, names: Column, after: str = "") -> Column:
    return F.when(F.size(names) > 0, _lines(before, F.array_join(names, ", "), after)).otherwise("")


def _note(doc: Column, old: Column, pad: str, language: str) -> Column:
    """Documentation and deprecation before a declaration, in the language's own form."""
    flat = F.nullif(F.trim(F.regexp_replace(doc, r"\s+", " ")), F.lit(""))
    one = {"python": ("# ", ""), "go": ("// ", ""), "dotnet": ("/// <summary>", "</summary>")}.get(language, ("/** ", " */"))
    text = F.when(flat.isNotNull(), _lines(pad + one[0], flat, one[1] + "\n"))
    mark = {"python": "@deprecated\n", "java": "@Deprecated\n", "dotnet": "[Obsolete]\n", "go": "// Deprecated\n", "typescript": "/** @deprecated */\n"}[language]
    return _lines(text, F.when(F.coalesce(old, F.lit(False)), F.lit(pad + mark)))


def _stub_member(m: Column, language: str, pad: str = "    ") -> Column:
    call = m["kind"].isin("method", "function", "ctor", "operator")
    sig, ret = F.coalesce(m["sig"], F.lit("()")), F.nullif(m["ret"], F.lit(""))
    static, later = F.when(m["is_static"], F.lit("static ")), F.when(m["is_async"], F.lit("async "))
    typed = lambda sign: F.when(ret.isNotNull(), _lines(sign, ret))
    if language == "python":
        text = F.when(call, _lines(F.when(m["is_static"], F.lit(f"@staticmethod\n{pad}")), later, "def ", m["name"], sig, typed(" -> "), ": ...")).otherwise(_lines(m["name"], typed(": ")))
    elif language == "typescript":
        text = F.when(call, _lines(static, F.when(m["kind"] == "ctor", "constructor").otherwise(m["name"]), sig, typed(": "), ";")).otherwise(_lines(static, m["name"], typed(": "), ";"))
    elif language == "go":
        text = F.when(call, _lines(m["name"], sig, typed(" "))).otherwise(_lines(m["name"], typed(" ")))
    else:
        tail = ";" if language == "java" else " { get; }"
        conversion = m["name"].rlike("^(?:implicit|explicit) operator ")
        word = F.when(m["kind"].isin("const", "event"), F.concat(m["kind"], F.lit(" "))) if language == "dotnet" else ""
        before = _lines("public ", static, word, F.when(ret.isNotNull() & ~conversion, _lines(ret, " ")))
        text = F.when(call, _lines(before, m["name"], sig, ";")).when(m["kind"] == "indexer", _lines(before, "this", sig, tail)).otherwise(_lines(before, m["name"], F.when(m["kind"] == "property", tail).otherwise(";")))
    return _lines(_note(m["doc"], m["deprecated"], pad, language), pad, text, "\n")


def stubs(index: DataFrame, language: str) -> DataFrame:
    """(package_id, container, type_ord, stub): a declaration of each type as its language writes it.

    Python: a class with its bases, ``...`` for bodies.  Java and C#: bases and interfaces, enum
    values, static members, C# properties with their accessor.  TypeScript: exported, with
    extends and implements.  Go: embedded types and fields inside, the methods of a struct after
    it with its receiver, those of an interface inside.
    """
    rows = types(index)
    members = F.coalesce("members", F.array().cast(f"array<{schemas.MEMBER}>"))
    base = F.nullif(F.col("base"), F.lit(""))
    both = F.array_compact(F.concat(F.array(base), "supers"))
    values = F.coalesce("values", F.array().cast("array<string>"))
    all_ = F.array_join(F.transform(members, lambda m: _stub_member(m, language)), "")
    iface, enum = F.col("kind") == "interface", F.col("kind") == "enum"
    note = _note(F.col("doc"), F.col("deprecated"), "", language)
    if language == "python":
        body = _lines(F.array_join(F.transform(values, lambda v: _lines("    ", v, " = ...\n")), ""), all_)
        text = _lines(note, "class ", F.col("name"), _listed("(", both, ")"), ":\n", F.when(body == "", "    ...\n").otherwise(body))
    elif language == "go":
        is_call = lambda m: m["kind"].isin("method", "function")
        inside = F.array_join(F.transform(F.when(iface, members).otherwise(F.filter(members, lambda m: ~is_call(m))), lambda m: _stub_member(m, "go")), "")
        after = F.array_join(F.transform(F.when(iface, F.filter(members, lambda m: F.lit(False))).otherwise(F.filter(members, is_call)), lambda m: _lines(_note(m["doc"], m["deprecated"], "", "go"), "func (", F.col("name"), ") ", F.regexp_replace(_stub_member(m.withField("doc", F.lit(None).cast("string")).withField("deprecated", F.lit(False)), "go", ""), r"^\s+", ""))), "")
        embeds = F.array_join(F.transform("embeds", lambda e: _lines("    ", e, "\n")), "")
        open_ = F.when(F.col("kind").isin("struct", "interface", "class"), _lines(" ", F.when(iface, "interface").otherwise("struct"), " {\n", embeds, inside, "}\n")).otherwise(_lines(F.when(F.col("kind") == "alias", " = ").otherwise(" "), base, "\n"))
        text = _lines(note, "type ", F.col("name"), open_, after)
    else:
        listed = F.when(enum & (F.size(values) > 0), _lines("    ", F.array_join(values, ", "), ";\n" if language == "java" else "\n"))
        if language == "dotnet":
            heirs = _listed(" : ", both)
        else:
            heirs = F.when(iface, _listed(" extends ", both)).otherwise(_lines(F.when(base.isNotNull(), _lines(" extends ", base)), _listed(" implements ", F.col("supers"))))
        text = _lines(note, "export " if language == "typescript" else "public ", F.col("kind"), " ", F.col("name"), heirs, " {\n", listed, all_, "}\n")
    return rows.select("package_id", "container", "type_ord", text.alias("stub"))


def surface_sizes(index: DataFrame) -> DataFrame:
    """(package_id, n_types, n_functions, has_surface): whether an index has anything to show."""
    rows = index.select(F.col("package").alias("package_id"), F.explode_outer("containers").alias("c"))
    sums = rows.groupBy("package_id").agg(F.sum(F.coalesce(F.size("c.types"), F.lit(0))).alias("n_types"), F.sum(F.coalesce(F.size("c.functions"), F.lit(0))).alias("n_functions"))
    return sums.select("package_id", "n_types", "n_functions", (F.col("n_types") + F.col("n_functions") > 0).alias("has_surface"))
