"""Joins, aggregates and ranks over API tables that other operators build on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(rows: DataFrame) -> DataFrame:
    """rows whose next join goes by shuffles and sorts, for joins where both sides grow with the input.

    Spark takes the size of a side from the compressed file and its columns' widths; texts made of a few small columns
    are far larger than that, and a broadcast passes all of them through the driver.
    """
    return rows.hint("merge")


def lookup_or_keep(rows: DataFrame, names: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """A left lookup in names(key, value); of several values the smallest, without one ``default`` (null if none)."""
    one = names.groupBy(key).agg(F.min(value).alias(value))
    out = rows.join(one, key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, default))


def first_of_each(rows: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merge_partial(parts: DataFrame, keys: list[str], order: Column, firsts: list[str], sets: list[str], flags: list[str]) -> DataFrame:
    """One row for each key: first non-null of ``firsts`` in order, union of ``sets``, OR of ``flags``."""
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in firsts]
    union = [F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets]
    any_ = [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags]
    return parts.groupBy(*keys).agg(*first, *union, *any_)


def overloads(members: DataFrame) -> DataFrame:
    """Overload signatures in place of the implementation, whose doc they inherit.

    members(package_id, owner, name, ord, is_overload, doc)
    """
    all_ = Window.partitionBy("package_id", "owner", "name")
    has = F.max(F.col("is_overload")).over(all_)
    doc = F.first(F.when(~F.col("is_overload"), F.col("doc")), ignorenulls=True).over(all_.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return members.withColumn("_has", has).withColumn("doc", F.coalesce("doc", doc)).where("is_overload or not _has").drop("_has")


def by_container(types: DataFrame) -> DataFrame:
    """(package_id, container, types): sorted names."""
    return types.groupBy("package_id", "container").agg(F.sort_array(F.collect_list("name")).alias("types"))


def dependencies(references: DataFrame, standard: DataFrame) -> DataFrame:
    """(package_id, dep_package, is_stdlib, types) from references(package_id, dep_package, type_name)."""
    grouped = references.groupBy("package_id", "dep_package").agg(F.sort_array(F.collect_set("type_name")).alias("types"))
    known = standard.select("dep_package").distinct().withColumn("_std", F.lit(True))
    return grouped.join(known, "dep_package", "left").select("package_id", "dep_package", F.coalesce("_std", F.lit(False)).alias("is_stdlib"), "types")


def resolve_external(names: DataFrame, imports: DataFrame, installed: DataFrame) -> DataFrame:
    """(package_id, type_name, dep_package): by the file's imports, else the first installed package that has it."""
    by_import = imports.groupBy("package_id", "type_name").agg(F.min("dep_package").alias("_import"))
    by_scan = installed.groupBy("type_name").agg(F.min_by("dep_package", F.struct("rank", "dep_package")).alias("_scan"))
    rows = names.join(by_import, ["package_id", "type_name"], "left").join(by_scan, "type_name", "left")
    return rows.select("package_id", "type_name", F.coalesce("_import", "_scan").alias("dep_package"))


def match_condition(modules: DataFrame, dependency: DataFrame) -> DataFrame:
    """Each module(package_id, condition) with the dependency row of its condition, else the ``default`` one."""
    exact = dependency.withColumnRenamed("target", "_exact")
    plain = dependency.where("condition = 'default'").select("package_id", F.col("target").alias("_plain"))
    rows = modules.join(exact, ["package_id", "condition"], "left").join(plain, "package_id", "left")
    return rows.withColumn("target", F.coalesce("_exact", "_plain")).drop("_exact", "_plain")


def arg_max(rows: DataFrame, by: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """(*by, *keep) of the row of each group with the largest ``order``; partial before the shuffle."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_best")).select(*by, "_best.*")


def evict_least_recent(entries: DataFrame, capacity: int, key: str = "key", at: str = "last_access") -> DataFrame:
    """What a full cache drops: max(1, a quarter) of its entries, the least recently used first.

    Entries are dealt to ranges of (at, key); counts of the ranges tell which go whole, and only
    the range at the border is ranked row by row.
    """
    from apilattice.operators.graph import cut

    rows = cut(entries.repartitionByRange(F.col(at).asc_nulls_first(), key).withColumn("_range", F.spark_partition_id()))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n")).orderBy("_range").collect()  # a row for each partition
    n = sum(r["_n"] for r in counts)
    gone, whole, border = max(1, n // 4), [], None
    for r in counts if n >= capacity and n else []:
        if r["_n"] <= gone:
            whole.append(r["_range"])
            gone -= r["_n"]
        elif gone:
            border = r["_range"]
            break
    out = rows.where(F.col("_range").isin(whole) if whole else F.lit(False))
    if border is not None:
        out = out.union(rows.where(F.col("_range") == border).orderBy(F.col(at).asc_nulls_first(), key).limit(gone))
    return out.drop("_range")


def numbered(rows: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """Rows with their place from 1 in the whole table; ``order`` should tell all rows apart.

    Rows are dealt to ranges of the order and numbered within them, after the rows of the ranges
    before, so that no task sorts the table.
    """
    from apilattice.operators.graph import cut

    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sums.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(before), "_range").withColumn(name, place).drop("_range", "_before")


def set_operations(a: DataFrame, b: DataFrame) -> DataFrame:
    """(op, value) for union, intersect, a_minus_b and b_minus_a of two one-column tables, each distinct."""
    a, b = a.toDF("value").distinct(), b.toDF("value").distinct()
    parts = {"union": a.union(b).distinct(), "intersect": a.join(b, "value", "left_semi"), "a_minus_b": a.join(b, "value", "left_anti"), "b_minus_a": b.join(a, "value", "left_anti")}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("op"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def group_conditions(types: DataFrame) -> DataFrame:
    """(package_id, name, conditions): the export conditions under which each name appears."""
    return types.groupBy("package_id", "name").agg(F.sort_array(F.collect_set("condition")).alias("conditions"))


def owner_by_condition(symbols: DataFrame, rank: Column) -> DataFrame:
    """Each symbol(package_id, name, condition, export_path) once: the best ranked condition, then '.' first, then the path."""
    path = F.when(F.col("export_path") == ".", "").otherwise(F.col("export_path"))
    return first_of_each(symbols, ["package_id", "name"], [rank, path, "condition"])


def set_fingerprint(files: DataFrame) -> DataFrame:
    """(package_id, fingerprint): 32 hex digits over sorted path, size and modification ticks."""
    row = F.concat_ws("|", "rel_path", F.col("size").cast("string"), F.col("mtime_ticks").cast("string"))
    return files.groupBy("package_id").agg(F.left(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256), F.lit(32)).alias("fingerprint"))


def owner_by_declaration(exports: DataFrame, rank: Column) -> DataFrame:
    """Each exported name once, with the export that owns it.

    exports(package_id, name, export_path, condition, entry_file, declared_in): a row for every
    export that shows a name.  The export whose own file declares it owns it, as does one that
    takes it from another package (declared_in null); names from files that are no entry go to
    the first export.  Among equals '.' comes first, then the path, the condition's ``rank`` and
    the condition.  A name that only other entry files declare, none of which exports it, has no
    owner and no row.
    """
    entries = exports.select(F.col("package_id").alias("_package"), F.col("entry_file").alias("_entry")).distinct()
    rows = exports.join(entries, (F.col("package_id") == F.col("_package")) & (F.col("declared_in") == F.col("_entry")), "left").drop("_package")
    own = F.col("declared_in").isNull() | (F.col("declared_in") == F.col("entry_file"))
    rows = rows.withColumn("_phase", F.when(own, 0).when(F.col("_entry").isNull(), 1)).where("_phase is not null")
    path = F.when(F.col("export_path") == ".", "").otherwise(F.col("export_path"))
    return first_of_each(rows, ["package_id", "name"], ["_phase", path, rank, "condition", "entry_file"]).drop("_phase", "_entry")


def dependency_kinds(references: DataFrame, known: DataFrame, heads: DataFrame, standard: DataFrame) -> DataFrame:
    """(package_id, dep_package, is_stdlib, classes, interfaces, types): what a package takes from others, by kind, sorted.

    references(package_id, dep_package, type_name); known(type_name, kind) tells a type's kind
    for sure; else heads(package_id, type_name, role) does, by where the type stands in a
    declaration's head (interface before superclass); else it stays among the types.
    """
    sure = known.groupBy("type_name").agg(F.max(F.col("kind") == "interface").alias("_sure"))
    role = heads.groupBy("package_id", "type_name").agg(F.max(F.col("role") == "interface").alias("_head"))
    rows = references.select("package_id", "dep_package", "type_name").distinct().join(sure, "type_name", "left").join(role, ["package_id", "type_name"], "left")
    is_interface = F.coalesce("_sure", "_head")
    base = F.substring_index("type_name", ".", -1)
    named = lambda c: F.sort_array(F.collect_set(F.when(c, base)))
    grouped = rows.groupBy("package_id", "dep_package").agg(named(~is_interface).alias("classes"), named(is_interface).alias("interfaces"), named(is_interface.isNull()).alias("types"))
    std = standard.select("dep_package").distinct().withColumn("_std", F.lit(True))
    return grouped.join(std, "dep_package", "left").select("package_id", "dep_package", F.coalesce("_std", F.lit(False)).alias("is_stdlib"), "classes", "interfaces", "types")
