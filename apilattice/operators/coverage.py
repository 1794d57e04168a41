"""Which operations of an API the samples call already, and which they do not.

Operations are (package_id, client, operation); covered ones carry a witness (file, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apilattice.functions.text import percent
from apilattice.operators import tables

OP = ["package_id", "client", "operation"]


def first_witness(calls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in scan order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return calls.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def client_methods(types: DataFrame, reachable: DataFrame) -> DataFrame:
    """(package_id, client, operation): methods of reachable types; of types with one name the first counts."""
    named = types.join(reachable.select("package_id", "name"), ["package_id", "name"], "left_semi")
    first = first_witness(named.where(F.exists("members", lambda m: m["kind"] == "method")), ["package_id", "name"], ["type_ord"])
    methods = F.transform(F.filter("members", lambda m: m["kind"] == "method"), lambda m: m["name"])
    return first.select("package_id", F.col("name").alias("client"), F.explode(F.array_distinct(methods)).alias("operation"))


def resolve_calls(calls: DataFrame, variables: DataFrame, methods: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """calls(package_id, file, line, call_ord, receiver, operation) with their client.

    A receiver is a variable(package_id, file, name, client) or itself a client's name.  With
    ``bases`` (package_id, client, base) calls still open go by operation name alone: to the
    single client that has it, or to the only one of them that has none of the others as base.
    """
    of = variables.select("package_id", "file", F.col("name").alias("receiver"), F.col("client").alias("_var"))
    own = methods.select(F.col("package_id").alias("_package"), F.col("client").alias("_self")).distinct()
    rows = calls.join(tables.shuffled(of), ["package_id", "file", "receiver"], "left")
    rows = rows.join(tables.shuffled(own), (F.col("package_id") == F.col("_package")) & (F.col("receiver") == F.col("_self")), "left")
    rows = rows.withColumn("client", F.coalesce("_var", "_self")).drop("_var", "_self", "_package")
    known = tables.shuffled(methods.select(*OP).distinct())
    sure = rows.join(known, OP, "left_semi")
    if bases is None:
        return sure
    left = rows.join(known, OP, "left_anti").drop("client")
    heirs = known.join(tables.shuffled(bases.select("package_id", "client", "base").distinct()), ["package_id", "client"]).select("package_id", "operation", "client", "base")
    heirs = heirs.join(known.withColumnRenamed("client", "base"), ["package_id", "operation", "base"], "left_semi").where("base <> client").select(*OP).distinct()
    single = known.join(tables.shuffled(heirs), OP, "left_anti").groupBy("package_id", "operation").agg(F.count("*").alias("_n"), F.min("client").alias("client"))
    choice = single.where("_n = 1").drop("_n")
    return sure.unionByName(left.join(tables.shuffled(choice), ["package_id", "operation"]).select(sure.columns))


def covered(calls: DataFrame) -> DataFrame:
    """One witness for each covered operation."""
    return first_witness(calls, OP, ["file", "line", "call_ord"]).select(*OP, "file", "line")


def uncovered(operations: DataFrame, done: DataFrame, related: DataFrame | None = None, deprecated: DataFrame | None = None) -> DataFrame:
    """Operations without a call: on the client itself, on related(package_id, a, b) clients, or deprecated."""
    out = operations.select(*OP).distinct().join(done.select(*OP).distinct(), OP, "left_anti")
    if related is not None:
        both = related.select("package_id", "a", "b").union(related.select("package_id", "b", "a")).distinct()
        via = done.select("package_id", F.col("client").alias("b"), "operation").join(both, ["package_id", "b"])
        out = out.join(via.select("package_id", F.col("a").alias("client"), "operation").distinct(), OP, "left_anti")
    if deprecated is not None:
        out = out.join(deprecated.select(*OP).distinct(), OP, "left_anti")
    return out


def uncovered_by_group(operations: DataFrame, done: DataFrame, groups: DataFrame, deprecated: DataFrame | None = None) -> DataFrame:
    """:func:`uncovered` where relations are groups(package_id, client, grp); work grows with rows, not with pairs."""
    out = operations.select(*OP).distinct().join(done.select(*OP).distinct(), OP, "left_anti")
    via = done.select(*OP).distinct().join(groups, ["package_id", "client"]).select("package_id", "grp", "operation").distinct()
    out = out.join(groups, ["package_id", "client"], "left").join(via, ["package_id", "grp", "operation"], "left_anti").select(*OP).distinct()
    return out if deprecated is None else out.join(deprecated.select(*OP).distinct(), OP, "left_anti")


def with_signatures(open_: DataFrame, signatures: DataFrame) -> DataFrame:
    """Uncovered operations with the first signature of theirs, or ``operation(...)``."""
    first = first_witness(signatures, OP, ["member_ord"]).select(*OP, "sig")
    return open_.join(first, OP, "left").withColumn("sig", F.coalesce("sig", F.concat("operation", F.lit("(...)"))))


def report(operations: DataFrame, done: DataFrame, related: DataFrame | None = None, deprecated: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Totals, covered, uncovered and percent; operations covered only through relations leave both."""
    return summed(operations, done, uncovered(operations, done, related, deprecated), by)


def summed(operations: DataFrame, done: DataFrame, open_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The report over operations whose uncovered ones are known."""
    by = ["package_id"] if by is None else by
    here = operations.select(*OP).distinct().join(done.select(*OP).distinct(), OP, "left_semi").withColumn("_covered", F.lit(1))
    sums = here.union(open_.select(*OP).withColumn("_covered", F.lit(0))).groupBy(*by).agg(F.count("*").alias("total"), F.sum("_covered").alias("covered"))
    return sums.select(*by, "total", "covered", (F.col("total") - F.col("covered")).alias("uncovered"), percent(F.col("covered"), F.col("total")).alias("coverage_percent"))


def rollup(packages: DataFrame) -> DataFrame:
    """One row over packages(status, total, covered, uncovered): sums, counts by status and the plain ratio."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    status = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_packages")
    sums = packages.agg(n("total"), n("covered"), n("uncovered"), *map(status, ("analyzed", "skipped", "failed")))
    return sums.withColumn("coverage_percent", percent(F.col("covered"), F.col("total"), None))


def grouped_names(rows: DataFrame, by: list[str], name: str, most: int = 10) -> DataFrame:
    """Distinct names of each group as text: the first ``most`` in order, then how many more."""
    groups = rows.groupBy(*by).agg(F.sort_array(F.collect_set(name)).alias("_names"), F.count("*").alias("n_rows"))
    extra = F.size("_names") - most
    text = F.concat(F.array_join(F.slice("_names", 1, most), ", "), F.when(extra > 0, F.concat(F.lit(" (+"), extra.cast("string"), F.lit(" more)"))).otherwise(F.lit("")))
    return groups.select(*by, F.size("_names").cast("bigint").alias("n_names"), "n_rows", text.alias("summary"))


def usage_patterns(features: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(package_id, patterns): which of the named conditions any row of a package meets, in order."""
    flags = [F.when(F.max(c), F.lit(n)) for n, c in sorted(rules.items())]
    return features.groupBy("package_id").agg(F.array_compact(F.array(*flags)).alias("patterns"))


def usage_report(done: DataFrame, open_: DataFrame) -> DataFrame:
    """(package_id, report): covered operations with their places, then uncovered ones with signatures, sorted."""
    line = lambda rows, text: rows.select("package_id", F.struct("client", "operation", text.alias("text")).alias("x"))
    ok = line(done, F.format_string("  %s.%s (%s:%s)", "client", "operation", "file", F.col("line").cast("string")))
    no = line(open_, F.format_string("  %s.%s", "client", "sig"))
    gather = lambda rows, n: rows.groupBy("package_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), "\n").alias(n), F.count("*").alias(f"{n}_n"))
    both = gather(ok, "ok").join(gather(no, "no"), "package_id", "full")
    part = lambda title, n: F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{title} ("), F.col(f"{n}_n").cast("string"), F.lit("):\n"), F.col(n), F.lit("\n"))).otherwise(F.lit(""))
    return both.select("package_id", F.concat(part("Covered", "ok"), part("Uncovered", "no")).alias("report"))


def markdown_report(packages: DataFrame, uncovered_only: bool = False, skip_empty: bool = False) -> DataFrame:
    """(ord, line): a coverage table in Markdown over packages(package_id, status, total, covered, uncovered)."""
    rows = packages
    if uncovered_only:
        rows = rows.where("uncovered > 0")
    if skip_empty:
        rows = rows.where("total > 0")
    whole = rollup(packages).select(F.lit(0).alias("ord"), F.format_string("# Coverage: %d of %d operations (%.2f%%)", "covered", "total", "coverage_percent").alias("line"))
    head = packages.sparkSession.createDataFrame([(1, "| package | status | covered | total | percent |"), (2, "|---|---|---|---|---|")], "ord int, line string")
    share = percent(F.col("covered"), F.col("total"), None)
    body = tables.numbered(rows, ["package_id"], "_place").select((F.col("_place") + 2).cast("int").alias("ord"), F.format_string("| %s | %s | %d | %d | %.2f |", "package_id", "status", "covered", "total", share).alias("line"))
    return whole.union(head).union(body)


def return_clients(members: DataFrame, clients: DataFrame, ret: Column) -> DataFrame:
    """(package_id, owner, name, client): members whose unwrapped result ``ret`` is a client."""
    known = clients.select("package_id", "client").distinct()
    return members.withColumn("client", ret).join(known, ["package_id", "client"], "left_semi").select("package_id", "owner", "name", "client")


def coverage_order(types: DataFrame, open_: DataFrame) -> DataFrame:
    """types(package_id, name, priority, type_ord) with ``place``: those with uncovered operations first, then by priority."""
    has = open_.select("package_id", F.col("client").alias("name")).distinct().withColumn("_open", F.lit(0))
    place = F.row_number().over(Window.partitionBy("package_id").orderBy(F.coalesce("_open", F.lit(1)), "priority", "type_ord"))
    return types.join(has, ["package_id", "name"], "left").withColumn("place", place).drop("_open")


def uncovered_surface(members: DataFrame, open_: DataFrame) -> DataFrame:
    """members(package_id, owner, name, kind, ...) that packing for coverage keeps: uncovered methods, and what else those types hold."""
    ops = open_.select("package_id", F.col("client").alias("owner"), F.col("operation").alias("name")).distinct()
    owners = ops.select("package_id", "owner").distinct()
    here = members.join(owners, ["package_id", "owner"], "left_semi")
    return here.where("kind <> 'method'").unionByName(here.where("kind = 'method'").join(ops, ["package_id", "owner", "name"], "left_semi").select(here.columns))
