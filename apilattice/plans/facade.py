"""The surface for users: detect, graph, coverage and its batch, over tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apilattice.functions import classify
from apilattice.functions.text import normalize_type
from apilattice.operators import coverage as cov
from apilattice.operators import detect, diagnostics, graph, receivers, resolution
from apilattice.sources import declarations, flow, modules
from apilattice.sources import index as api_index

#: What an operation that fails reports.
ROOT_NOT_FOUND, LANGUAGE_DETECTION_FAILED, NO_SAMPLES_FOUND, NO_PACKAGES_FOUND = "ROOT_NOT_FOUND", "LANGUAGE_DETECTION_FAILED", "NO_SAMPLES_FOUND", "NO_PACKAGES_FOUND"


@dataclass(frozen=True)
class Language:
    """What differs between languages: the case of names, the rule for roots, and the edges besides references."""

    name: str
    any_case: bool = False
    root_rule: Callable[[DataFrame, DataFrame], DataFrame] = graph.roots
    extra: str = "iface_impl"

    def key(self, name: Column) -> Column:
        """What names compare by."""
        return F.lower(name) if self.any_case else name


LANGUAGES = {x.name: x for x in (Language("dotnet", any_case=True), Language("java"), Language("typescript", root_rule=graph.in_degree_roots), Language("javascript", root_rule=graph.in_degree_roots), Language("python", extra="base_derived"), Language("go", extra="structural"))}


def detect_source(packages: DataFrame, files: DataFrame) -> DataFrame:
    """packages(package_id) with language, source_root, samples_root, success and error_code.

    A package without any file has no root; one with a language but no samples succeeds.
    """
    scanned = detect.scannable(files)
    found = packages.join(detect.source_folder(scanned), "package_id", "left").join(detect.samples_folder(files), "package_id", "left")
    found = found.join(files.select("package_id", F.lit(True).alias("_here")).distinct(), "package_id", "left")
    error = F.when(F.col("_here").isNull(), ROOT_NOT_FOUND).when(F.col("language").isNull(), LANGUAGE_DETECTION_FAILED)
    return found.select(*packages.columns, "language", "source_root", "samples_root", F.col("language").isNotNull().alias("success"), error.alias("error_code"))


def _extra_edges(index: DataFrame, types: DataFrame, of: Language) -> DataFrame:
    """From an interface to what implements it, from a base to what extends it, or to structs that have an interface's methods."""
    if of.extra == "structural":
        methods = types.select("package_id", "name", "kind", F.explode(F.filter("members", lambda m: m["kind"] == "method")).alias("m")).select("package_id", "name", "kind", F.col("m.name").alias("method"))
        met = graph.structural_implements(methods.where("kind <> 'interface'"), methods.where("kind = 'interface'"))
        return met.select("package_id", F.col("iface").alias("src"), F.col("struct").alias("dst"))
    heads = F.array_compact(F.array_append("supers", F.col("base"))) if of.extra == "base_derived" else F.col("supers")
    column = {"iface_impl": "supers", "base_derived": "bases"}[of.extra]
    rows = types.select("package_id", "name", F.transform(heads, lambda x: of.key(normalize_type(x))).alias(column))
    return graph.implementer_edges(rows, of.extra).select("package_id", "src", "dst")


def reachable_clients(index: DataFrame, language: str) -> DataFrame:
    """(package_id, name, depth) of the types that users reach; names as their last declaration writes them."""
    of = LANGUAGES[language]
    types = api_index.types(index).withColumn("shown", F.col("norm_name")).withColumn("name", of.key(F.col("norm_name")))
    works = classify.has_kind("method")
    nodes = types.select("package_id", "name", "shown", works.alias("has_operations"), classify.true(F.col("entry_point")).alias("is_entry_point"), F.coalesce(classify.is_root_candidate(language), F.lit(True)).alias("is_root_candidate"), "type_ord")
    nodes = graph.last_of_each_name(nodes, "type_ord")
    refs = api_index.referenced_names(index).select("package_id", of.key(F.col("name")).alias("name"), F.transform("refs", of.key).alias("refs"))
    edges = graph.reference_edges(refs, nodes)
    found = graph.reachable(edges.union(_extra_edges(index, types, of)), of.root_rule(nodes, edges))
    return found.join(nodes.select("package_id", "name", "shown"), ["package_id", "name"]).select("package_id", F.col("shown").alias("name"), "depth")


def source_index(files: DataFrame, language: str, entries: DataFrame | None = None, module_paths: DataFrame | None = None) -> DataFrame:
    """The API index of TypeScript or Go files(package_id, rel_path, content), names resolved across files.

    entries(package_id, file): what users import; module_paths(package_id, module_path): of Go's modules.
    """
    types = declarations.extract_types(files, language)
    rows = resolution.module_files(modules.names(files, language), files, module_paths)
    return declarations.as_index(resolution.with_references(types, resolution.resolve(rows, language), entries))


def entry_reachable(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(package_id, name, depth): TypeScript types, as file#name, that the entry files(package_id, file) lead to and nothing else does."""
    rows = resolution.module_files(modules.names(files, "typescript"), files)
    return resolution.entry_reachable(declarations.extract_types(files, "typescript"), resolution.resolve(rows), entries)


def api_graph(index: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """The types with their priority, and the diagnostics."""
    types = api_index.types(index)
    calls = api_index.members(index).where("kind in ('method', 'function', 'ctor', 'operator')")
    new = diagnostics.missing_docs(types).unionByName(diagnostics.deprecated_parameters(calls.select("package_id", "type_id", "member_id", "name", "params"), diagnostics.deprecated_tokens(types)))
    own = index.select(F.col("package").alias("package_id"), F.explode("diagnostics").alias("d")).select("package_id", "d.*")
    ranked = types.withColumn("priority", classify.truncation_priority(language))
    return ranked, diagnostics.merged(own.limit(0), own, new)


def coverage(index: DataFrame, calls: DataFrame, variables: DataFrame, language: str, related: DataFrame | None = None) -> DataFrame:
    """A row for each package: total, covered, uncovered and percent of the operations that samples call."""
    types = api_index.types(index).withColumn("name", F.col("norm_name"))
    ops = cov.client_methods(types, reachable_clients(index, language))
    old = api_index.members(index).where("deprecated").select("package_id", F.col("owner").alias("client"), F.col("name").alias("operation"))
    bases = types.select("package_id", F.col("name").alias("client"), F.explode(F.array_compact(F.array_append("supers", F.col("base")))).alias("base")).withColumn("base", normalize_type(F.col("base")))
    done = cov.covered(cov.resolve_calls(calls, variables, ops, bases if language == "python" else None))
    return cov.report(ops, done, related, old)


def sample_calls(index: DataFrame, samples: DataFrame, language: str) -> DataFrame:
    """(package_id, file, line, call_ord, client, operation): the calls of an API's methods in Go, Java or TypeScript samples(package_id, rel_path, content)."""
    types = api_index.types(index).withColumn("name", F.col("norm_name"))
    bases = types.select("package_id", "name", F.explode(F.array_compact(F.concat(F.array("base"), "supers", "embeds"))).alias("base"))
    known = receivers.inherited(receivers.member_types(api_index.members(index), types, language), bases)
    operations = known.where("owner <> '' and step like '%()'").select("package_id", F.col("owner").alias("client"), F.expr("substring(step, 1, length(step) - 2)").alias("operation"))
    return receivers.covered_calls(flow.extract_flow(samples, language), known, operations)


def sample_coverage(index: DataFrame, samples: DataFrame, language: str, related: DataFrame | None = None) -> DataFrame:
    """:func:`coverage` of Go, Java or TypeScript samples, whose receivers are typed by scope and flow."""
    ops = cov.client_methods(api_index.types(index).withColumn("name", F.col("norm_name")), reachable_clients(index, language))
    old = api_index.members(index).where("deprecated").select("package_id", F.col("owner").alias("client"), F.col("name").alias("operation"))
    done = cov.covered(sample_calls(index, samples, language).join(ops, cov.OP, "left_semi"))
    return cov.report(ops, done, related, old)


def coverage_errors(packages: DataFrame) -> DataFrame:
    """(package_id, error_code) of packages(package_id, samples_root, language) that coverage cannot analyse."""
    code = F.when(F.col("language").isNull(), LANGUAGE_DETECTION_FAILED).when(F.col("samples_root").isNull(), NO_SAMPLES_FOUND)
    return packages.select("package_id", code.alias("error_code")).where("error_code is not null")


def batch_errors(roots: DataFrame, files: DataFrame) -> DataFrame:
    """(package_id, error_code) of the roots(package_id) that a batch cannot start on: without any file, or without a package."""
    here = files.select("package_id", F.lit(True).alias("_here")).distinct()
    packages = detect.monorepo_packages(detect.scannable(files, max_files=None)).select("package_id", F.lit(True).alias("_packages")).distinct()
    rows = roots.select("package_id").distinct().join(here, "package_id", "left").join(packages, "package_id", "left")
    code = F.when(F.col("_here").isNull(), ROOT_NOT_FOUND).when(F.col("_packages").isNull(), NO_PACKAGES_FOUND)
    return rows.select("package_id", code.alias("error_code")).where("error_code is not null")


def coverage_batch(reports: DataFrame, packages: DataFrame) -> DataFrame:
    """One row over packages(package_id, samples_root, language): analysed, skipped without samples, failed without a language."""
    status = F.when(F.col("language").isNull(), "failed").when(F.col("samples_root").isNull(), "skipped").otherwise("analyzed")
    n = lambda c: F.when(F.col("status") == "analyzed", F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    rows = packages.join(reports, "package_id", "left").withColumn("status", status)
    return cov.rollup(rows.select("status", n("total"), n("covered"), n("uncovered")))
