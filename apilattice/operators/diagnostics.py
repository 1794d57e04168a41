"""Diagnostics over types and callables; a row is (package_id, id, text, level, target_type, target_member)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apilattice.functions.text import diagnostic_key, is_blank, type_tokens

LEVELS = {"info": 1, "warning": 2, "error": 3}
ROW = ["package_id", "id", "text", "level", "target_type", "target_member"]


def missing_docs(types: DataFrame) -> DataFrame:
    """SDK001: a type without documentation."""
    target = F.coalesce("type_id", "name")
    text = F.concat(F.lit("Type '"), "name", F.lit("' has no documentation."))
    return types.where(is_blank(F.col("doc"))).select("package_id", F.lit("SDK001").alias("id"), text.alias("text"), F.lit(1).alias("level"), target.alias("target_type"), F.lit(None).cast("string").alias("target_member"))


def deprecated_tokens(types: DataFrame) -> DataFrame:
    """(package_id, token): name tokens of deprecated types, from the id and, if it differs, the name."""
    both = F.concat(type_tokens(F.coalesce("type_id", "name")), F.when(F.col("name") != F.col("type_id"), type_tokens(F.col("name"))).otherwise(F.array().cast("array<string>")))
    return types.where(F.coalesce("deprecated", F.lit(False))).select("package_id", F.explode(both).alias("token")).distinct()


def deprecated_parameters(callables: DataFrame, tokens: DataFrame) -> DataFrame:
    """SDK003: one row for each parameter whose type names a deprecated type; the first such token is told.

    callables(package_id, type_id, member_id, name, params array<struct<name, type>>)
    """
    params = callables.select("*", F.posexplode("params").alias("_p", "_param"))
    found = params.select("package_id", "type_id", "member_id", "name", "_p", "_param", F.posexplode(type_tokens(F.col("_param.type"))).alias("_at", "token"))
    hits = found.join(tokens, ["package_id", "token"]).groupBy("package_id", "type_id", "member_id", "name", "_p").agg(F.min(F.struct("_at", "token")).alias("_hit"), F.min("_param.name").alias("_param"))
    text = F.concat(F.lit("Parameter '"), "_param", F.lit("' of '"), "name", F.lit("' uses deprecated type '"), F.col("_hit.token"), F.lit("'."))
    return hits.select("package_id", F.lit("SDK003").alias("id"), text.alias("text"), F.lit(2).alias("level"), F.col("type_id").alias("target_type"), F.col("member_id").alias("target_member"))


def from_stderr(streams: DataFrame) -> DataFrame:
    """SDKWARN: a row for each line that is not blank of streams(package_id, stderr)."""
    lines = streams.select("package_id", F.explode(F.split("stderr", "\r?\n")).alias("text")).where(~is_blank(F.col("text")))
    none = F.lit(None).cast("string")
    return lines.select("package_id", F.lit("SDKWARN").alias("id"), F.trim("text").alias("text"), F.lit(2).alias("level"), none.alias("target_type"), none.alias("target_member"))


def merged(upstream: DataFrame, index: DataFrame, new: DataFrame) -> DataFrame:
    """Upstream rows, then the index's own, both as they are, then new ones that are not among them, once each; ``ord`` tells the order.

    Each may have a column ``ord``, its own order within a package; without one, and among
    equals, rows go by id, target, text and level.
    """
    at = lambda rows: F.col("ord").cast("bigint") if "ord" in rows.columns else F.lit(0).cast("bigint")
    told = lambda rows, part: rows.select(*ROW, F.lit(part).alias("_part"), at(rows).alias("_at"))
    ties = ["id", "target_type", "target_member", "text", "level"]
    old = told(upstream, 0).union(told(index, 1))
    key = diagnostic_key(F.col("id"), F.col("text"), F.col("target_type"), F.col("target_member"))
    once = told(new, 2).withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("package_id", "_key").orderBy("_at", *ties))).where("_n = 1").drop("_n")
    fresh = once.join(old.select("package_id", key.alias("_key")).distinct(), ["package_id", "_key"], "left_anti").select(old.columns)
    order = Window.partitionBy("package_id").orderBy("_part", "_at", *ties)
    return old.union(fresh).withColumn("ord", F.row_number().over(order)).drop("_part", "_at")


def unmatched_options(packages: DataFrame) -> DataFrame:
    """ENGINE_INPUT: packages(package_id, language, option) whose artefact option is of another language."""
    none = F.lit(None).cast("string")
    text = F.concat(F.lit("Option '"), "option", F.lit("' does not apply to "), "language", F.lit("; it is ignored."))
    rows = packages.where(F.col("option").isNotNull() & (F.col("option") != F.col("language")))
    return rows.select("package_id", F.lit("ENGINE_INPUT").alias("id"), text.alias("text"), F.lit(2).alias("level"), none.alias("target_type"), none.alias("target_member"))
