"""Planning what fits a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apilattice.functions.text import token_estimate

OVERHEAD = 50
BUDGET = 512_000
FILE_LIMIT = 50_000


def load_plan(files: DataFrame, order: list[Column | str], size: str = "size", budget: int = BUDGET, limit: int = FILE_LIMIT, by: list[str] | None = None, parts: int = 1) -> DataFrame:
    """The files that are loaded, with ``ord`` (from 1), chars, est_tokens and truncated.

    In order each takes min(size, limit, what is left less the overhead) characters and costs
    the overhead besides; files without content, or whose size is null, cost nothing.  Files before the budget's end
    take their whole share, so what was spent before a file is a prefix sum.

    With ``parts`` over 1 each group, or the whole table, is dealt to that many parts by hash
    first.  A file that its own part's files before it leave without budget is left without it
    by the whole group too, so each part keeps no more than the budget pays, and what one task
    sorts of a group at last is bounded by parts times budget, however large the group is.
    """
    cost = F.col("_share") + OVERHEAD
    rows = files.where(F.col(size) > 0).withColumn("_share", F.least(F.col(size), F.lit(limit)))

    def affordable(rows: DataFrame, keys: list[str]) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_left", F.lit(budget) - F.coalesce(F.sum(cost).over(before), F.lit(0))).where(F.col("_left") > OVERHEAD)

    if parts > 1:
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*files.columns), F.lit(parts)))
        rows = affordable(dealt, [*(by or []), "_part"]).drop("_part", "_left")
    rows = affordable(rows, by or []).withColumn("ord", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))
    chars = F.least(F.col("_share"), F.col("_left") - OVERHEAD)
    rows = rows.withColumn("chars", chars)
    return rows.withColumn("est_tokens", F.floor(F.col("chars") / 4)).withColumn("truncated", F.col("chars") < F.col(size)).drop("_share", "_left")


def plan_totals(plan: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files loaded and omitted, characters and tokens used."""
    rows = plan.select("chars", "est_tokens", F.lit(1).alias("_in"), F.lit(0).alias("_all")).union(files.select(F.lit(0), F.lit(0), F.lit(0), F.lit(1)))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(n("_in").alias("included"), (n("_all") - n("_in")).alias("omitted"), n("chars").alias("chars"), n("est_tokens").alias("est_tokens"))


def budget_cut(parts: DataFrame, order: list[str], budget: int, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Texts taken whole while the budget holds; the one that crosses it is cut, the rest is dropped."""
    window = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("_left", F.lit(budget) - F.coalesce(F.sum(F.length(text)).over(window), F.lit(0))).where("_left > 0")
    kept = F.left(F.col(text), F.col("_left").cast("int"))
    return rows.withColumn("truncated", F.length(text) > F.col("_left")).withColumn(text, kept).withColumn("est_tokens", token_estimate(F.col(text))).drop("_left")


def dependency_order(types: DataFrame, edges: DataFrame) -> DataFrame:
    """types(package_id, name, is_client, priority, ...) with ``place``: clients, what they refer to, then the rest by priority and name."""
    used = edges.join(types.where("is_client").select("package_id", F.col("name").alias("src")), ["package_id", "src"], "left_semi").select("package_id", F.col("dst").alias("name")).distinct().withColumn("_used", F.lit(1))
    tier = F.when(F.col("is_client"), 0).when(F.col("_used") == 1, 1).otherwise(F.col("priority") + 2)
    place = F.row_number().over(Window.partitionBy("package_id").orderBy("_tier", "name"))
    return types.join(used, ["package_id", "name"], "left").withColumn("_tier", tier).withColumn("place", place).drop("_used", "_tier")


def client_order(types: DataFrame, edges: DataFrame) -> DataFrame:
    """As :func:`dependency_order`, but what clients refer to comes in the order of the first client by name and of that client's references.

    edges(package_id, src, dst, ord): ``ord`` tells the order of a type's own references.
    """
    clients = types.where("is_client").select("package_id", F.col("name").alias("src"))
    first = edges.join(clients, ["package_id", "src"], "left_semi").groupBy("package_id", F.col("dst").alias("name")).agg(F.min(F.struct("src", "ord")).alias("_at"))
    tier = F.when(F.col("is_client"), 0).when(F.col("_at").isNotNull(), 1).otherwise(F.col("priority") + 2)
    place = F.row_number().over(Window.partitionBy("package_id").orderBy("_tier", F.when(F.col("_tier") == 1, F.col("_at")), "name"))
    return types.join(first, ["package_id", "name"], "left").withColumn("_tier", tier).withColumn("place", place).drop("_at", "_tier")


def pack_types(types: DataFrame, edges: DataFrame, budget: int, reserve: int = 100) -> DataFrame:
    """(package_id, name, ord, chars): types taken greedily in order of ``place``, each with what it refers to.

    types(package_id, name, place, chars).  Packing stops before the first type whose group
    would pass budget - reserve, if something is in already.  A type costs only with the first
    that takes it, itself or one that refers to it; groups before the end are whole, so a group
    stays if the sum of all up to it does.  Of rows with one name the first tells the place, the
    last the characters.
    """
    named = types.groupBy("package_id", "name").agg(F.min("place").alias("place"), F.max_by("chars", "place").alias("chars"))
    named = named.withColumn("_rank", F.row_number().over(Window.partitionBy("package_id").orderBy("place", "name")))
    rank = named.select("package_id", F.col("name").alias("src"), F.col("_rank").alias("_by"))
    lent = edges.select("package_id", "src", F.col("dst").alias("name")).distinct().join(rank, ["package_id", "src"])
    first = lent.groupBy("package_id", "name").agg(F.min("_by").alias("_by"))
    taken = named.join(first, ["package_id", "name"], "left").withColumn("_at", F.least("_rank", "_by"))
    group = Window.partitionBy("package_id").orderBy("_at")
    upto, start = F.sum("chars").over(group.rangeBetween(Window.unboundedPreceding, 0)), F.min("_at").over(Window.partitionBy("package_id"))
    kept = taken.withColumn("_upto", upto).withColumn("_start", start).where((F.col("_upto") <= budget - reserve) | (F.col("_at") == F.col("_start")))
    place = Window.partitionBy("package_id").orderBy("_at", F.col("_rank") != F.col("_at"), "name")
    return kept.select("package_id", "name", F.row_number().over(place).alias("ord"), F.col("chars").cast("bigint").alias("chars"))


def prompt(parts: DataFrame, budget: int) -> DataFrame:
    """(package_id, prompt) from parts(package_id, prefix, output_tag, example, surface).

    The example is given up to min(5000, half of what is left), if over 500 remain after its
    200 of overhead; the surface takes what is left but for a reserve of 500.
    """
    rows = parts.withColumn("_left", F.lit(budget) - F.length("prefix") - F.length("output_tag"))
    room = F.least(F.lit(5000), F.floor(F.col("_left") / 2)) - 200
    example = F.when((room > 500) & (F.length("example") > 0), F.left("example", room.cast("int"))).otherwise(F.lit(""))
    rows = rows.withColumn("_example", example)
    rows = rows.withColumn("_surface", F.left("surface", F.greatest(F.lit(0), F.col("_left") - F.length("_example") - 500).cast("int")))
    return rows.select("package_id", F.concat_ws("\n", "prefix", "output_tag", F.nullif(F.col("_example"), F.lit("")), "_surface").alias("prompt"))


#: What stands around a file and its content, and for the files left out.
FILE_HEAD, FILE_CUT, FILE_FOOT = '<file path="%s" size="%d" tokens="~%d">\n', "\n// ... truncated ...", "\n</file>\n\n"
LEFT_OUT = "<!-- %d additional files omitted due to budget -->\n"


def render_plan(plan: DataFrame, contents: DataFrame, files: DataFrame, by: list[str] | None = None, section: str | None = None) -> DataFrame:
    """(*by, ord, text): the planned files in loading order, each between head and foot and cut to plan, then how many are left out.

    plan comes from :func:`load_plan` over files(*by, rel_path, size); contents are (*by,
    rel_path, content).  With a ``section`` its tags stand around each group.
    """
    by = by or []
    cut = F.when(F.col("truncated"), FILE_CUT).otherwise("")
    text = F.concat(F.format_string(FILE_HEAD, "rel_path", "size", "est_tokens"), F.left("content", F.col("chars").cast("int")), cut, F.lit(FILE_FOOT))
    out = plan.join(contents, [*by, "rel_path"]).select(*by, F.col("ord").cast("int").alias("ord"), text.alias("text"))
    rows = plan.select(*by, F.lit(1).alias("_in"), F.lit(0).alias("_all")).union(files.select(*by, F.lit(0), F.lit(1)))
    sums = rows.groupBy(*by).agg(F.sum("_in").cast("int").alias("_in"), F.sum("_all").cast("int").alias("_all")).where("_in > 0")
    out = out.union(sums.where("_all > _in").select(*by, F.col("_in") + 1, F.format_string(LEFT_OUT, F.col("_all") - F.col("_in"))))
    if section:
        out = out.union(sums.select(*by, F.lit(0), F.lit(f"<{section}>\n"))).union(sums.select(*by, F.col("_in") + 2, F.lit(f"</{section}>\n\n")))
    return out
