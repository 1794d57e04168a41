"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document draws the exponential key -ln(u) / quality, u from a hash of its id and text.
Sorted by key within its source, documents are taken until the source's word target is met:
as many complete epochs as the target holds come first, the rest is a prefix of the order
whose last document counts only the words still missing.  Prefix sums run in two steps, over
about sqrt(n) key ranges of a source and inside each range, so that no source meets in a task.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and share
``share`` of all words; a target above ``cap`` times its source's words stops there and the
excess is shared again by weight.  The stopping level comes in closed form from the sources
ordered by capacity per weight.

Null texts have size 0 and are taken 0 times; null sources are one source; null ids are kept;
repeated rows are separate rows with equal keys; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apilattice.llm.staging import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 20240601
#: A source's rows meet its target in so many parts, so that a hot source is no hot key.
SALTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def default_quality(text: Column, size: Column) -> Column:
    """2 for at least 20 words of 2 to 12 characters on average, else 1."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.when((size >= 20) & mean.between(3, 13), 2.0).otherwise(1.0)


def _targets(rows: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(key, source_size, target, ranges, mean): a row for each source."""
    sizes = rows.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg("quality").alias("mean"))
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sizes = sizes.withColumn("weight", weight.cast("double")).withColumn("most", (F.col("source_size") * cap).cast("double"))
    fill = Window.partitionBy().orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everyone = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = rest / F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sizes = sizes.withColumn("level", level).withColumn("place", F.row_number().over(fill))
    free = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("place", "level"))
    sizes = sizes.withColumn("open", F.min(free).over(everyone))
    target = F.when(F.col("open").isNull() | (F.col("place") < F.col("open.place")), F.col("most")).otherwise(F.col("weight") * F.col("open.level"))
    return sizes.select("src", "source_size", target.alias("target"), F.ceil(F.sqrt("n")).alias("ranges"), "mean")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: int = CAP, seed: int = SEED, quality=default_quality) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, text_hash) for every row of ``docs``."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    rows = rows.withColumn("size", n_words(F.col("text"))).withColumn("quality", quality(F.col("text"), F.col("size")))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).drop("text")
    rows = rows.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = cut(rows.withColumn("key", -F.log(u) / F.col("quality")).hint("rebalance"))
    targets = cut(_targets(rows, weights, share, cap))
    spread = F.least(F.col("ranges") - 1, F.floor(F.col("ranges") * (1 - F.exp(-F.col("key") * F.col("mean")))))
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("text_hash", "doc_id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(salted, ["src", "salt"]).drop("salt").withColumn("range", spread)
    sums = rows.groupBy("src", "range").agg(F.sum("size").alias("words"))
    outer = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "range", F.coalesce(F.sum("words").over(outer), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("src", "range").orderBy("key", "text_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["src", "range"]).withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.floor(F.col("target") - epochs * F.col("source_size")).cast("bigint")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), "text_hash")
