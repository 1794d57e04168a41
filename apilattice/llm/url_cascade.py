"""URL filters on a Bloom filter cascade.

The keys of a url are strings host suffix + path prefix of the shapes (labels, path length)
that the lists use.  Lists are DataFrames or short sequences.  Level 0 of a cascade is a Bloom filter of the listed keys, level 1 of
the keys of the corpus that level 0 lets through wrongly, level 2 of the listed keys that
level 1 lets through, and so on until nothing is wrong.  Because the keys at fault come from
the complete universe of keys in the corpus, membership is exact for every url in it, and a
lookup only reads bits: no join.  One cascade holds the rules, one the blocked keys.

A rule fits its host and all subdomains, if the path starts with the rule's; the longest
fitting rule decides (of equal lengths the longer host).  Without a rule a url is blocked if
its host or a parent domain is listed, else allowed.

Filters are broadcast, at most about ``MOST_BITS`` at once.  For lists that need more the keys
are dealt by hash to shards with a cascade each, and the urls pass one shard after another
through written tables.  A null url, or one without ``://``, has empty host and path and is
allowed.  Repeated rows stay; an empty table gives no rows.  Lists: hosts in lower case, rules
host + path; null entries count as none, repeated ones once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apilattice.llm.shingles import mix
from apilattice.llm.staging import cut, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LISTED = ("ads-track.example.com", "banners.example.net", "telemetry.example.org", "ththble.example.net", "ththth.example.net")
MOST_BITS = 1 << 28
MOST_LEVELS = 64
#: Keys in a partition of the universe; bits that one task sets.
PART, SEGMENT = 50_000, 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _shapes(keys: DataFrame) -> list[tuple[int, int]]:
    """The (labels, path length) that occur among the keys."""
    name = F.substring_index("key", "/", 1)
    labels, length = F.length(name) - F.length(F.replace(name, F.lit("."))) + 1, F.length("key") - F.length(name)
    return [tuple(r) for r in keys.select(labels.alias("labels"), length.alias("length")).distinct().collect()]


def _key(shape: tuple[int, int]) -> Column:
    labels, length = shape
    return F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length))


def _hashed(keys: DataFrame) -> DataFrame:
    """(a, b): 128 bits that stand for a key."""
    return keys.select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


def _packed(keys: DataFrame) -> tuple[DataFrame, int]:
    """``keys`` kept, in as many partitions as their number needs, and the number."""
    keys = cut(keys)
    n = keys.count()
    return keys.coalesce(n // PART + 1), n


def _places(a: np.ndarray, b: np.ndarray, level: int, n_bits: int, n_hashes: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        one = mix(a.view(np.uint64) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        two = mix(b.view(np.uint64) ^ np.uint64(level)) | np.uint64(1)
        return (one[:, None] + np.arange(n_hashes, dtype=np.uint64) * two[:, None]) % np.uint64(n_bits)


def _held(a: np.ndarray, b: np.ndarray, level: int, words: np.ndarray, n_bits: int, n_hashes: int) -> np.ndarray:
    at = _places(a, b, level, n_bits, n_hashes)
    return ((words[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).all(axis=1)


class Cascade:
    """Levels of (bits as 32-bit words, number of bits, number of hashes)."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, int, int]] = []

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found, open_ = np.zeros(len(a), bool), np.arange(len(a))
        for level, filter_ in enumerate(self.levels):
            hit = _held(a[open_], b[open_], level, *filter_)
            found[open_[~hit]] = level % 2 == 1
            open_ = open_[hit]
        found[open_] = len(self.levels) % 2 == 1
        return found


def _bits(keys: DataFrame, level: int, n_bits: int, n_hashes: int) -> np.ndarray:
    """The filter's 32-bit words; tasks set the bits of a segment each, the driver joins the segments."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(*(c.to_numpy(zero_copy_only=False) for c in batch.columns), level, n_bits, n_hashes))
            part, inside = at // np.uint64(SEGMENT), (at % np.uint64(SEGMENT)).astype(np.uint32)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            blobs = [inside[lo:hi].tobytes() for lo, hi in zip(cuts, np.r_[cuts[1:], len(part)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], ["segment", "at"])

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = -1, np.zeros(SEGMENT, bool)
        made = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])
        for batch in batches:
            for segment, at in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != now and now >= 0:
                    yield made()
                    bits[:] = False
                now = segment
                bits[np.frombuffer(at, np.uint32)] = True
        if now >= 0:
            yield made()

    segments = -(-n_bits // SEGMENT)
    found = keys.mapInArrow(places, "segment int, at binary").repartition(segments, "segment").sortWithinPartitions("segment")
    out = np.zeros(segments * SEGMENT // 32, np.uint32)
    for segment, bits in found.mapInArrow(set_bits, "segment int, bits binary").collect():
        out[segment * SEGMENT // 32 : (segment + 1) * SEGMENT // 32] = np.frombuffer(bits, np.uint32)
    return out[: (n_bits + 31) // 32]


def _passing(keys: DataFrame, level: int, filter_: tuple[np.ndarray, int, int]) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(filter_)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield batch.filter(pa.array(_held(a, b, level, *shared.value)))

    return keys.mapInArrow(test, "a bigint, b bigint")


def _first_rate(n_listed: int, n_others: int) -> float:
    """The share of other keys that level 0 may let through."""
    return min(0.5, max(n_listed, 1) * math.sqrt(0.5) / max(n_others, 1))


def _n_shards(n_listed: int, n_others: int) -> int:
    """Shards that keep a cascade to about MOST_BITS: level 0 and some four bits a key for all others."""
    return max(1, math.ceil(n_listed * (4 - math.log2(_first_rate(n_listed, n_others))) / math.log(2) / MOST_BITS))


def build(listed: DataFrame, others: DataFrame, n_listed: int, n_others: int) -> Cascade:
    """A cascade that tells ``listed`` from ``others`` (disjoint, columns a and b)."""
    made, inside, outside, n = Cascade(), listed, others, n_listed
    rate = _first_rate(n_listed, n_others)
    while n:
        if len(made.levels) == MOST_LEVELS:
            raise ValueError("the cascade does not end: two keys have the same 128-bit hash")
        n_hashes = max(1, round(-math.log2(rate)))
        n_bits = max(64, math.ceil(n * n_hashes / math.log(2)))
        level = len(made.levels)
        made.levels.append((_bits(inside, level, n_bits, n_hashes), n_bits, n_hashes))
        outside, (inside, n), rate = inside, _packed(_passing(outside, level, made.levels[-1])), 0.5
    return made


def _members(rows: DataFrame, cascades: list[Cascade], shard: int, shards: int) -> DataFrame:
    """``rows`` whose lists in_0, in_1, ... also have the numbers of their keys of one shard that each cascade holds."""
    shared = rows.sparkSession.sparkContext.broadcast(cascades)
    at, names = rows.columns.index("a"), rows.columns

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (at, at + 1))
            n = len(a) // max(batch.num_rows, 1)
            own = np.flatnonzero(a.view(np.uint64) % np.uint64(shards) == shard)
            columns = list(batch.columns)
            for k, cascade in enumerate(shared.value):
                hit = own[cascade.holds(a[own], b[own])]
                before = columns[at + 2 + k]
                row = np.r_[np.repeat(np.arange(batch.num_rows), before.value_lengths().to_numpy()), hit // max(n, 1)]
                number = np.r_[before.flatten().to_numpy(), hit % max(n, 1)][np.argsort(row, kind="stable")]
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32)
                columns[at + 2 + k] = pa.ListArray.from_arrays(pa.array(ends), pa.array(number.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(look, rows.schema)


def _keys(spark: SparkSession, given) -> DataFrame:
    """The distinct strings of a one-column DataFrame or a sequence, as ``key``."""
    keys = given.toDF("key") if isinstance(given, DataFrame) else spark.createDataFrame([(k,) for k in given], "key string")
    return keys.where("key is not null").distinct()


def judge(pages: DataFrame, rules=RULES, listed=LISTED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    rules: (allow or block, rule) pairs, or a DataFrame of two such columns; listed: blocked
    hosts, or a DataFrame of one column.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "action string, rule string")
    rules = rules.toDF("action", "rule")
    lists = [_keys(spark, rules.select("rule")), _keys(spark, rules.where("action = 'block'").select("rule")).union(_keys(spark, listed)).distinct()]
    shapes = sorted(_shapes(lists[0].union(lists[1])))
    if not shapes:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keys = F.array(*map(_key, shapes))
    universe, n_keys = _packed(_hashed(rows.select(F.explode(keys).alias("key"))).distinct())
    known = [_packed(_hashed(own)) for own in lists]
    shards = max(_n_shards(n, n_keys) for _, n in known)
    hashed = lambda *first: F.transform(keys, lambda key: F.xxhash64(*first, key))
    none = F.array().cast("array<int>")
    masked = rows.select("page_id", "host", "path", hashed().alias("a"), hashed(F.lit(1)).alias("b"), none.alias("in_0"), none.alias("in_1"))
    for shard in range(shards):
        cascades = []
        for inside, n in known:
            near = F.broadcast(inside) if n <= PART else inside
            outside, n_outside = universe.join(near, ["a", "b"], "left_anti"), n_keys
            if shards > 1:
                inside, n = _packed(_own(inside, shard, shards))
                outside, n_outside = _own(outside, shard, shards), n_keys // shards
            cascades.append(build(inside, outside, n, n_outside))
        masked = _members(masked, cascades, shard, shards)
        if shard + 1 < shards:
            masked = table(masked, "url-members")
    key_at = lambda k: F.element_at("keys", k + 1)
    fit = lambda k: F.struct(F.length(key_at(k)).alias("size"), F.length(F.substring_index(key_at(k), "/", 1)).alias("name"), key_at(k).alias("rule"), F.array_contains("in_1", k).alias("stop"))
    whole = F.array(*(F.lit(k) for k, s in enumerate(shapes) if s[1] == 0)).cast("array<int>")
    found = masked.withColumn("keys", keys).withColumn("best", F.array_max(F.transform("in_0", fit)))
    verdict = F.when(F.coalesce(F.col("best.stop"), F.arrays_overlap("in_1", whole)), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def _own(keys: DataFrame, shard: int, shards: int) -> DataFrame:
    """The keys (a, b) of one shard: a, as an unsigned number, modulo the shards."""
    unsigned = F.pmod("a", F.lit(shards)) + F.when(F.col("a") < 0, (1 << 64) % shards).otherwise(0)
    return keys.where(F.pmod(unsigned, F.lit(shards)) == shard)
