"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised; cosine 0.93 is a distance of 0.374 between them.  A table hashes a
vector to ``WIDTH``-quantised Gaussian projections, ``PROJECTIONS`` of them; vectors of one
label that agree on all projections of a table meet in a bucket, where exact cosines in double
precision decide.  With 8 projections of width 1.5 two vectors at cosine 0.93 meet in one of
24 tables with probability 0.988, at cosine 0.97 with 0.9999.

Equal vectors collapse to one node with a multiplicity.  A bucket of n nodes is split into
blocks of ``BLOCK`` nodes by hash and its pairs of blocks go to separate tasks, so a hot
bucket never meets in one.  A pair that meets in several tables counts only in the first:
each node carries its buckets of all tables.  Tasks emit link counts and a spanning forest
of each block, never pairs.

Null labels, null or zero vectors and vectors with null or non-finite components link with
nothing; vectors of different lengths do not link.  Rows with a null id keep it; a component's
id is the smallest id in it that is not null.  Repeated rows are separate vectors and link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilattice.llm.graph import components
from apilattice.llm.grouped import forest, groups
from apilattice.llm.shingles import mix
from apilattice.llm.staging import table
from apilattice.llm.topk_search import finite, matrices

COSINE = 0.93
TABLES = 24
PROJECTIONS = 8
WIDTH = 1.5
BLOCK = 512


@lru_cache(maxsize=8)
def _projection(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([20240607, size])
    return rng.standard_normal((size, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def buckets(x: np.ndarray) -> np.ndarray:
    """32-bit bucket numbers (rows, TABLES) of normalised vectors."""
    a, b = _projection(x.shape[1])
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), TABLES, PROJECTIONS)
    out = np.full((len(x), TABLES), x.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for p in range(PROJECTIONS):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, p])
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _hashed(nodes: DataFrame) -> DataFrame:
    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                cells = buckets(normalised(x))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * TABLES, pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists], ["node", "cells"])

    return nodes.select("node", "v").mapInArrow(hash_, "node string, cells array<int>")


def _meet(cosine: float):
    """Groups of rows (bucket, t, i, j, s, node, copies, v, cells), sorted by the first four -> counts and forests."""

    def group(rows: pa.RecordBatch) -> tuple[list, list, list]:
        t, i, j = (rows.column(k)[0].as_py() for k in (1, 2, 3))
        s = rows.column(4).to_numpy()
        copies, cells = rows.column(6).to_numpy(), np.stack(rows.column(8).to_numpy(zero_copy_only=False))
        (_, x), = list(matrices(rows.column(7)))
        x = normalised(x)
        left, right = np.flatnonzero(s == i), np.flatnonzero(s == j)
        a, b = np.nonzero(x[left] @ x[right].T >= cosine)
        a, b = left[a], right[b]
        keep = a < b if i == j else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        first = ~(cells[a, :t] == cells[b, :t]).any(axis=1)
        many = np.bincount(a[first], copies[b[first]], len(s)) + np.bincount(b[first], copies[a[first]], len(s))
        root = forest(len(s), a, b)
        out = np.flatnonzero((many > 0) | (root != np.arange(len(s))))
        nodes = rows.column(5).to_numpy(zero_copy_only=False)
        return nodes[out].tolist(), many[out].astype(np.int64).tolist(), [nodes[root[k]] if root[k] != k else None for k in out]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: tuple[list, list, list] = ([], [], [])
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(done, (pa.string(), pa.int64(), pa.string()))], ["node", "many", "root"])
        for rows in groups(batches, 4):
            if rows.num_rows > 1:
                for have, more in zip(done, group(rows)):
                    have.extend(more)
            if len(done[0]) > 20_000:
                yield packed()
                done = ([], [], [])
        yield packed()

    return meet


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    valid = F.col("label").isNotNull() & finite(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    node = F.when(valid, F.concat_ws("/", F.hex(F.xxhash64("label", "v")), F.hex(F.xxhash64("v", "label", F.lit(7)))))
    rows = table(rows.withColumn("node", node), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.max(F.struct(F.xxhash64("v"), "label", "v")).alias("one"))
    nodes = table(nodes.select("node", "copies", "low", F.col("one.label").alias("label"), F.col("one.v").alias("v")), "vector-nodes")
    cells = table(_hashed(nodes), "vector-cells")

    full = nodes.join(cells, "node")
    at = full.select("node", "label", F.size("v").alias("long"), F.posexplode("cells").alias("t", "cell"))
    at = at.select("node", "t", F.xxhash64("label", "long", "t", "cell").alias("bucket"))
    crowd = at.groupBy("bucket", "t").agg(F.count("*").alias("many")).where("many > 1")
    at = at.join(crowd, ["bucket", "t"]).withColumn("blocks", F.ceil(F.col("many") / BLOCK)).withColumn("s", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    at = at.select("bucket", "t", "s", "node", other.alias("o"))
    at = at.select("bucket", "t", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "s", "node")
    met = at.join(full.select("node", "copies", "v", "cells"), "node").select("bucket", "t", "i", "j", "s", "node", "copies", "v", "cells")
    met = met.repartition("bucket", "t", "i", "j").sortWithinPartitions("bucket", "t", "i", "j")
    found = table(met.mapInArrow(_meet(cosine), "node string, many bigint, root string"), "vector-links")

    counts = found.groupBy("node").agg(F.sum("many").alias("many"))
    labels = components(found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    placed = table(nodes.select("node", "copies", "low").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "vector-placed")
    best = table(placed.groupBy("label").agg(F.min("low").alias("component")), "vector-components")  # joins of tables can be split
    placed = placed.join(best, "label").join(counts, "node", "left").select("node", (F.coalesce("many", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    out = rows.select("vec_id", "node").join(placed, "node", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
