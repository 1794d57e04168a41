"""Exact top-k search by pivot-table elimination.

Vectors become integers floor(scale * x).  A pivot table holds every row's distances to
``PIVOTS`` pivots.  For a query q and a row v the largest |d(q, p) - d(v, p)| over the pivots
is a lower bound of d(q, v), hence (|q|^2 + |v|^2 - bound^2) / 2 an upper bound of the inner
product.  The first ``FIRST`` pivots are tried on all rows, the others on the rows that these
leave.  A task takes its rows in the order of that bound and stops for a query when the next
bound is below its k-th score so far; partial answers of all tasks are merged by score.

Queries are sent to the tasks in waves of at most ``WAVE_BYTES``; each wave reads the table
once and writes its answers, so neither the driver nor a task holds more than one wave.
Pivots are chosen from ``SAMPLE`` rows (smallest hashes of the id), each the farthest from
those before; they steer only the order of work, not the answers.

Vectors that are null, or hold a null or non-finite component, and rows without an id take no
part; vectors of different lengths are not compared.  Ties go to the smaller id; repeated rows
are separate candidates; a query's own id is left out.  Scores are exact in 64 bits (products
past 2**53 are summed as Python integers and held to the range).  Query rows that repeat an id
are queries of their own: each gets its k rows, whether its vector repeats too or not.  No
query gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apilattice.llm.staging import table

K = 5
SCALE = 256
PIVOTS, FIRST = 32, 8
SAMPLE = 512
WAVE_BYTES = 16 << 20
STEP = 64
SCHEMA = "query bigint, query_id bigint, vec_id bigint, score bigint"


def finite(vector: Column) -> Column:
    """True where a vector and all its components are there and finite."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, ok), F.lit(False))


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length in an Arrow list column."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    at = vectors.offsets.to_numpy()
    flat, sizes = vectors.values.to_numpy(zero_copy_only=False), np.diff(at)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[at[rows][:, None] + np.arange(size)]


def _distances(x: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    if pivots is None:
        return np.zeros((len(x), 0))
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0))


def _pivots(sample: dict[int, list[np.ndarray]]) -> dict[int, np.ndarray]:
    chosen = {}
    for size, rows in sample.items():
        x = np.array(rows).reshape(len(rows), size)
        near, picks = _distances(x, x[:1])[:, 0], [0]
        while len(picks) < min(PIVOTS, len(x)):
            picks.append(int(near.argmax()))
            near = np.minimum(near, _distances(x, x[picks[-1:]])[:, 0])
        chosen[size] = x[picks]
    return chosen


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, ints, far): integer vectors with their distances to the pivots of their length."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                far = _distances(x, shared.value.get(x.shape[1]))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())) for m in (x, far)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *lists], ["vec_id", "ints", "far"])

    return rows.mapInArrow(measure, "vec_id bigint, ints array<double>, far array<double>")


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.found, self.least = k, [([], []) for _ in range(n)], np.full(n, -np.inf)

    def add(self, q: int, scores: list, ids: list) -> None:
        have = sorted(zip((-s for s in [*self.found[q][0], *scores]), [*self.found[q][1], *ids]))[: self.k]
        self.found[q] = [-s for s, _ in have], [i for _, i in have]
        if len(have) == self.k:
            self.least[q] = -have[-1][0]


def _eliminate(best: _Best, ids: np.ndarray, x: np.ndarray, far: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_far: np.ndarray) -> None:
    norms, q_norms = (x * x).sum(1), (q * q).sum(1)
    if len(x) and len(q) and np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1]) >= 2**53:
        whole = [[int(a) for a in row] for row in x]
        for k, row in enumerate(q):
            scores = [max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(row, v)))) for v in whole]
            other = [j for j in range(len(ids)) if ids[j] != q_ids[k]]
            best.add(k, [scores[j] for j in other], [int(ids[j]) for j in other])
        return
    for lo in range(0, len(q), STEP):
        hi = min(lo + STEP, len(q))
        low = np.zeros((hi - lo, len(x)))
        gap = np.empty_like(low)
        for p in range(min(FIRST, q_far.shape[1])):
            np.subtract(q_far[lo:hi, p, None], far[None, :, p], out=gap)
            np.maximum(low, np.abs(gap, out=gap), out=low)
        size = q_norms[lo:hi, None] + norms[None]
        bound = (size - low * low) / 2 + 1 + size * 1e-9
        for k in range(lo, hi):
            open_ = np.flatnonzero((bound[k - lo] >= best.least[k]) & (ids != q_ids[k]))
            row = bound[k - lo][open_]
            if len(open_) and q_far.shape[1] > FIRST:
                low_k = np.abs(far[open_, FIRST:] - q_far[k, FIRST:]).max(axis=1)
                row = np.minimum(row, (size[k - lo][open_] - low_k * low_k) / 2 + 1 + size[k - lo][open_] * 1e-9)
                left = row >= best.least[k]
                open_, row = open_[left], row[left]
            order = np.argsort(-row, kind="stable")
            for at in range(0, len(order), STEP):
                some = order[at : at + STEP]
                if row[some[0]] < best.least[k]:
                    break
                scores = x[open_[some]] @ q[k]
                good = scores >= best.least[k]
                best.add(k, scores[good].astype(np.int64).tolist(), ids[open_[some[good]]].tolist())


def _wave(index: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """The best rows of each task for queries of each vector length: (numbers, ids, vectors, pivot distances)."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: _Best(len(ids), k) for size, (_, ids, _, _) in shared.value.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                ids, far = part.column(0).to_numpy(), part.column(2)
                for at, x in matrices(part.column(1)):
                    if x.shape[1] in best:
                        own = far.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                        _eliminate(best[x.shape[1]], ids[at], x, own, *shared.value[x.shape[1]][1:])
        for size, b in best.items():
            numbers, ids, _, _ = shared.value[size]
            flat = [(int(n), int(q), i, s) for n, q, (scores, found) in zip(numbers, ids, b.found) for s, i in zip(scores, found)]
            for lo in range(0, len(flat), 1 << 16):
                cols = list(zip(*flat[lo : lo + (1 << 16)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query", "query_id", "vec_id", "score"])

    return index.mapInArrow(search, SCHEMA)


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query by integer inner product."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & finite(F.col("v")))
    ints = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = rows.select("vec_id", ints.alias("ints"), "asks")
    sample: dict[int, list[np.ndarray]] = defaultdict(list)
    for row in rows.select("ints").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
        sample[len(row[0])].append(np.array(row[0], float))
    pivots = _pivots(sample)
    index = table(pivot_table(rows.select("vec_id", "ints"), pivots), "pivot-table")
    answers, held, size = [], defaultdict(list), 0

    def flush() -> None:
        nonlocal held, size
        wave = {}
        for n, found in held.items():
            q = np.array([v for _, _, v in found], float).reshape(len(found), n)
            wave[n] = *(np.array([x[c] for x in found], np.int64) for c in (0, 1)), q, _distances(q, pivots.get(n))
        answers.append(table(_wave(index, wave, k), "pivot-answers"))
        held, size = defaultdict(list), 0

    for number, (vec_id, v) in enumerate(rows.where("asks").select("vec_id", "ints").toLocalIterator()):
        held[len(v)].append((number, vec_id, v))
        size += 40 * len(v) + 100
        if size >= WAVE_BYTES:
            flush()
    flush()
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    by = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
