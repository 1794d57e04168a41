"""Embedding whitening by a randomised range finder and Rayleigh-Ritz.

Entries become integers x = floor(64 c) + 1000000.  The fit list is all vectors; a pass sums it
exactly, further passes read all rows, centred as (n x - S) / n from exact integers.

1. *Range finder.*  A Gaussian block of ``COMPONENTS + OVERSAMPLE`` columns is multiplied by the
   covariance V, a pass over all centred rows in which tasks sum their share of V Q and Spark adds
   the shares by entry; the product's orthonormal basis is the block of the next power pass.
2. *Rayleigh-Ritz.*  The same product gives Q'VQ, whose eigenvectors turn Q into components, and
   the residual |V u - e u| of each.  When all wanted residuals are below ``RESIDUAL`` times the
   trace the components stand.  When a pass shrinks the worst by less than ``WORTH`` (a flat
   spectrum, where more passes are dearer than the whole), or after ``PASSES``, the block grows
   to the full dimension, where Rayleigh-Ritz is exact.
3. *Whitening.*  A pass over the whitened rows measures their covariance, and with it the largest
   entry by which it misses the identity; the last pass returns them.

What the driver holds is a basis of d by d numbers at most.  ``vectors`` is read once for each
pass: write it first if it is dear to make.

Vectors that are null or hold null or non-finite entries are dropped, as are those with an entry
past 2**52 / 64 in size, whose integers would not be exact.  Vectors of another length are fits of
their own, with their own n; empty vectors have no components.  A component whose eigenvalue is
within rounding of zero cannot be whitened and is not returned, so equal vectors, or one vector, give no rows.
``deviation`` is null where it passes 64 bits.  Null ids stay null, repeated rows are rows of the
fit and of the result, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilattice.llm.topk_search import finite, matrices

COMPONENTS, OVERSAMPLE = 32, 10
PASSES, WORTH = 8, 100.0
RESIDUAL = 1e-13
SCALE, SHIFT = 64, 1_000_000
#: Rows that a task centres at once.
ROWS = 4096
_CELL = "size int, what int, i int, j int, value double"
_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """The vectors of one length: count, exact sums, and what the passes have found."""

    n: int
    sums: list[int]
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    worst: float = np.inf
    done: bool = False
    error: float = 0.0

    @property
    def size(self) -> int:
        return len(self.sums)


def integers(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x).astype(np.int64) + SHIFT


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit integers where they hold it, else Python's."""
    largest = max(int(np.abs(x).max(initial=0)), 1)
    if n * largest + max(map(abs, sums), default=0) < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    """x - S / n, where the difference is exact and only the division rounds."""
    return offsets(x, fit.n, fit.sums).astype(np.float64) / fit.n


def deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """The sum of (n x - S)^2 for each row."""
    off = offsets(x, fit.n, fit.sums)
    if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * fit.size < 1 << 63:
        return (off * off).sum(axis=1).tolist()
    return [s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in off]


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(finite(F.col("v")) & F.forall("v", lambda x: F.abs(x) < float(1 << 52) / SCALE) & (F.size("v") > 0))


def _sums(rows: DataFrame) -> dict[int, Fit]:
    """For each length the count and the exact sums; tasks add up in 64 bits, Spark in decimals."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at, total, n = [], [], [], []
            for _, x in matrices(batch.column(0)):
                low, high = integers(x) & 0xFFFFFFFF, integers(x) >> 32  # halves, so that no sum of a batch overflows
                size += [x.shape[1]] * x.shape[1]
                at += range(x.shape[1])
                total += [(h << 32) + w for h, w in zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist())]
                n += [len(x)] * x.shape[1]
            halves = [[t >> 32 for t in total], [t & 0xFFFFFFFF for t in total]]
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(at, pa.int32()), *(pa.array(h, pa.int64()) for h in halves), pa.array(n, pa.int64())], ["size", "i", "high", "low", "n"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    cells = rows.select("v").mapInArrow(add, "size int, i int, high bigint, low bigint, n bigint")
    found: dict[int, Fit] = {}
    for r in cells.groupBy("size", "i").agg(exact("high"), exact("low"), F.sum("n").alias("n")).orderBy("size", "i").collect():
        found.setdefault(r["size"], Fit(r["n"], [])).sums.append((int(r["high"]) << 32) + int(r["low"]))
    return found


def _cells(rows: DataFrame, fits: dict[int, Fit], share) -> dict[int, dict[int, np.ndarray]]:
    """Adds up over all rows what ``share`` makes of a block of integer rows: {number: matrix} for each length."""
    sc = rows.sparkSession.sparkContext
    known = sc.broadcast(fits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                for _, x in matrices(batch.column(0).slice(lo, ROWS)):
                    fit = known.value.get(x.shape[1])
                    if fit is not None and not fit.done:
                        for what, part in share(integers(x), fit).items():
                            key = (x.shape[1], what)
                            held[key] = held[key] + part if key in held else part
        for (size, what), part in held.items():
            i, j = np.indices(part.shape)
            same = lambda v: pa.array(np.full(part.size, v, np.int32))
            yield pa.RecordBatch.from_arrays([same(size), same(what), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(part.ravel())], ["size", "what", "i", "j", "value"])

    summed = rows.select("v").mapInArrow(add, _CELL).groupBy("size", "what", "i", "j").agg(F.sum("value").alias("value")).toArrow()
    size, what, i, j, value = (summed.column(k).to_numpy() for k in range(5))
    out: dict[int, dict[int, np.ndarray]] = {}
    for s, w in sorted(set(zip(size.tolist(), what.tolist()))):
        at = (size == s) & (what == w)
        made = out.setdefault(s, {})[w] = np.zeros((i[at].max() + 1, j[at].max() + 1))
        made[i[at], j[at]] = value[at]
    known.destroy()
    return out


def _product(x: np.ndarray, fit: Fit) -> dict[int, np.ndarray]:
    """The rows' share of V Q and of V's trace."""
    c = centred(x, fit)
    return {0: c.T @ (c @ fit.basis) / fit.n, 1: np.array([[(c * c).sum() / fit.n]])}


def _ritz(fit: Fit, found: dict[int, np.ndarray], components: int) -> None:
    """Takes V Q: the components if they stand, else the basis of the next pass."""
    product, fit.trace = found[0], float(found[1][0, 0])
    inner = fit.basis.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    k = min(components, fit.size)
    vectors = fit.basis @ turn
    worst = float(np.linalg.norm(product @ turn[:, :k] - vectors[:, :k] * values[:k], axis=0).max())
    full = fit.basis.shape[1] == fit.size
    if full or worst <= RESIDUAL * fit.trace:
        keep = values[:k] > 1e-13 * fit.trace * fit.size
        fit.values, fit.vectors, fit.done = values[:k][keep], vectors[:, :k][:, keep], True
        return
    wide = fit.size if worst * WORTH > fit.worst else fit.basis.shape[1]
    fit.worst = worst
    more = np.random.default_rng([11, fit.size]).standard_normal((fit.size, wide - product.shape[1]))
    fit.basis = np.linalg.qr(np.concatenate([product, more], axis=1))[0]


def fitted(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of every length in rows(vec_id, v)."""
    fits = _sums(rows)
    for size, fit in fits.items():
        start = np.random.default_rng([7, size]).standard_normal((size, min(size, components + OVERSAMPLE)))
        fit.basis = np.linalg.qr(start)[0]
    passes = 0
    while any(not fit.done for fit in fits.values()):
        passes += 1
        for size, found in _cells(rows, fits, _product).items():
            if passes >= PASSES:
                fits[size].worst = 0.0  # no further pass is worth it
            _ritz(fits[size], found, components)
    for fit in fits.values():
        fit.basis, fit.done = np.zeros((0, 0)), not len(fit.values)
    for size, found in _cells(rows, fits, _whitened_moments).items():
        mean = found[1] / fits[size].n
        fits[size].error = float(np.abs(found[0] / fits[size].n - mean.T @ mean - np.eye(len(fits[size].values))).max())
    return fits


def _projected(x: np.ndarray, fit: Fit) -> np.ndarray:
    return centred(x, fit) @ fit.vectors / np.sqrt(fit.values)


def _whitened_moments(x: np.ndarray, fit: Fit) -> dict[int, np.ndarray]:
    w = _projected(x, fit)
    return {0: w.T @ w, 1: w.sum(axis=0, keepdims=True)}


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = _rows(vectors, id_col, vector_col)
    known = rows.sparkSession.sparkContext.broadcast(fitted(rows, components))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                for at, x in matrices(part.column(1)):
                    fit = known.value[x.shape[1]]
                    x, k = integers(x), len(fit.values)
                    each = lambda v, kind: pa.array(np.tile(v, len(x)), kind)
                    ids = part.column(0).take(pa.array(np.repeat(at, k)))
                    deviation = pa.array(deviations(x, fit), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                    columns = [ids, each(np.arange(1, k + 1, dtype=np.int32), pa.int32()), each(np.full(k, fit.n), pa.int64()), deviation, pa.array(_projected(x, fit).ravel()), each(fit.values / (fit.trace or 1.0), pa.float64()), each(np.full(k, fit.error), pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _OUT.split(", ")])

    return rows.mapInArrow(project, _OUT)
