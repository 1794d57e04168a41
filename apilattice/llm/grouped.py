"""Groups of rows out of a sorted stream of Arrow batches, without a Python call per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal values in the first ``keys`` columns (integers, not null)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and any(held[0].column(k)[0].as_py() != int(key[k, 0]) for k in range(keys)):
            yield _joined(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield _joined(held)
                held = []
    if held:
        yield _joined(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's smallest reachable node number over links a-b of nodes 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
