"""Vectorised word and shingle hashes over Arrow buffers (no Python string per word).

A word is a run of bytes outside 0x20 and 0x09-0x0D after lower-casing A-Z, so
UTF-8 letters stay whole.  Word hashes are a 64-bit polynomial over random byte
codes, taken from differences of prefix sums and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

WIDTH = 5
STEP = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.random.default_rng(20240502).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _P), np.full(n, _INV)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and the n+1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of one text column (one row at least)."""
    for batch in batches:
        _, at = text_bytes(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()  # an idle worker need not keep a task's buffers


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and n+1 offsets of the rows into them."""
    raw, at = text_bytes(column)
    starts, ends, counts = spans(raw, at, _GAP)
    out, lo = [], 0
    while lo < len(starts):  # pieces of about STEP bytes that end between words
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + STEP, "right")))
        base, top = starts[lo], ends[hi - 1]
        out.append(_hashes(raw[base:top], starts[lo:hi] - base, ends[lo:hi] - base))
        lo = hi
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def spans(raw: np.ndarray, at: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``gaps``, and n+1 offsets of the rows into them."""
    gap = gaps[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(~gap & (np.r_[True, gap[:-1]] | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~gap & (np.r_[gap[1:], True] | edge[1:])) + 1 if len(raw) else starts
    return starts, ends, np.searchsorted(starts, at)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(max(STEP, 1 << int(len(raw)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_CODE[LOWER[raw]] * up[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT[7])


def shingle_rows(hashes: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each row its word sequence's shingles, sorted and distinct; fewer words than WIDTH make one."""
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - WIDTH + 1)
        wide = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            wide += hashes[k : n + k] * _MULT[k]
        wide = mix(wide)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            if hi - lo >= WIDTH:
                yield np.unique(wide[lo : hi - WIDTH + 1])
            elif hi > lo:
                yield mix(np.array([(hashes[lo:hi] * _MULT[: hi - lo]).sum() + _MULT[6] * np.uint64(hi - lo)], np.uint64))
            else:
                yield hashes[:0]
