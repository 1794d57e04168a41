"""Toxicity by weak supervision.

Voters are lexicon entries (words) and patterns (word beginnings) that mark toxic text, mined
on labelled training rows, and fixed patterns of style.  A generative label model, a latent
class with one firing rate for each voter and class, estimates the voters' accuracies by
expectation maximisation on their votes; in each step it also estimates the voters'
correlations among documents of the toxic class, and voters that fire together share their
worth.  A linear classifier on vote counts is trained on the model's posterior labels and
scores every document.

Labels are read only for training rows: crc32(id as text) mod 3 is not 1.  Of these at most
``SAMPLE`` are used, the smallest hashes of the id, up to ``SAMPLE_BYTES`` of text in that order;
rows are chosen by their sizes before any text moves, and repeated rows count once (near copies
once in mining).  One task fits the model; the driver sees only its parameters.
Scores depend on the text alone: not on id, language, source or labels.

Null and empty texts have no votes and get the classifier's base score.  Null ids are not
held out.  Repeated rows are scored each.  Without toxic training rows there are no voters and
every score is the base score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apilattice.llm.shingles import LOWER, mix, shingle_rows, slices, spans, text_bytes, words
from apilattice.llm.staging import small_batches

SAMPLE, SAMPLE_BYTES = 8000, 64 << 20
THRESHOLD = 0.7
#: A voter has at least so many toxic documents, or one in a hundred of the sample's if that is
#: more, and this share of toxic ones among its own.
SUPPORT, PRECISION = 4, 0.9
MOST_VOTERS = 400
#: The classifier's bias when there is no voter.
BASE = -6.0
#: Bytes of the word beginnings that may become patterns.
BEGINS = (4, 5, 6)
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_KIND = [np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(8)]


def terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, offsets) of each kind of term of every row: words, then beginnings of 4, 5 and 6 bytes.

    A beginning stands only for longer words, so that it never doubles a word.
    """
    raw, at = text_bytes(column)
    low = np.r_[LOWER[raw], np.zeros(24, np.uint8)]
    starts, ends, offsets = spans(raw, at, _GAP)
    size = ends - starts
    packed = []
    with np.errstate(over="ignore"):
        for part in range(3):
            value = np.zeros(len(starts), np.uint64)
            for k in range(8):
                here = 8 * part + k
                value |= np.where(size > here, low[np.minimum(starts + here, len(low) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
            packed.append(value)
        whole = mix(packed[0] + mix(packed[1] + mix(packed[2] + size.astype(np.uint64))))
        yield whole, offsets
        for kind, n in enumerate(BEGINS, 1):
            code = mix((packed[0] & np.uint64((1 << 8 * n) - 1)) ^ _KIND[kind])
            keep = size > n
            yield code[keep], np.r_[0, np.cumsum(keep)][offsets]


def _counts(codes: np.ndarray, offsets: np.ndarray, voters: np.ndarray) -> np.ndarray:
    """How often each voter (sorted codes) occurs in each row."""
    at = np.searchsorted(voters, codes)
    hit = np.flatnonzero((at < len(voters)) & (voters[np.minimum(at, len(voters) - 1)] == codes)) if len(voters) else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, hit, "right") - 1
    n = len(offsets) - 1
    return np.bincount(row * max(1, len(voters)) + at[hit], minlength=n * max(1, len(voters))).reshape(n, -1)[:, : len(voters)]


def style(column: pa.Array) -> np.ndarray:
    """Votes of fixed patterns: shouting, runs of exclamation marks, masked words."""
    raw, at = text_bytes(column)
    share = lambda m: np.diff(np.r_[0, np.cumsum(m)][at])
    letters = ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122))
    upper, bang, star = share((raw >= 65) & (raw <= 90)), share(raw == 33), share(raw == 42)
    return np.stack([upper > 0.6 * np.maximum(share(letters), 20), bang * 100 > np.maximum(np.diff(at), 200), star * 50 > np.maximum(np.diff(at), 200)], axis=1)


@dataclass
class Model:
    """Voters, what the label model found of them, and the classifier."""

    voters: list[np.ndarray]
    accuracies: np.ndarray
    correlations: np.ndarray
    weight: np.ndarray
    bias: float

    def votes(self, column: pa.Array) -> np.ndarray:
        """Counts of every voter for every row (the fixed patterns last)."""
        found = [_counts(codes, offsets, own) for (codes, offsets), own in zip(terms(column), self.voters)]
        return np.concatenate([*found, style(column)], axis=1).astype(float)

    def scores(self, column: pa.Array) -> np.ndarray:
        return _sigmoid(_inputs(self.votes(column)) @ self.weight + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _inputs(votes: np.ndarray) -> np.ndarray:
    """The classifier's inputs: damped counts, how many voters fire, and whether any does."""
    mined = votes[:, :-3]
    fired = (mined > 0).sum(1)
    return np.concatenate([np.log1p(votes), np.log1p(fired)[:, None], (fired > 0)[:, None], np.log1p(mined.sum(1))[:, None]], axis=1)


def _parts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Where each part of about 2 MB begins, and the part."""
    at = 0
    for batch in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), 0, 2 << 20):
        yield at, batch.column(0)
        at += batch.num_rows


def _mined(column: pa.Array, toxic: np.ndarray) -> list[np.ndarray]:
    """Sorted voter codes of each kind: terms over SUPPORT and PRECISION, the best of them.

    Terms of toxic documents with support are candidates; only these are counted in the rest.
    """
    kinds = 1 + len(BEGINS)
    own: list[list[np.ndarray]] = [[] for _ in range(kinds)]
    for _, part in _parts(column.filter(pa.array(toxic))):
        for kind, (codes, offsets) in enumerate(terms(part)):
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            _, once = np.unique(mix(codes ^ mix(row.astype(np.uint64))), return_index=True)
            own[kind].append(codes[once])
    support, marked = max(SUPPORT, int(toxic.sum()) // 100), []
    for kind in range(kinds):
        code, n = np.unique(np.concatenate(own[kind]) if own[kind] else np.zeros(0, np.uint64), return_counts=True)
        marked.append((code[n >= support], n[n >= support]))
    many = [np.zeros(len(code), np.int64) for code, _ in marked]
    for _, part in _parts(column):
        for kind, (codes, offsets) in enumerate(terms(part)):
            many[kind] += (_counts(codes, offsets, marked[kind][0]) > 0).sum(0)
    ranked = [(-int(m), int(m) - int(n), kind, int(c)) for kind, (code, ms) in enumerate(marked) for c, m, n in zip(code, ms, many[kind]) if m >= PRECISION * n]
    best = sorted(ranked)[:MOST_VOTERS]
    return [np.sort(np.array([c for _, _, k, c in best if k == kind], np.uint64)) for kind in range(kinds)]


def label_model(fires: np.ndarray, mined: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, accuracy of each voter, correlations of the voters) from votes alone.

    A voter that does not fire abstains; that none of the ``mined`` first ones fires is
    evidence of its own.  An accuracy is the share of the positive class among the documents
    for which a voter fires.  Correlations are those within the positive class; once the rates
    have settled, voters that fire together share one voter's worth in the posterior.  The
    start assumes only that mined voters fire for the positive class more often than not; of
    the fixed patterns it assumes nothing.
    """
    m = fires.shape[1]
    fires = np.c_[fires, ~fires[:, :mined].any(axis=1)].astype(float)
    worth, together = np.ones(m + 1), np.zeros((m + 1, m + 1))
    posterior = np.where(fires[:, m] > 0, 0.02, 0.9)
    rates = np.zeros((2, m + 1))
    for step in range(rounds):
        total = np.array([(1 - posterior).sum(), posterior.sum()])
        rates[0] = ((1 - posterior) @ fires + 0.05) / (total[0] + 1)
        rates[1] = (posterior @ fires + 0.5) / (total[1] + 1)
        if step >= 5:
            inside = (fires - rates[1]) * np.sqrt(posterior)[:, None]
            spread = np.sqrt((inside * inside).sum(0)) + 1e-9
            together = (inside.T @ inside) / spread[:, None] / spread
            np.fill_diagonal(together, 0)
            worth = (worth + 1 / (1 + (np.where(together > 0.5, together, 0) ** 2).sum(1))) / 2
        odds = np.log(total[1] + 1) - np.log(total[0] + 1)
        posterior = _sigmoid(odds + fires @ (worth * np.log(rates[1] / rates[0])))
    share = posterior.mean()
    accuracies = rates[1] * share / (rates[1] * share + rates[0] * (1 - share))
    return posterior, accuracies[:m], together[:m, :m]


def _linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, steps: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method."""
    x1 = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x1.shape[1]), np.full(x1.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x1 @ w)
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(ridge), x1.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(column: pa.Array, toxic: np.ndarray) -> Model:
    """Voters, label model and classifier from labelled texts."""
    seen: set[int] = set()
    fresh = np.zeros(len(column), bool)
    for at, part in _parts(column):
        for k, shingles in enumerate(shingle_rows(*words(part)), at):
            marks = {(j, int(mix(shingles ^ _KIND[j]).min())) for j in range(4)} if len(shingles) else set()
            fresh[k] = not marks & seen
            seen |= marks
    model = Model(_mined(column.filter(pa.array(fresh)), toxic[fresh]), np.zeros(0), np.zeros((0, 0)), np.zeros(0), BASE)
    mined = sum(map(len, model.voters))
    if not mined:
        model.weight = np.zeros(_inputs(np.zeros((1, 3))).shape[1])
        return model
    votes = np.concatenate([model.votes(part) for _, part in _parts(column)])
    posterior, model.accuracies, model.correlations = label_model(votes > 0, mined)
    model.weight, model.bias = _linear(_inputs(votes), posterior)
    return model


def held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled rows that are not held out, at most ``sample`` of them and ``sample_bytes`` of text."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("l_toxic")).where(F.col("l_id").isNotNull() & F.col("l_toxic").isNotNull() & ~held_out(F.col("l_id")))
    known = known.groupBy("l_id").agg(F.max("l_toxic").alias("l_toxic")).orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).cast("string").alias("d_text"))
    rows = rows.join(F.broadcast(known), F.col("d_id") == F.col("l_id")).withColumns({"d_hash": F.xxhash64("d_text"), "d_size": F.coalesce(F.octet_length("d_text"), F.lit(0)).cast("bigint")})
    order = [F.xxhash64("l_id"), F.col("l_id"), F.col("d_hash")]
    sizes = rows.where(F.col("d_size") <= sample_bytes).groupBy("l_id", "d_hash").agg(F.max("d_size").alias("d_size")).orderBy(*order).limit(sample)
    ahead = F.sum("d_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # of at most ``sample`` rows without texts
    picked = sizes.withColumn("ahead", ahead).where(F.col("ahead") <= sample_bytes).select(F.col("l_id").alias("p_id"), F.col("d_hash").alias("p_hash"))
    rows = rows.join(F.broadcast(picked), (F.col("l_id") == F.col("p_id")) & (F.col("d_hash") == F.col("p_hash")))
    rows = rows.groupBy("l_id", "d_hash").agg(F.max("d_text").alias("d_text"), F.max("l_toxic").alias("l_toxic"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [pa.array([], pa.string())], [np.zeros(0, bool)]
        for batch in batches:
            texts.append(batch.column(0))
            toxic.append(batch.column(1).to_numpy() == 1)
        model = fit(pa.concat_arrays(texts), np.concatenate(toxic))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = rows.repartition(1).sortWithinPartitions(*order).select("d_text", "l_toxic").mapInArrow(fitted, "model binary").first()
    return pickle.loads(found[0]) if found else fit(pa.array([], pa.string()), np.zeros(0, bool))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            found = shared.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(keep, docs.schema)
