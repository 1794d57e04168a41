"""Byte-level BPE by overlapping chunks, and its decoding.

Long texts are cut into chunks that overlap.  Each chunk is pre-tokenised by itself, in
parallel, and its pieces are encoded.  The pattern looks ahead only, so from any place where
two pre-tokenisations both end a piece they agree: neighbours are stitched at the first such
place of their overlap, where they resynchronise.  Matches within AHEAD
characters of a chunk's end are not trusted.  Where an overlap has no common place (one run of letters, say) the text is
pre-tokenised onward from the last sound place until it meets a later chunk's boundaries.
Short texts are one chunk.  Decoding concatenates the tokens' raw bytes.

Ranks are read on the driver from a file whose path is a parameter, and broadcast (a
vocabulary has a fixed size).  Pieces are matched with ``\\s`` spelled out, as the property
White_Space, since libraries differ on it.

Null and empty texts have no tokens.  Repeated rows are encoded each; other columns pass by.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilattice.llm.shingles import slices
from apilattice.llm.staging import small_batches

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHUNK = 1 << 15
OVERLAP = 1 << 9
CACHE = 50_000
#: A match can depend on so many characters from its start beyond itself (the contractions).
AHEAD = 4


def load_ranks(path: str = PATH) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def compiled(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    spelled = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return regex.compile(spelled)


class Pieces(dict):
    """Piece -> token ids as little-endian bytes; forgets all when it has grown to CACHE pieces."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.encode = tiktoken.Encoding("ranks", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary  # takes a piece whole

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece), "<u4").tobytes()
        if len(piece) <= 32:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Coder:
    def __init__(self, ranks: dict[bytes, int], chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.find, self.pieces, self.chunk, self.overlap = compiled(), Pieces(ranks), chunk, overlap

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find.findall(text)))

    def part(self, text: str, start: int, last: bool) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Ends of the trusted pieces of a chunk that begins at ``start``, where each one's ids begin, and all ids."""
        found = self.find.findall(text)
        ends = start + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        if not last and len(ends):
            sound = int(np.searchsorted(ends, ends[-1] - AHEAD, "right"))
            ends, found = ends[:sound], found[:sound]
        ids = [self.pieces[p] for p in found]
        return ends, np.cumsum([0, *map(len, ids)]), b"".join(ids)

    def stitch(self, parts: list[tuple[int, str, np.ndarray, np.ndarray, bytes]]) -> bytes:
        """The ids of a whole text from its chunks (start, text, ends, cuts, ids) in order."""
        out: list[bytes] = []
        at, k, lo = 0, 0, 0
        while True:
            _, _, ends, cuts, ids = parts[k]
            if k + 1 == len(parts):
                out.append(ids[cuts[lo] :])
                return b"".join(out)
            start, _, next_ends, _, _ = parts[k + 1]
            begin = max(lo, int(np.searchsorted(ends, start)))
            tail = ends[begin:]
            common = np.flatnonzero(np.isin(tail, next_ends) | (tail == start))
            if len(common):
                hi = begin + int(common[0])
                out.append(ids[cuts[lo] : cuts[hi + 1]])
                at, k = int(ends[hi]), k + 1
            else:  # no common place: go on from the last sound one
                out.append(ids[cuts[lo] :])
                at = int(ends[-1]) if len(ends) > lo else at
                k, at, more = self._onward(parts, k, at)
                out += more
                if k == len(parts):
                    return b"".join(out)
            lo = 0 if at == parts[k][0] else int(np.searchsorted(parts[k][2], at)) + 1

    def _onward(self, parts: list, k: int, at: int) -> tuple[int, int, list[bytes]]:
        """Pre-tokenises from ``at`` until a boundary of a later chunk; the chunk, the place, the ids."""
        text, upto, more = parts[k][1][at - parts[k][0] :], k + 1, []
        while True:
            if upto < len(parts):
                have = at + len(text)
                text += parts[upto][1][have - parts[upto][0] :]
            last = upto + 1 >= len(parts)
            known = {*parts[upto][2].tolist(), parts[upto][0]} if upto < len(parts) else set()
            here = at
            trusted: list[str] = []
            for m in self.find.finditer(text):
                if m.end() > len(text) - AHEAD and not last:
                    break
                trusted.append(m.group())
                here += len(m.group())
                if here in known and here >= parts[upto][0]:
                    return upto, here, more + [self.pieces[p] for p in trusted]
            more += [self.pieces[p] for p in trusted]
            text, at = text[here - at :], here
            if last:
                return len(parts), here, more
            upto += 1


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text", raw: bool = False) -> DataFrame:
    """(doc_id, ids): the token ids of every row as little-endian unsigned 32-bit integers.

    raw: also the bytes that the ids decode to, joined in the same tasks.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks() if ranks is None else ranks)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, chunk, overlap)
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.encode(t) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, chunk, overlap)
        for batch in slices(batches, 4):
            ends, cuts, ids = [], [], []
            for start, last, t in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                e, c, found = coder.part(t, start, last)
                ends.append(e.astype(np.int32).tobytes())
                cuts.append(c.astype(np.int32).tobytes())
                ids.append(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 2, 4)), *(pa.array(x, pa.binary()) for x in (ends, cuts, ids))], ["uid", "doc_id", "start", "text", "ends", "cuts", "ids"])

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, chunk, overlap)
        held, uid, doc = [], None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([coder.stitch(held)], pa.binary())], ["doc_id", "ids"])
        for batch in batches:
            for row in batch.to_pylist():
                if row["uid"] != uid and held:
                    yield made()
                    held = []
                uid, doc = row["uid"], row["doc_id"]
                held.append((row["start"], row["text"], np.frombuffer(row["ends"], np.int32), np.frombuffer(row["cuts"], np.int32), row["ids"]))
        if held:
            yield made()

    schema = "doc_id bigint, ids binary" + ", raw binary" * raw
    also = lambda code: (lambda batches: _joined(code(batches), shared.value)) if raw else code
    short = rows.where(F.length("text") <= chunk).mapInArrow(also(whole), schema)
    long_ = rows.where(F.length("text") > chunk).withColumn("uid", F.monotonically_increasing_id())
    long_ = long_.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))))
    last = F.col("start") + chunk >= F.length("text")
    long_ = long_.select("uid", "doc_id", "start", last.alias("last"), F.substring("text", F.col("start") + 1, F.lit(chunk + overlap)).alias("text"))
    coded = long_.repartition("uid", "start").mapInArrow(parts, "uid bigint, doc_id bigint, start int, text string, ends binary, cuts binary, ids binary")
    joined = coded.repartition("uid").sortWithinPartitions("uid", "start").mapInArrow(also(stitched), schema)
    return short.union(joined)


def _joined(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, ids) with the raw bytes of the ids."""
    token = {i: b for b, i in ranks.items()}.__getitem__
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            raw = [b"".join(map(token, np.frombuffer(x.as_buffer(), "<u4").tolist())) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], ["doc_id", "ids", "raw"])


def decode(coded: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """``coded`` (doc_id, ids) with the decoded raw bytes."""
    shared = coded.sparkSession.sparkContext.broadcast(load_ranks() if ranks is None else ranks)
    return coded.select("doc_id", "ids").mapInArrow(lambda batches: _joined(batches, shared.value), "doc_id bigint, ids binary, raw binary")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``."""
    done = encode(docs, raw=True)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
