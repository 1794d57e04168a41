"""Removal of repeated passages by sorting suffixes in buckets between sampled splitters.

A byte goes when it is covered by a 50-byte string that also starts in a document with a smaller
id.  Only suffixes that begin at anchors are sorted: an anchor of a string is the place of the
smallest hash among its 24-byte substrings, so equal strings have equal anchors at equal offsets,
every string has one, and about one byte in fourteen is one.

1. *Repeated anchors.*  Map tasks send 48-bit hashes of the substrings at anchors, once for each
   document, as binary blocks by hash range; reducers find those in several documents.  They come
   back as a bitmap of at most ``MOST_BITMAP`` bytes, where a fuller map lets more anchors through.
   The same pass samples suffixes; ``SAMPLES`` for each bucket give the splitters.
2. *Buckets.*  Each repeated anchor is a row (50 bytes from it, 26 bytes before it, document,
   place).  Splitters of (suffix, bytes before, document) deal them to buckets, so that a very
   common passage is split too, by document at last.  A bucket is sorted by a multikey quicksort that
   takes eight bytes at a time and all open runs of a round at once.  Neighbours' common prefixes
   then say, for each offset of the anchor in a string, which rows hold the same string, and their
   least document decides.  A row keeps one bit for each of its 27 strings.
3. *Across boundaries.*  A string goes on in another bucket only if its part from the anchor on is that of
   the first or the last row.  Such strings are sent once for each bucket, as 128-bit hashes with the least
   document there; where another bucket knows a smaller one, it comes back to the rows that wait for it:
   those whose whole context is in no smaller document of their bucket.
4. *Removal.*  Bits travel to the document's partition in packed arrays and meet its text there;
   a part holds about ``PART_BYTES`` of text.

A null text is empty.  A document without an id keeps its text and takes nothing from others.  Rows
with equal ids take nothing from each other; repeated rows come back as often as they came.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilattice.llm.ngram_join import Repeated, _bitmap, _packed, _unpacked
from apilattice.llm.shingles import mix, slices, text_bytes
from apilattice.llm.staging import smaller_batches, table

MATCH, KMER = 50, 24
#: Strings that may hold one anchor, and the bytes before it that they reach.
STRINGS = MATCH - KMER + 1
BEFORE = STRINGS - 1
CONTEXT = MATCH + BEFORE
KEY = CONTEXT + 8
MOST_BITMAP = 32 << 20
RANGE_BYTES, PART_BYTES, BUCKET_BYTES = 32 << 20, 16 << 20, 24 << 20
SAMPLES = 32
#: Bytes hashed at once; anchors that a task holds before it sends them.
STEP, FLUSH, FLUSH_HASHES = 1 << 16, 1 << 17, 1 << 20
_CODE = np.random.default_rng(20240701).integers(1, 1 << 63, 256, dtype=np.uint64)
_MULT = np.random.default_rng(20240702).integers(1, 1 << 62, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOUND = "kind int, part int, docs binary, hashes binary, at binary, masks binary, bucket int, win binary, low bigint, offsets binary"
_ENDS = "bucket int, kind int, win binary, least bigint, offsets binary, docs binary, hashes binary, at binary, masks binary"
_REST = "part int, kind int, doc_id bigint, th bigint, text string, docs binary, hashes binary, at binary, masks binary"
_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all 50-byte strings inside the rows raw[at[k]:at[k + 1]]."""
    places, hashes = [], []
    ends = at[1:-1]
    for lo in range(0, max(0, len(raw) - MATCH + 1), STEP):
        piece = raw[lo : lo + STEP + MATCH - 1]
        with np.errstate(over="ignore"):
            h, eight = _CODE[piece], None
            for k in range(4):  # hashes of 2, 4, 8, 16 bytes, then of 24
                wide = 1 << k
                h = h[:-wide] * _MULT[k] + h[wide:]
                eight = h if k == 2 else eight
            h = mix(h[:-8] * _MULT[4] + eight[16:]) | np.uint64(1)
        low = h
        for wide in (1, 2, 4, 8):
            low = np.minimum(low[:-wide], low[wide:])
        low = np.minimum(low[: 1 - STRINGS + 15], low[STRINGS - 16 :])
        near = ends[np.searchsorted(ends, lo) : np.searchsorted(ends, lo + len(piece))] - lo
        across = (near[:, None] - np.arange(1, MATCH)).ravel()
        low[across[(across >= 0) & (across < len(low))]] = 0
        high = np.concatenate([np.zeros(BEFORE, np.uint64), low, np.zeros(BEFORE, np.uint64)])
        for wide in (1, 2, 4, 8):
            high = np.maximum(high[:-wide], high[wide:])
        high = np.maximum(high[: 1 - STRINGS + 15], high[STRINGS - 16 :])
        found = np.flatnonzero(high == h)
        places.append(found + lo)
        hashes.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def contexts(raw: np.ndarray, at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bytes, after, before, row) of anchors: 50 bytes from each and 26 before it, the nearest first, and how many are there."""
    row = np.searchsorted(at, places, "right") - 1
    after, before = np.minimum(MATCH, at[row + 1] - places), np.minimum(BEFORE, places - at[row])
    wide = np.concatenate([np.zeros(BEFORE, np.uint8), raw, np.zeros(MATCH, np.uint8)])
    out = wide[places[:, None] + (BEFORE + np.concatenate([np.arange(MATCH), -1 - np.arange(BEFORE)]))]
    there = np.concatenate([np.arange(MATCH) < after[:, None], np.arange(BEFORE) < before[:, None]], axis=1)
    return out * there, after.astype(np.uint8), before.astype(np.uint8), row


def keys(context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sort keys of rows: suffix, bytes before, document."""
    last = (doc.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(np.concatenate([context, last], axis=1)).view(f"S{KEY}").ravel()


def multikey(words: np.ndarray) -> np.ndarray:
    """The sorted order of rows of words: each round sorts every run that is still equal by its next word."""
    order, run, open_ = np.arange(len(words)), np.zeros(len(words), np.int64), np.arange(len(words))
    for w in range(words.shape[1]):
        if not len(open_):
            break
        value, group = words[order[open_], w], run[open_]
        turn = np.lexsort((value, group))
        order[open_] = order[open_][turn]
        value = value[turn]
        first = np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])]
        run[open_] = open_[np.flatnonzero(first)][np.cumsum(first) - 1]
        alone = first & np.r_[first[1:], True]
        open_ = open_[~alone]
    return order


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words of eight, so that words compare as their bytes do."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def _common(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the one before it (0 for the first)."""
    if not len(rows):
        return np.zeros(0, np.int64)
    other = rows[1:] != rows[:-1]
    return np.r_[0, np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])]


def least(context: np.ndarray, after: np.ndarray, before: np.ndarray, common: np.ndarray, low: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """For each picked entry and offset o the least document among those that hold the same string.

    Entries are sorted by their suffix, ``common`` bytes of it shared with the entry before; a string
    is the o bytes before an anchor and the 50 - o after it.  2**63 - 1 where there is no such string.
    """
    out = np.full((len(pick), STRINGS), np.iinfo(np.int64).max)
    left = context[pick, MATCH:]
    by_left = multikey(_words(left))
    shared_left, rank = _common(left[by_left]), np.empty(len(pick), np.int64)
    for o in range(STRINGS):
        rank[by_left] = np.cumsum(shared_left < o)
        right = np.cumsum(common < MATCH - o)[pick]
        there = np.flatnonzero((after[pick] >= MATCH - o) & (before[pick] >= o))
        if len(there):
            same = right[there] * (len(pick) + 1) + rank[there]
            turn = np.argsort(same, kind="stable")
            first = np.flatnonzero(np.r_[True, same[turn][1:] != same[turn][:-1]])
            lows = np.minimum.reduceat(low[pick][there][turn], first)
            out[there[turn], o] = np.repeat(lows, np.diff(np.r_[first, len(there)]))
    return out


def _masks(lows: np.ndarray, entry: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A bit for each offset whose string is in a smaller document than the row's own."""
    mask = np.zeros(len(doc), np.uint32)
    for o in range(lows.shape[1]):
        mask |= (lows[entry, o] < doc).astype(np.uint32) << np.uint32(o)
    return mask


def _sent(part: np.ndarray, doc: np.ndarray, th: np.ndarray, pos: np.ndarray, mask: np.ndarray) -> list[tuple]:
    """Rows (part, docs, hashes, places, masks) as packed arrays, one for each part."""
    keep = np.flatnonzero(mask)
    keep = keep[np.lexsort((pos[keep], doc[keep], part[keep]))]
    part, doc, th, pos, mask = part[keep], doc[keep], th[keep], pos[keep], mask[keep]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    return [(int(part[a]), doc[a:b].tobytes(), th[a:b].tobytes(), pos[a:b].tobytes(), mask[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(part)])]


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    parts = [c.split(" ") for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[k]) for c, k in parts], [c for c, _ in parts])


def _surveyed(rows: DataFrame, ranges: int, buckets: int, rate: float) -> tuple[Repeated, np.ndarray]:
    """The bitmap of anchors that occur in several documents, and the splitters of the buckets."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, held, size, sample = np.random.default_rng(1), [], 0, []

        def blobs() -> pa.RecordBatch:
            short = np.sort(np.concatenate(held))
            part = (short * np.uint64(ranges)) >> np.uint64(48)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            made = [_packed(short[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(short)])]
            return pa.RecordBatch.from_arrays([pa.array([-1, *part[cuts].tolist()], pa.int32()), pa.array([b"".join(sample), *made], pa.binary())], ["block", "blob"])

        for batch in slices(batches, 2):
            raw, at = text_bytes(batch.column(2))
            places, hashes = anchors(raw, at)
            row = np.searchsorted(at, places, "right") - 1
            some = np.flatnonzero(rng.random(len(places)) < rate)
            if len(some):
                context, _, _, k = contexts(raw, at, places[some])
                sample.append(keys(context, batch.column(0).to_numpy()[k]).tobytes())
            short = hashes >> np.uint64(16)
            turn = np.lexsort((short, row))
            short, row = short[turn], row[turn]
            once = np.r_[True, (short[1:] != short[:-1]) | (row[1:] != row[:-1])][: len(short)]
            held.append(short[once])
            size += len(held[-1])
            if size >= FLUSH_HASHES:
                yield blobs()
                held, size, sample = [], 0, []
        if size:
            yield blobs()

    def found(block: int, held: list[bytes]) -> pa.RecordBatch:
        if block < 0:
            sample = np.sort(np.frombuffer(b"".join(held), f"S{KEY}"))
            made = sample[np.linspace(0, len(sample), buckets + 1).astype(int)[1:-1]].tobytes() if len(sample) else b""
        else:
            values = np.sort(np.concatenate([_unpacked(b) for b in held]))
            again = values[1:][values[1:] == values[:-1]]
            made = _bitmap(np.unique(again), MOST_BITMAP // ranges)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([made], pa.binary())], ["block", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != now and held:
                    yield found(now, held)
                now = block
                held.append(blob)
        if held:
            yield found(now, held)

    blobs = rows.mapInArrow(spread, "block int, blob binary").repartition(min(ranges, 1 << 15), "block").sortWithinPartitions("block")
    kept = blobs.mapInArrow(gather, "block int, blob binary").toArrow()
    made = dict(zip(kept.column(0).to_pylist(), kept.column(1)))
    segments = [made[k].as_buffer() if k in made else bytes(8) for k in range(ranges)]
    splitters = np.frombuffer(made[-1].as_buffer(), f"S{KEY}") if -1 in made else np.zeros(0, f"S{KEY}")
    return Repeated(segments), splitters


def _dealt(rows: DataFrame, shared) -> DataFrame:
    """(bucket, blob): the repeated anchors with their contexts, sorted, as compressed blocks for each bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, splitters = shared.value
        held, size = [], 0

        def blobs() -> pa.RecordBatch:
            context, after, before, doc, th, part, pos = (np.concatenate(x) for x in zip(*held))
            key = keys(context, doc)
            bucket = np.searchsorted(splitters, key, "right")
            turn = np.argsort(key, kind="stable")
            bucket, context = bucket[turn], np.ascontiguousarray(context[turn])
            columns = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(CONTEXT), len(turn), [None, pa.py_buffer(context)]), *(pa.array(x[turn]) for x in (after, before, doc, th, part, pos))]
            whole = pa.RecordBatch.from_arrays(columns, list("cabdhpo"))
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            made = []
            for a, b in zip(cuts, np.r_[cuts[1:], len(turn)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(whole.slice(a, b - a))
                made.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array(made, pa.binary())], ["bucket", "blob"])

        for batch in slices(batches, 2):
            raw, at = text_bytes(batch.column(2))
            places, hashes = anchors(raw, at)
            places = places[repeated.may_hold(hashes >> np.uint64(16))] if len(places) else places
            for lo in range(0, len(places), FLUSH):
                context, after, before, row = contexts(raw, at, places[lo : lo + FLUSH])
                doc, th, part = (batch.column(k).to_numpy()[row] for k in (0, 1, 3))
                held.append((context, after, before, doc, th, part, places[lo : lo + FLUSH] - at[row]))
                size += len(row)
                if size >= FLUSH:
                    yield blobs()
                    held, size = [], 0
        if size:
            yield blobs()

    return rows.mapInArrow(deal, "bucket int, blob binary")


def _bucket(bucket: int, blobs: list[bytes]) -> Iterator[dict]:
    """The bits of one bucket's rows, the strings that may go on in other buckets, and the rows that wait for these."""
    rows = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]).combine_chunks()
    blobs.clear()
    if not len(rows):
        return
    flat = rows.column(0).chunk(0)
    context = np.frombuffer(flat.buffers()[1], np.uint8)[flat.offset * CONTEXT : (flat.offset + len(flat)) * CONTEXT].reshape(-1, CONTEXT)
    after, before, doc, th, part, pos = (rows.column(k).to_numpy() for k in range(1, 7))
    last = doc.view(np.uint64) ^ np.uint64(1 << 63)
    order = multikey(np.concatenate([_words(context), last[:, None]], axis=1))
    context, after, before, doc, th, part, pos = (x[order] for x in (context, after, before, doc, th, part, pos))
    common = _common(context)
    first = np.flatnonzero((common < CONTEXT) | np.r_[True, (after[1:] != after[:-1]) | (before[1:] != before[:-1])])
    entry = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(doc)]))
    common = np.minimum(common[first], MATCH)
    run = np.cumsum(common < KMER) - (common[0] < KMER)  # of equal substrings at the anchor
    begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    low = doc[first]
    lowest = np.minimum.reduceat(low, begin)
    highest = np.maximum.reduceat(np.maximum.reduceat(doc, first), begin)
    edge = (run == 0) | (run == run[-1])
    pick = np.flatnonzero((lowest < highest)[run] | edge)
    context, after, before = context[first], after[first], before[first]
    lows = np.full((len(first), STRINGS), np.iinfo(np.int64).max)
    lows[pick] = least(context, after, before, common, low, pick)
    for made in _sent(part, doc, th, pos, _masks(lows, entry, doc)):
        yield dict(zip(("part", "docs", "hashes", "at", "masks"), made)) | {"kind": 0}

    reach = np.full(len(first), MATCH)  # how much each suffix shares with the first or the last one
    if len(first) > 1:
        reach = np.maximum(np.r_[MATCH, np.minimum.accumulate(common[1:])], np.r_[np.minimum.accumulate(common[:0:-1])[::-1], MATCH])
    told: set[bytes] = set()
    ends = np.r_[first[1:], len(doc)]
    for k in np.flatnonzero(edge).tolist():
        text, back = context[k, :MATCH].tobytes(), context[k, MATCH:][::-1].tobytes()
        wait, wins = [], []
        for o in range(MATCH - min(int(after[k]), int(reach[k])), int(before[k]) + 1):
            win = hashlib.blake2b(back[BEFORE - o :] + text[: MATCH - o], digest_size=16).digest()
            if win not in told:
                told.add(win)
                yield {"kind": 1, "bucket": bucket, "win": win, "low": int(lows[k, o])}
            if lows[k, o] == low[k]:
                wait.append(o)
                wins.append(win)
        if wait:
            at = np.arange(first[k], ends[k])
            at = at[doc[at] == low[k]]
            yield {"kind": 2, "bucket": bucket, "win": b"".join(wins), "offsets": bytes(wait), "docs": doc[at].tobytes(), "hashes": th[at].tobytes(), "at": pos[at].tobytes(), "masks": part[at].tobytes()}


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (bucket, blob) in the order of buckets -> rows of _FOUND."""
    now, held = None, []

    def rows(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for row in _bucket(bucket, blobs):
            made.append(row)
            if len(made) >= 8192:
                yield _batch(made, _FOUND)
                made = []
        if made:
            yield _batch(made, _FOUND)

    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now and held:
                yield from rows(now, held)
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield from rows(now, held)


def _across(found: DataFrame, buckets: int) -> DataFrame:
    """The bits that rows gain from other buckets, as rows of _REST."""
    told = found.where("kind = 1").select("bucket", "win", "low")
    known = told.groupBy("win").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most")
    news = told.join(table(known.select("win", "least"), "suffix-news"), "win").where("least < low")
    names = [c.split(" ") for c in _ENDS.split(", ")]
    news = news.select(*(F.lit(0).alias(c) if c == "kind" else F.col(c) if c in ("bucket", "win", "least") else F.lit(None).cast(k).alias(c) for c, k in names))
    waits = found.where("kind = 2").select(*(F.lit(None).cast(k).alias(c) if c == "least" else F.col(c) for c, k in names))

    def gained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least_of = None, {}
        for batch in batches:
            held: list[list[np.ndarray]] = []
            at = [batch.column(k).to_pylist() for k in range(5)]
            for r, (bucket, kind, win, low, offsets) in enumerate(zip(*at)):
                if bucket != now:
                    now, least_of = bucket, {}
                if kind == 0:
                    least_of[win] = low
                    continue
                heard = [(o, least_of[w]) for k, o in enumerate(offsets) if (w := win[16 * k : 16 * k + 16]) in least_of]
                if heard:
                    doc, th, pos, part = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in ((5, np.int64), (6, np.int64), (7, np.int64), (8, np.int32)))
                    mask = sum((low < doc).astype(np.uint32) << np.uint32(o) for o, low in heard)
                    held.append([part, doc, th, pos, mask])
            if held:
                made = _sent(*(np.concatenate(x) for x in zip(*held)))
                yield _batch([dict(zip(("part", "docs", "hashes", "at", "masks"), m)) | {"kind": 0} for m in made], _REST)

    return news.unionByName(waits).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(gained, _REST)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _REST, a part's bits before its texts -> the result's rows."""
    now, held, known = None, [], None
    for batch in batches:
        made: list[dict] = []
        part, kind, doc, th = (batch.column(k).to_pylist() for k in range(4))
        texts = batch.column(4).cast(pa.large_binary())
        for r in range(batch.num_rows):
            if part[r] != now:
                now, held, known = part[r], [], None
            if kind[r] == 0:
                held.append([np.frombuffer(batch.column(k)[r].as_buffer(), t) for k, t in ((5, np.int64), (6, np.int64), (7, np.int64), (8, np.uint32))])
                continue
            if known is None:
                known = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0, np.int64)] * 4
                order = np.argsort(known[0], kind="stable")
                known, held = [x[order] for x in known], []
            text = texts[r].as_buffer() if texts[r].is_valid else pa.py_buffer(b"")
            made.append(_kept(doc[r], th[r], memoryview(text), known))
        if made:
            yield _batch(made, _RESULT)


def _kept(doc: int | None, th: int, text: memoryview, known: list[np.ndarray]) -> dict:
    state, end, removed, spans = hashlib.sha256(), 0, 0, 0
    if doc is not None:
        docs, hashes, pos, mask = (x[slice(*np.searchsorted(known[0], [doc, doc + 1]))] if doc < np.iinfo(np.int64).max else x[np.searchsorted(known[0], doc) :] for x in known)
        mine = np.flatnonzero(hashes == th)
        row, o = np.nonzero((mask[mine][:, None] >> np.arange(STRINGS, dtype=np.uint32)) & np.uint32(1))
        starts = np.unique(pos[mine][row] - o)
        cuts = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + MATCH]) if len(starts) else []
        for a, b in zip(cuts, [*cuts[1:], len(starts)]):
            lo, hi = int(starts[a]), int(starts[b - 1]) + MATCH
            state.update(text[end:lo])
            end, removed, spans = hi, removed + hi - lo, spans + 1
    state.update(text[end:])
    return {"doc_id": doc, "n_bytes": len(text), "n_removed": removed, "n_spans": spans, "kept_sha256": state.hexdigest()}


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    with smaller_batches(docs.sparkSession):
        return _deduplicated(docs, id_col, text_col)


def _deduplicated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, buckets, parts = (max(least_parts, size // most) for most in (RANGE_BYTES, BUCKET_BYTES // 4, PART_BYTES))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "th"), F.lit(parts)).cast("int"))
    long_ = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= MATCH))
    shared = spark.sparkContext.broadcast(_surveyed(long_, ranges, buckets, min(1.0, SAMPLES * buckets / (0.07 * size + 1))))
    blobs = _dealt(long_, shared).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = table(blobs.mapInArrow(_compared, _FOUND), "suffix-found")
    shared.destroy()
    names = [c.split(" ")[0] for c in _REST.split(", ")]
    void = {"doc_id": "bigint", "th": "bigint", "text": "string"}
    inside = found.where("kind = 0").select(*(F.lit(None).cast(void[c]).alias(c) if c in void else F.col(c) for c in names))
    texts = rows.withColumn("kind", F.lit(1)).select(*(F.col(c) if c in ("part", "kind", "doc_id", "th", "text") else F.lit(None).cast("binary").alias(c) for c in names))
    rest = inside.unionByName(_across(found, buckets)).unionByName(texts)
    return table(rest.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_removed, _RESULT), "suffix-result")
