"""N-gram Jaccard join by token-combination prefixes.

Documents are sets of five-word shingles; two link when 100 * |A & B| >= 80 * |A | B|.

1. *Token classes.*  One pass counts every shingle of every document.  Map tasks send
   48-bit hashes as binary blocks by hash range, reducers sort one range after another; there
   are so many ranges that one holds about ``RANGE_BYTES``, however large the input is.
   Shingles in more than ``RARE`` documents are the frequent class, the others the rare one.
2. *Extended prefixes.*  A document of n shingles can lose e = n - ceil(0.8 n) of them and
   still link.  In the global order (rare by hash, then frequent by sub-class and hash) its
   prefix grows until it holds e + 1 effective tokens: a rare token counts one, a sub-class
   of m frequent tokens counts m - 1.  Linked documents then share a rare token or two
   tokens of one sub-class, so rare tokens are indexed singly and frequent ones as pairs.
   The number of sub-classes follows the document's size level; a document is indexed on
   its level and the next, so linked documents (sizes within 0.8) meet on one of them.
   Sets under four shingles link only when equal and are indexed as one whole combination.
3. *Verify.*  Equal word sequences collapse to one node first.  In each index list the most
   typical node (fewest rare shingles), its hub, is compared with the others.  Then, as
   nothing but components is asked for, only pairs of different components are still open:
   the lists of one hub are bundled, a bundle is dealt out as pairs of blocks, and each task
   compares all its open pairs of fitting size and returns a spanning forest of the links.
   Blocks hold a number of nodes and of shingles.  Comparison intersects whole sets; no step
   emits the pairs of a group.

Two tables are broadcast, both of bounded size at any input.  Of the frequent shingles at
most ``MOST_FREQUENT`` form the class: a hash range with more than its share of shingles over
``RARE`` keeps the most frequent.  Classes steer the work, not the result, as long as all
documents use the same.  A bitmap of repeated shingles spares the index those that occur
once; it has at most ``MOST_BITMAP`` bytes, where a fuller map lets more of them through.

Null or blank texts have no shingles, are linked with nothing and are their own component.
Null ids stay null; a component's id is its smallest id that is not null.  Repeated rows are
returned as often as they came.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilattice.llm.graph import components
from apilattice.llm.grouped import forest, groups
from apilattice.llm.shingles import mix, shingle_rows, slices, words
from apilattice.llm.staging import smaller_batches, table

PERCENT = 80
RARE = 8
MOST_BITMAP = 32 << 20
MOST_FREQUENT = 3 << 20
#: Hashes of a range that is counted at once, and the most ranges.
RANGE_BYTES, MOST_RANGES = 32 << 20, 1 << 20
#: Nodes to look up again are broadcast up to so many bytes, else joined.
MOST_BYTES = 16 << 20
#: Nodes of a bundle are compared in pairs of blocks of so many nodes and shingles.
BLOCK, BLOCK_SHINGLES = 128, 1 << 19
#: A step between size levels; over 1 / 0.8, so that linked sizes are at most one level apart.
LEVEL = 1.26
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_PART = np.uint64(0xA0761D6478BD642F)


def _short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


def _packed(values: np.ndarray) -> bytes:
    """Sorted 48-bit values: the first and 32-bit gaps, or whole if a gap is larger."""
    gaps = np.diff(values)
    if len(gaps) and int(gaps.max()) >= 1 << 32:
        return b"\0" + values.tobytes()
    return b"\1" + values[:1].tobytes() + gaps.astype(np.uint32).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    if blob[0] == 0:
        return np.frombuffer(blob, np.uint64, -1, 1)
    gaps = np.frombuffer(blob, np.uint32, -1, 9).astype(np.uint64)
    return np.cumsum(np.r_[np.frombuffer(blob, np.uint64, 1, 1), gaps], dtype=np.uint64)


class Repeated:
    """A bitmap for each hash range of the shingles that occur more than once; sizes are powers of two."""

    def __init__(self, segments: list) -> None:
        self.at = np.cumsum([0] + [len(s) for s in segments])
        self.n_bits = np.array([8 * len(s) for s in segments], np.uint64)
        self.bits = np.frombuffer(b"".join(segments), np.uint8)

    def may_hold(self, short: np.ndarray) -> np.ndarray:
        block = (short * np.uint64(len(self.n_bits))) >> np.uint64(48)
        slot = mix(short) % self.n_bits[block]
        return (self.bits[self.at[block] + (slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _bitmap(short: np.ndarray, most: int) -> bytes:
    """8 to 16 bits for each value, in a power of two of bytes up to ``most``."""
    size = 1 << max(3, len(short).bit_length())
    bits = np.zeros(max(8, min(size, 1 << (max(8, most).bit_length() - 1))), np.uint8)
    slot = mix(short) % np.uint64(8 * len(bits))
    np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
    return bits.tobytes()


def _n_ranges(rows: DataFrame) -> int:
    """Hash ranges: one for each shuffle partition, or as many as keep one to about RANGE_BYTES."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >> 60:  # not a scan of files
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, 2 * size // RANGE_BYTES))


def _counted(rows: DataFrame, ranges: int) -> DataFrame:
    """(block, bitmap, frequent): for each hash range a bitmap of its repeated shingles, and the frequent ones."""
    flush = max(1 << 20, min(1 << 23, 8 * ranges))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blobs(held: np.ndarray) -> pa.RecordBatch:
            held.sort()
            part = (held * np.uint64(ranges)) >> np.uint64(48)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            made = [_packed(held[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(held)])]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(made, pa.binary())], ["block", "blob"])

        parts, size = [], 0
        for batch in slices(batches, 0):
            for tokens in shingle_rows(*words(batch.column(0))):
                parts.append(_short(tokens))
                size += len(tokens)
            if size >= flush:
                yield blobs(np.concatenate(parts))
                parts, size = [], 0
        if size:
            yield blobs(np.concatenate(parts))

    def counted(block: int, held: list[bytes]) -> pa.RecordBatch:
        values = np.concatenate([_unpacked(b) for b in held])
        held.clear()
        values.sort()
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        many = np.diff(np.r_[first, len(values)])
        often = np.flatnonzero(many > RARE)
        if len(often) > share:
            often = often[many[often] > np.partition(many[often], -share - 1)[-share - 1]] if share else often[:0]
        made = [_bitmap(values[first[many > 1]], MOST_BITMAP // ranges), values[first[often]].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([b], pa.binary()) for b in made)], ["block", "bitmap", "frequent"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, []
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != at and held:
                    yield counted(at, held)
                at = block
                held.append(blob)
        if held:
            yield counted(at, held)

    share = MOST_FREQUENT // ranges
    blobs = rows.mapInArrow(spread, "block int, blob binary").repartition(min(ranges, 1 << 15), "block").sortWithinPartitions("block")
    return blobs.mapInArrow(gather, "block int, bitmap binary, frequent binary")


def _bounded(counts: DataFrame, ranges: int) -> tuple[Repeated, np.ndarray]:
    """The bitmap of repeated shingles and the sorted frequent ones; both have a bounded size."""
    kept = counts.toArrow().sort_by("block")
    bitmaps = dict(zip(kept.column(0).to_pylist(), kept.column(1)))
    segments = [bitmaps[k].as_buffer() if k in bitmaps else bytes(8) for k in range(ranges)]
    return Repeated(segments), np.frombuffer(b"".join(x.as_buffer() for x in kept.column(2)), np.uint64)


def _pairs_of(tokens: np.ndarray, need: int, n: int) -> np.ndarray:
    """Signatures of the frequent part of a prefix that must hold ``need`` effective tokens."""
    out, level = [], int(np.log(n) / np.log(LEVEL))
    with np.errstate(over="ignore"):
        for at in (level, level + 1):
            parts = max(1, int(0.4 * LEVEL ** (at - 1)))
            sub = mix(tokens * _PART) % np.uint64(parts)
            order = np.lexsort((tokens, sub))
            sub, held = sub[order], tokens[order]
            later = np.r_[False, sub[1:] == sub[:-1]]
            end = int(np.searchsorted(np.cumsum(later), need)) + 1
            sub, held = sub[:end], held[:end]
            gap = 1
            while gap < len(held):
                same = sub[gap:] == sub[:-gap]
                if not same.any():
                    break
                out.append(mix(held[:-gap][same] * _PAIR + mix(held[gap:][same] + np.uint64(at))))
                gap += 1
    return np.concatenate(out) if out else tokens[:0]


def signatures(tokens: np.ndarray, frequent: np.ndarray, repeated) -> tuple[np.ndarray, int]:
    """The index keys of one sorted set, and how many of its shingles are rare.

    frequent: a mask over the set; repeated(x): a mask of the shingles that may occur elsewhere.
    """
    n = len(tokens)
    rare = tokens[~frequent]
    if n < 4:
        with np.errstate(over="ignore"):
            return mix(np.array([(mix(tokens) * _PAIR).sum() + np.uint64(n)], np.uint64)), len(rare)
    need = n - (PERCENT * n + 99) // 100 + 1
    single = rare[:need]
    single = single[repeated(single)]
    if len(rare) >= need:
        return single, len(rare)
    return np.concatenate([single, _pairs_of(tokens[frequent], need - len(rare), n)]), len(rare)


def _signed(rows: DataFrame, shared) -> DataFrame:
    """A row for each document: id, text hash, node, size, rare shingles and index keys; shared: :func:`_bounded`, broadcast."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, few = shared.value
        elsewhere = lambda x: repeated.may_hold(_short(x))
        for batch in slices(batches, 2):
            hashes, at = words(batch.column(2))
            made: list[tuple] = []
            for k, tokens in enumerate(shingle_rows(hashes, at)):
                if not len(tokens):
                    made.append((None, 0, 0, None))
                    continue
                known = np.zeros(len(tokens), bool)
                if len(few):
                    s = _short(tokens)
                    known = few[np.minimum(np.searchsorted(few, s), len(few) - 1)] == s
                keys, rare = signatures(tokens, known, elsewhere)
                made.append((_node(hashes[at[k] : at[k + 1]]), len(tokens), rare, keys.view(np.int64) if len(keys) else None))
            node, n, rare, keys = zip(*made) if made else ((), (), (), ())
            arrays = [pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(rare, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], ["doc_id", "th", "node", "n", "rare", "keys"])

    return rows.mapInArrow(sign, "doc_id bigint, th bigint, node binary, n bigint, rare bigint, keys array<bigint>")


def _node(hashes: np.ndarray) -> bytes:
    """128 bits of a word sequence."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sets(rows: DataFrame, ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, tokens): whole sets of the nodes in ends(id), read again from the text of one document of each."""
    wanted = table(nodes.join(ends, "id", "left_semi").select("id", "node", "doc_id", "th"), "shingle-wanted")
    near = F.broadcast(wanted) if wanted.count() * 64 <= MOST_BYTES else wanted
    match = rows["doc_id"].eqNullSafe(near["doc_id"]) & (rows["th"] == near["th"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            hashes, at = words(batch.column(0))
            same = pa.array([_node(hashes[a:b]) == node for a, b, node in zip(at[:-1], at[1:], batch.column(2).to_pylist())], pa.bool_())
            sets = pa.array([t.tobytes() for t in shingle_rows(hashes, at)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), sets], ["id", "tokens"]).filter(same)

    found = rows.join(near, match).select("text", "id", "node").mapInArrow(collect, "id bigint, tokens binary")
    return found.groupBy("id").agg(F.max("tokens").alias("tokens"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b) those whose sets link, by whole intersections."""
    left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(verify, "a bigint, b bigint")


def _apart(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a pair of blocks (bundle, i, j, s, id, n, label, ...): left rows, right rows, which pairs may link."""
    s, n = rows.column(3).to_numpy(), rows.column(5).to_numpy()
    label = rows.column(6).to_numpy()
    i, j = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
    left, right = np.flatnonzero(s == i), np.flatnonzero(s == j)
    small, large = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
    may = (100 * small >= PERCENT * large) & (label[left][:, None] != label[right])
    return left, right, (may & (left[:, None] < right) if i == j else may)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each pair of blocks that have a partner of another component and a fitting size."""
    for rows in groups(batches, 3):
        left, right, may = _apart(rows)
        keep = np.zeros(rows.num_rows, bool)
        keep[left[may.any(axis=1)]] = True
        keep[right[may.any(axis=0)]] = True
        if keep.any():
            yield rows.filter(pa.array(keep))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in each pair of blocks, between labels; the last column holds the sets."""
    for rows in groups(batches, 3):
        left, right, may = _apart(rows)
        if not may.any():
            continue
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(7)]
        size = np.array([len(x) for x in sets])
        tokens, owner = np.concatenate([sets[r] for r in right]), np.repeat(np.arange(len(right)), size[right])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        a, b = [], []
        for k in np.flatnonzero(may.any(axis=1)):
            x = sets[left[k]]
            lo, hi = np.searchsorted(tokens, x), np.searchsorted(tokens, x, "right")
            many = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            both = np.bincount(owner[at], minlength=len(right))
            hit = np.flatnonzero(may[k] & (100 * both >= PERCENT * (len(x) + size[right] - both)))
            a += [left[k]] * len(hit)
            b += right[hit].tolist()
        if a:
            root = forest(rows.num_rows, np.array(a), np.array(b))
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([rows.column(6).take(pa.array(moved)), rows.column(6).take(pa.array(root[moved]))], ["a", "b"])


def _fits(small: str, large: str):
    return F.col(small) * 100 >= F.col(large) * PERCENT


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; see the module's text."""
    return classes(docs, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n, label, component): the class of every row, null without shingles; th is xxhash64 of the text."""
    with smaller_batches(docs.sparkSession):
        return _classes(docs, id_col, text_col)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    ranges = _n_ranges(rows)
    shared = docs.sparkSession.sparkContext.broadcast(_bounded(_counted(rows.select("text"), ranges), ranges))
    known = table(_signed(rows, shared), "shingle-keys")
    shared.destroy()

    # Nodes get their numbers as they are written; equal word sequences are one.
    nodes = known.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.min("doc_id").alias("own"), *(F.first(c).alias(c) for c in ("n", "rare", "keys")))
    nodes = table(nodes.select(F.monotonically_increasing_id().alias("id"), "node", "own", "one.*", "n", "rare", "keys"), "shingle-nodes")
    posts = nodes.select("id", "n", "rare", F.explode("keys").alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("many"), F.min(F.struct("rare", "id", "n")).alias("hub")).where("many > 1")
    lists = table(lists.select("key", "many", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "shingle-lists")
    # A list of two has no other pair than that with the hub.
    index = posts.join(lists, "key").where((F.col("id") != F.col("hub")) & ((F.col("many") > 2) | _fits("n", "hub_n") & _fits("hub_n", "n")))
    index = table(index.select("id", "n", "hub", "hub_n", (F.col("many") > 2).alias("long")), "shingle-index")

    star = index.where(_fits("n", "hub_n") & _fits("hub_n", "n"))
    pairs = table(star.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "shingle-pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    links = table(_linked(pairs, _sets(rows, ends, nodes)), "shingle-links")
    labels = components(links).withColumnRenamed("node", "id")

    # The longer lists of one hub make a bundle; its pairs of different components are still open.
    bundles = index.where("long").groupBy(F.col("hub").alias("bundle"), "id").agg(F.first("n").alias("n"))
    bundles = table(bundles.join(labels, "id", "left").select("bundle", "id", "n", F.coalesce("label", "id").alias("label")), "shingle-bundles")
    mixed = bundles.groupBy("bundle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("many"), F.sum("n").alias("size")).where("lo <> hi")
    mixed = table(mixed.select("bundle", F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "shingle-mixed")
    blocked = bundles.join(mixed, "bundle").withColumn("s", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    by = ("bundle", "i", "j")
    blocked = blocked.select("bundle", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "s", "id", "n", "label")
    open_ = table(blocked.repartition(*by).sortWithinPartitions(*by).mapInArrow(_open, blocked.schema), "shingle-open")

    placed = nodes.select("id", "node", "own").join(labels, "id", "left").select("node", "own", F.coalesce("label", "id").alias("label"))
    if not open_.isEmpty():
        near = open_.join(_sets(rows, open_.select("id").distinct(), nodes), "id").select(*by, "s", "id", "n", "label", "tokens")
        more = components(table(near.repartition(*by).sortWithinPartitions(*by).mapInArrow(_met, "a bigint, b bigint"), "shingle-more"))
        more = more.select(F.col("node").alias("label"), F.col("label").alias("to"))
        placed = placed.join(more, "label", "left").select("node", "own", F.coalesce("to", "label").alias("label"))
    placed = table(placed, "shingle-placed")
    best = table(placed.groupBy("label").agg(F.min("own").alias("component")), "shingle-components")
    final = placed.join(best, "label").select("node", "label", "component")
    return known.select("doc_id", "th", "node", "n").join(final, "node", "left").select("doc_id", "th", "n", "label", "component")
