"""A prefix trie of conversations by an external mergesort whose runs carry LCPs.

Conversations are sequences of turns; a turn is 128 bits of SHA-256 of its role and text, so a
path is 16 bytes a turn and texts leave the plan early.

1. *Runs.*  Map tasks sort conversations by (path, id) in runs of ``RUN_BYTES`` and write them
   with the turns that each shares with the one before it, its LCP.
2. *Merge.*  Sampled splitters of (path, id) deal the runs to tasks, equal paths by id too.  A
   loser tree merges the pieces of the runs: of two heads the one with the larger LCP to the last
   output comes first without a look at its turns; only equal LCPs are compared, from there on.
3. *Nodes.*  A stack holds the open path; a node that the next conversation does not share is
   finished and emitted.  Nodes on the first and last path of a task may go on in its neighbours:
   these two paths, with what is known of their nodes, are a run of two for the next level, which
   merges the paths of all tasks the same way, over ever fewer tasks.  Levels hold only two
   paths for each task of the one before; at most ``FAN`` paths are merged in one task.

The ids that end in a node stream into its hash in ascending order.  Those of nodes on the edge
of a task go as joined pieces of ``PIECE`` ids to one more sorted stream, so no task holds a group
of copies.  A node's parent is found by a join of written tables, whose hot keys Spark can split.

Rebuilt conversation c: the first h turns of conversation c - c % 20 (% with the sign of c; all
if fewer, none if absent), then its own turns after its first h; h = crc32(decimal c) % 4.

Turns are ordered by turn (null first), role and text; equal rows stay.  Null roles and texts
are empty; rows with a null conv_id take no part; an empty table gives no rows.  Other columns
are ignored.  One conversation is the unit that a task holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apilattice.llm.staging import table

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of paths sorted in one run, and merged in one task.
RUN_BYTES, PART_BYTES = 8 << 20, 16 << 20
#: Ids in one piece; paths that are merged in one task.
PIECE, FAN = 4096, 4096
TURN = 16
NONE = (1 << 63) - 1
STATS = ("n", "low", "children", "leaves", "saved")
_RUN = "conv_id bigint, path binary, words array<bigint>, run bigint, seq int, lcp int"
_OPEN = ", ".join(f"{s} array<bigint>" for s in STATS)
_OUT = f"kind int, key binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends binary, ids string, {_RUN.partition(', ')[2]}, {_OPEN}"
_NODE = ("key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words): each conversation's rebuilt turns and the words of their texts."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    key = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * TURN)
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    rows = rows.select("conv_id", F.struct("pos", key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words")).alias("turn"))
    convs = table(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")), "conversations")
    first = convs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("start"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4)).cast("int")
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(first, "base", "left").withColumn("h", h)
    start = F.when(F.col("start").isNotNull(), F.slice("start", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    both = both.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join("turns.key", "")).alias("path"), F.col("turns.words").alias("words"))


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """How many turns two paths share, when ``at`` are known to be."""
    most = min(len(a), len(b)) // TURN
    while at < most and a[at * TURN : (at + 1) * TURN] == b[at * TURN : (at + 1) * TURN]:
        at += 1
    return at


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of conversations with the LCP of each and the one before it."""
    task, n = TaskContext.get().partitionId(), 0

    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, paths = rows.column(0).to_pylist(), rows.column(1).to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (paths[k], ids[k]))
        lcp = [0] + [shared(paths[a], paths[b]) for a, b in zip(order[:-1], order[1:])]
        rows = rows.take(pa.array(order)).to_batches()[0]
        mark = [pa.array([task << 32 | n] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(lcp, pa.int32())]
        return pa.RecordBatch.from_arrays([*rows.columns, *mark], ["conv_id", "path", "words", "run", "seq", "lcp"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= RUN_BYTES:
            yield run(held)
            held, size, n = [], 0, n + 1
    if sum(b.num_rows for b in held):
        yield run(held)


class LoserTree:
    """Merges sorted runs of (path, id, lcp, ...), where lcp counts the turns shared with the item before in its run."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.lcp = [0] * len(runs)
        k = 1
        while k < len(runs):
            k *= 2
        self.leaves, self.lost = k, [-1] * k
        won = [-1] * k + list(range(len(runs))) + [-1] * (k - len(runs))  # a node's children are 2 * node and 2 * node + 1
        for node in range(k - 1, 0, -1):
            won[node], self.lost[node] = self._match(won[2 * node], won[2 * node + 1])
        self.best = won[1]

    def _head(self, r: int) -> tuple | None:
        return self.runs[r][self.at[r]] if r >= 0 and self.at[r] < len(self.runs[r]) else None

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs by their heads; the loser's LCP becomes that with the winner."""
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        la, lb = self.lcp[a], self.lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        h = shared(x[0], y[0], la)
        ahead = (x[0][h * TURN : (h + 1) * TURN], x[1]) <= (y[0][h * TURN : (h + 1) * TURN], y[1])
        first, second = (a, b) if ahead else (b, a)
        self.lcp[second] = h
        return first, second

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        """(LCP with the item before, item) in order."""
        while (item := self._head(self.best)) is not None:
            r = self.best
            yield self.lcp[r], item
            self.runs[r][self.at[r]] = None
            self.at[r] += 1
            after = self._head(r)
            self.lcp[r] = after[2] if after is not None else 0
            node = (r + self.leaves) // 2
            while node:
                r, self.lost[node] = self._match(r, self.lost[node])
                node //= 2
            self.best = r


class _Node:
    __slots__ = ("key", "words", "ids", *STATS)

    def __init__(self, key: bytes, words: int) -> None:
        self.key, self.words, self.ids = key, words, []
        self.n = self.children = self.leaves = self.saved = 0
        self.low = NONE


def _below(key: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(key + turn, digest_size=TURN).digest()


def _trie(items: Iterator[tuple[int, tuple]], last: bool, task: int) -> Iterator[dict]:
    """Finished nodes, pieces of ids and, unless this is the last level, the first and last path."""
    stack: list[_Node] = []
    first = path = b""
    words: list[int] = []
    first_words: list[int] = []
    left = -1  # how much of the first path is still open
    edge: dict[int, _Node] = {}

    def finish(depth: int) -> Iterator[dict]:
        node = stack.pop()
        if not last and depth <= left:  # on the first path: it may have begun in the task before
            edge[depth] = node
            yield from pieces(node)
            return
        leaves, saved = (node.leaves if node.children else 1), node.saved + (node.n - 1) * node.words
        ends = hashlib.sha256(",".join(map(str, node.ids)).encode()).digest() if node.ids else None
        yield {"kind": 0, "key": node.key, "parent": stack[-1].key if stack else None, "depth": depth, "conv_id": node.low, "n_convs": node.n, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends": ends}
        if stack:
            up = stack[-1]
            up.n, up.low, up.children, up.leaves, up.saved = up.n + node.n, min(up.low, node.low), up.children + 1, up.leaves + leaves, up.saved + saved

    def pieces(node: _Node) -> Iterator[dict]:
        for k in range(0, len(node.ids), PIECE):
            yield {"kind": 2, "key": node.key, "conv_id": node.ids[k], "ids": ",".join(map(str, node.ids[k : k + PIECE]))}

    def spine(seq: int, path: bytes, words: list[int], nodes: dict[int, _Node]) -> dict:
        empty = _Node(b"", 0)
        held = [nodes.get(d, empty) for d in range(len(path) // TURN + 1)]
        return {"kind": 1, "conv_id": task, "path": path, "words": words, "run": task, "seq": seq, "lcp": left if seq else 0} | {s: [getattr(x, s) for x in held] for s in STATS}

    for h, (path, id_, _, words, stats) in items:
        if left < 0:
            first, first_words, left = path, words, len(path) // TURN
            stack.append(_Node(_below(b"", b"root"), 0))
        else:
            while len(stack) - 1 > h:
                yield from finish(len(stack) - 1)
            left = min(left, h)
        for d in range(len(stack) - 1, len(path) // TURN):
            stack.append(_Node(_below(stack[-1].key, path[d * TURN : (d + 1) * TURN]), words[d]))
        if stats is None:
            end = stack[-1]
            end.n, end.low = end.n + 1, min(end.low, id_)
            end.ids.append(id_)
        else:
            for node, n, low, children, leaves, saved in zip(stack, *stats):
                node.n, node.low, node.children, node.leaves, node.saved = node.n + n, min(node.low, low), node.children + children, node.leaves + leaves, node.saved + saved
    if left < 0:
        return
    if last:
        while stack:
            yield from finish(len(stack) - 1)
        return
    for node in stack:
        yield from pieces(node)
    if edge:
        yield spine(0, first, first_words, edge)
    yield spine(1, path, words, dict(enumerate(stack)))


def _merge(last: bool):
    """Rows of sorted runs, in the order of (run, seq) -> rows of _OUT."""
    names = [part.split(" ")[0] for part in _OUT.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[tuple]] = {}
        for batch in batches:
            at = {c: batch.column(k).to_pylist() for k, c in enumerate(batch.schema.names)}
            stats = zip(*(at[s] for s in STATS)) if "low" in at else iter(lambda: None, 0)
            for id_, path, words, run, lcp, held in zip(at["conv_id"], at["path"], at["words"], at["run"], at["lcp"], stats):
                runs.setdefault(run, []).append((path, id_, lcp, words, held))
        made: list[dict] = []
        for row in _trie(iter(LoserTree(list(runs.values()))), last, TaskContext.get().partitionId()):
            made.append(row)
            if len(made) >= 4096:
                yield packed(made)
                made = []
        if made:
            yield packed(made)

    def packed(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[part.split(" ")[1]]) for c, part in zip(names, _OUT.split(", "))], names)

    return merge


def _hashed(pieces: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the pieces of each key, streamed in the order of their ids."""

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != now:
                    if now is not None:
                        done.append((now, state.digest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(done)
        if now is not None:
            yield rows([(now, state.digest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.binary()) for k in (0, 1)], ["key", "late"])

    return pieces.select("key", "conv_id", "ids").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(hash_, "key binary, late binary")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations; see the module's text."""
    return nodes_of(rebuilt(turns))


def nodes_of(paths: DataFrame) -> DataFrame:
    """The same for (conv_id, path, words), the path being 16 bytes for each turn."""
    spark = paths.sparkSession
    items = table(paths.select("conv_id", "path", "words").mapInArrow(_runs, _RUN), "trie-runs")
    size = items.agg(F.sum(F.length("path") + 8 * F.size("words") + 64)).first()[0] or 0
    parts, levels = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES), []
    while True:
        dealt = items.repartitionByRange(parts, "path", "conv_id") if parts else items.coalesce(1)
        out = table(dealt.sortWithinPartitions("run", "seq").mapInArrow(_merge(not parts), _OUT), "trie-level")
        levels.append(out)
        if not parts:
            break
        items = out.where("kind = 1").select("conv_id", "path", "words", "run", "seq", "lcp", *STATS)
        many = items.count()
        parts = 0 if many <= FAN else -(-2 * many // FAN)
    late = _hashed(levels[0].where("kind = 2"))
    nodes = levels[0].where("kind = 0").select(*_NODE)
    for level in levels[1:]:
        more = level.where("kind = 0").select(*_NODE).join(late, "key", "left")
        nodes = nodes.union(more.withColumn("ends", F.coalesce("late", "ends")).select(*_NODE))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = F.coalesce(F.lower(F.hex("ends")), F.lit(hashlib.sha256().hexdigest()))
    return nodes.join(parents, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
