"""Type-reference graphs: edges, reachability, components, roots, closures.

Nodes are (package_id, name); edges are (package_id, src, dst).  Many packages of at most ``LOCAL``
nodes and edges share a task, which walks one after another; larger ones go step by step over all
tasks, loops on the driver whose steps are joins.  Both give the same rows.  Lineage is cut with
reliable checkpoints in the shared folder.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

KEYS = ["package_id", "name"]
COMPACT = 16
LOCAL = 4096
#: Members of a component that stand in one block when its pairs are made.
BLOCK = 1024


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; one of our own only where unset and all runs on this machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        known = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if known is None and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(known or "file://" + tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def reference_edges(owners: DataFrame, names: DataFrame) -> DataFrame:
    """(package_id, src, dst) from owners(package_id, name, refs array): known names only, no self loops."""
    refs = owners.select("package_id", F.col("name").alias("src"), F.explode("refs").alias("dst"))
    known = names.select("package_id", F.col("name").alias("dst")).distinct()
    return refs.where("src <> dst").join(known, ["package_id", "dst"], "left_semi").select("package_id", "src", "dst").distinct()


def last_of_each_name(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each name; the last in document order wins."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col(order).desc()))
    return nodes.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def implementer_edges(types: DataFrame, kind: str = "iface_impl") -> DataFrame:
    """Extra edges that lead from an interface or base to what implements or extends it."""
    column = {"iface_impl": "supers", "base_derived": "bases", "embed": "embeds"}[kind]
    return types.select("package_id", F.explode(column).alias("src"), F.col("name").alias("dst"), F.lit(kind).alias("edge_kind")).where("src <> dst").distinct()


def _by_size(nodes: DataFrame, edges: DataFrame, walk: Callable[[list, list], dict], value: str, steps: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(package_id, name, value): walk(nodes, edges) -> {name: value} in one task for each small package, steps(nodes, edges) for the others."""
    name = nodes.schema["name"].dataType
    rows = nodes.select("package_id", F.col("name").alias("src"), F.lit(None).cast(name).alias("dst")).union(edges.select("package_id", "src", "dst"))
    rows = cut(rows.where("src is not null").distinct())
    large = cut(rows.groupBy("package_id").agg(F.count("*").alias("_n")).where(F.col("_n") > LOCAL).select("package_id"))
    kind = "int" if value == "depth" else name.simpleString()
    package = rows.schema["package_id"].dataType
    types = [to_arrow_type(package), to_arrow_type(name), pa.int32() if value == "depth" else to_arrow_type(name)]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, alone, ends, made = None, [], [], ([], [], [])
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, types)], ["package_id", "name", value])

        def walked() -> None:
            found = walk(alone, ends)
            for have, more in zip(made, ([now] * len(found), found.keys(), found.values())):
                have.extend(more)

        for batch in batches:
            for at, src, dst in zip(*(c.to_pylist() for c in batch.columns)):
                if at != now:
                    walked()
                    now, alone, ends = at, [], []
                    if len(made[0]) > 50_000:
                        yield flush()
                        made = ([], [], [])
                if dst is None:
                    alone.append(src)
                else:
                    ends.append((src, dst))
        walked()
        yield flush()

    schema = f"package_id {package.simpleString()}, name {name.simpleString()}, {value} {kind}"
    small = rows.join(large, "package_id", "left_anti").select("package_id", "src", "dst")
    out = small.repartition("package_id").sortWithinPartitions("package_id").mapInArrow(local, schema)
    if large.isEmpty():
        return out
    rest = cut(rows.join(large, "package_id", "left_semi"))
    made = steps(rest.where("dst is null").select("package_id", F.col("src").alias("name")), rest.where("dst is not null"))
    return out.union(made.select("package_id", "name", F.col(value).cast(kind)))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(package_id, name, depth): what the roots reach, with the steps it takes; unknown targets too."""
    return _by_size(roots, edges, _walk_from, "depth", _reach)


def _walk_from(roots: list, edges: list) -> dict:
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    depth, new = dict.fromkeys(roots, 0), list(roots)
    while new:
        after = []
        for a in new:
            for b in near.get(a, ()):
                if b not in depth:
                    depth[b] = depth[a] + 1
                    after.append(b)
        new = after
    return depth


def _reach(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Every step joins only the new nodes with the edges, drops those already seen and appends the rest; what was seen is written anew
    only every COMPACT steps."""
    edges = cut(edges.select("package_id", "src", "dst").distinct())
    seen = new = cut(roots.select(*KEYS).distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not new.isEmpty():
        depth += 1
        near = new.withColumnRenamed("name", "src").join(edges, ["package_id", "src"]).select("package_id", F.col("dst").alias("name")).distinct()
        new = cut(near.join(seen, KEYS, "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(new) if depth % COMPACT else cut(seen.union(new))
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """(package_id, src, dst): all pairs with a path.

    Components become single nodes, whose paths are joined with paths until nothing is new;
    only then come the pairs of members, so a dense component costs no more than its pairs.
    Large components are dealt to blocks of some BLOCK members, and pairs of blocks to all tasks.
    """
    edges = cut(edges.select("package_id", "src", "dst").distinct())
    ends = edges.select("package_id", F.col("src").alias("name")).union(edges.select("package_id", "dst"))
    scc = cut(components(ends, edges))
    at = lambda c: scc.select("package_id", F.col("name").alias(c), F.col("scc").alias(f"{c}_scc"))
    linked = edges.join(at("src"), ["package_id", "src"]).join(at("dst"), ["package_id", "dst"])
    paths = cut(linked.select("package_id", F.col("src_scc").alias("src"), F.col("dst_scc").alias("dst")).distinct())
    count = paths.count()
    while True:
        step = paths.withColumnRenamed("dst", "mid").join(paths.withColumnRenamed("src", "mid"), ["package_id", "mid"]).select("package_id", "src", "dst")
        paths = cut(paths.union(step).distinct())
        if (now := paths.count()) == count:
            break
        count = now
    blocks = scc.groupBy("package_id", "scc").agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    members = cut(scc.join(blocks, ["package_id", "scc"]).select("package_id", "name", "scc", F.expr("pmod(xxhash64(name), _n)").alias("block")))
    key = lambda c: ["package_id", f"{c}_scc", f"{c}_block"]
    of = lambda c: members.select("package_id", F.col("scc").alias(f"{c}_scc"), F.col("block").alias(f"{c}_block"), F.col("name").alias(c))
    dealt = paths.withColumnsRenamed({"src": "src_scc", "dst": "dst_scc"})
    for c in ("src", "dst"):
        dealt = dealt.join(of(c).select(*key(c)).distinct(), key(c)[:2])
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since pairs of blocks are few bytes and would be gathered in one task
    return dealt.repartition(n, *key("src"), *key("dst")[1:]).join(of("src"), key("src")).join(of("dst"), key("dst")).select("package_id", "src", "dst")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(package_id, name, scc): strongly connected components of ``nodes``, named by their smallest member; other ends of edges count as no nodes."""
    known = edges.select("package_id", "src", "dst").where("src <> dst")
    return _by_size(nodes.select(*KEYS), known, _walk_components, "scc", _coloured)


def _walk_components(nodes: list, edges: list) -> dict:
    """Tarjan's algorithm without recursion."""
    near: dict = {n: [] for n in nodes}
    for a, b in edges:
        if a in near and b in near:
            near[a].append(b)
    index, low, on, stack, scc = {}, {}, set(), [], {}
    for start in nodes:
        if start in index:
            continue
        work = [(start, iter(near[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, after = work[-1]
            for b in after:
                if b not in index:
                    index[b] = low[b] = len(index)
                    stack.append(b)
                    on.add(b)
                    work.append((b, iter(near[b])))
                    break
                if b in on:
                    low[node] = min(low[node], index[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    at = len(stack) - 1
                    while stack[at] != node:
                        at -= 1
                    least = min(stack[at:])
                    for member in stack[at:]:
                        scc[member] = least
                        on.discard(member)
                    del stack[at:]
    return scc


def _coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components in steps.  Nodes without edges in or out are their own and leave, again and again while many do (trim).  Then one pivot
    a package, the node with the most edges in times out: what it reaches and is reached by is its component, likely the largest.  The rest
    by colouring: every open node takes the largest name that reaches it; within a colour, what reaches back to the colour's own node is
    one component and leaves the graph."""
    open_ = cut(nodes.select(*KEYS).distinct())
    edges, alone = _trimmed(open_, edges.select("package_id", "src", "dst").where("src <> dst").distinct())
    found = alone
    open_ = cut(open_.join(alone, KEYS, "left_anti"))
    first = True
    while not open_.isEmpty():
        done = _pivots(edges) if first else _coloured_once(open_, edges)
        first = False
        found = cut(found.union(done))
        open_ = cut(open_.join(done, KEYS, "left_anti"))
        edges, alone = _trimmed(open_, _among(open_, edges))
        found = found.union(alone)
        open_ = cut(open_.join(alone, KEYS, "left_anti"))
    return found


def _among(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between two of the nodes."""
    end = lambda c: nodes.select("package_id", F.col("name").alias(c))
    return edges.join(end("src"), ["package_id", "src"], "left_semi").join(end("dst"), ["package_id", "dst"], "left_semi")


def _trimmed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges left, nodes that are components of their own): nodes without edges in or out go while a round takes a hundredth of the edges."""
    edges = cut(_among(nodes, edges))
    many = edges.count()
    while True:
        inner = edges.select("package_id", F.col("src").alias("name")).intersect(edges.select("package_id", F.col("dst").alias("name")))
        after = cut(_among(inner, edges))
        left = after.count()
        edges, gone, many = after, many - left, left
        if gone * 100 <= left:
            break
    inner = edges.select("package_id", F.col("src").alias("name")).union(edges.select("package_id", F.col("dst").alias("name")))
    return edges, cut(nodes.join(inner.distinct(), KEYS, "left_anti").select(*KEYS, F.col("name").alias("scc")))


def _pivots(edges: DataFrame) -> DataFrame:
    """One component of each package: that of the node with the most edges in times out."""
    ends = lambda c, n: edges.groupBy("package_id", F.col(c).alias("name")).agg(F.count("*").alias(n))
    both = ends("src", "n_out").join(ends("dst", "n_in"), KEYS)
    pivot = cut(both.groupBy("package_id").agg(F.max_by("name", F.struct(F.col("n_out") * F.col("n_in"), "name")).alias("name")))
    back = edges.select("package_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    members = _reach(pivot, edges).select(*KEYS).join(_reach(pivot, back).select(*KEYS), KEYS)
    least = members.groupBy("package_id").agg(F.min("name").alias("scc"))
    return cut(members.join(least, "package_id").select(*KEYS, "scc"))


def _coloured_once(open_: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of the colours' own nodes."""
    colours = _colours(open_, edges)
    own = colours.where("name = colour").select(*KEYS, "colour")
    of = lambda c: colours.select("package_id", F.col("name").alias(c), F.col("colour").alias(f"{c}_colour"))
    inside = edges.join(of("src"), ["package_id", "src"]).join(of("dst"), ["package_id", "dst"]).where("src_colour = dst_colour")
    back = inside.select("package_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    members = cut(_reach(own.select(*KEYS), back).select(*KEYS).join(colours, KEYS))
    least = members.groupBy("package_id", "colour").agg(F.min("name").alias("scc"))
    return cut(members.join(least, ["package_id", "colour"]).select(*KEYS, "scc"))


def _colours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    colours = nodes.withColumn("colour", F.col("name"))
    while True:
        sent = edges.join(colours.select("package_id", F.col("name").alias("src"), "colour"), ["package_id", "src"])
        best = sent.groupBy("package_id", F.col("dst").alias("name")).agg(F.max("colour").alias("_best"))
        after = cut(colours.join(best, KEYS, "left").select(*KEYS, F.col("colour").alias("_was"), F.greatest("colour", "_best").alias("colour")))
        colours = after.drop("_was")
        if after.where("colour <> _was").isEmpty():
            return colours


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(package_id, name): where reachability starts.

    nodes(package_id, name, has_operations, is_entry_point, is_root_candidate).  All entry
    points, and from every component that no component with a root candidate leads into: its
    candidates that are no entry points, if one of them has operations or refers to a type
    that has.
    """
    scc = components(nodes, edges)
    all_ = cut(nodes.join(scc, KEYS))
    known = edges.select("package_id", "src", "dst").distinct()
    at = lambda c, *more: all_.select("package_id", F.col("name").alias(c), F.col("scc").alias(f"{c}_scc"), *more)
    full = known.join(at("src"), ["package_id", "src"]).join(at("dst", F.col("has_operations").alias("_works")), ["package_id", "dst"])
    candidates = all_.where("is_root_candidate").select("package_id", F.col("scc").alias("src_scc")).distinct()
    entered = full.where("src_scc <> dst_scc").join(candidates, ["package_id", "src_scc"], "left_semi").select("package_id", F.col("dst_scc").alias("scc")).distinct()
    uses = full.where("_works").select("package_id", F.col("src").alias("name")).distinct().withColumn("_uses", F.lit(True))
    free = all_.join(entered, ["package_id", "scc"], "left_anti").where("is_root_candidate and not is_entry_point").join(uses, KEYS, "left")
    relevant = F.max(F.col("has_operations") | F.coalesce("_uses", F.lit(False))).over(Window.partitionBy("package_id", "scc"))
    chosen = free.withColumn("_relevant", relevant).where("_relevant").select(*KEYS)
    return all_.where("is_entry_point").select(*KEYS).union(chosen).distinct()


def in_degree_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(package_id, name) by the simpler rule: entry points with operations, or unreferenced types that have or refer to operations; if a package has none, all that have or refer to operations."""
    edges = edges.select("package_id", "src", "dst").where("src <> dst").distinct()
    works = nodes.where("has_operations").select("package_id", F.col("name").alias("dst"))
    uses = edges.join(works, ["package_id", "dst"], "left_semi").select("package_id", F.col("src").alias("name")).distinct().withColumn("_uses", F.lit(True))
    called = edges.select("package_id", F.col("dst").alias("name")).distinct().withColumn("_called", F.lit(True))
    all_ = nodes.join(uses, KEYS, "left").join(called, KEYS, "left")
    active = F.col("has_operations") | F.coalesce("_uses", F.lit(False))
    first = (F.col("is_entry_point") & F.col("has_operations")) | (F.col("_called").isNull() & active)
    any_first = F.max("_first").over(Window.partitionBy("package_id"))
    flagged = all_.withColumn("_first", first).withColumn("_active", active).withColumn("_any", any_first)
    return flagged.where("_first or (not _any and _active)").select(*KEYS).distinct()


def reference_counts(edges: DataFrame) -> DataFrame:
    """(package_id, name, n_refs): how many other types refer to each."""
    return edges.where("src <> dst").distinct().groupBy("package_id", F.col("dst").alias("name")).agg(F.count("*").alias("n_refs"))


def structural_implements(structs: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(package_id, struct, iface): structs whose method names include all of an interface's (which has some).

    Both have (package_id, name, method).
    """
    need = interfaces.select("package_id", F.col("name").alias("iface"), "method").distinct()
    need = need.withColumn("_need", F.count("*").over(Window.partitionBy("package_id", "iface")))
    have = structs.select("package_id", F.col("name").alias("struct"), "method").distinct()
    met = have.join(need, ["package_id", "method"]).groupBy("package_id", "struct", "iface").agg(F.count("*").alias("_have"), F.max("_need").alias("_need"))
    return met.where("_have = _need").select("package_id", "struct", "iface")


def promoted_methods(structs: DataFrame, members: DataFrame) -> DataFrame:
    """Methods that embedding lends to a struct, one level deep, unless it has one of equal name, signature and result."""
    lent = structs.select("package_id", F.col("name").alias("_to"), F.explode("embeds").alias("owner")).join(members, ["package_id", "owner"])
    key = ["package_id", "owner", "name", "sig", "ret"]
    lent = lent.drop("owner").withColumnRenamed("_to", "owner").dropDuplicates(key)
    same = [lent[c].eqNullSafe(members[c]) for c in key]
    return lent.join(members, same, "left_anti").select(*members.columns)


def split_bases(types: DataFrame) -> DataFrame:
    """(package_id, name, base, interfaces): supers told apart by the kind of the known type, else by an I before a capital."""
    supers = types.select("package_id", "name", F.col("kind").alias("_own"), F.posexplode("supers").alias("_pos", "super"))
    kinds = types.groupBy("package_id", F.col("name").alias("super")).agg(F.max(F.col("kind") == "interface").alias("_known"))
    supers = supers.join(kinds, ["package_id", "super"], "left")
    is_iface = (F.col("_own") == "interface") | F.coalesce("_known", F.col("super").rlike("^I[A-Z]"))
    flagged = supers.withColumn("_iface", is_iface)
    agg = flagged.groupBy(*KEYS).agg(F.min_by(F.when(~F.col("_iface"), F.col("super")), F.when(~F.col("_iface"), F.col("_pos"))).alias("base"), F.sort_array(F.collect_list(F.when(F.col("_iface"), F.struct("_pos", "super")))).alias("_i"))
    return types.select(*KEYS).join(agg, KEYS, "left").select(*KEYS, "base", F.coalesce(F.col("_i.super"), F.array().cast("array<string>")).alias("interfaces"))


def error_types(types: DataFrame, root: str = "System.Exception") -> DataFrame:
    """(package_id, name): types whose chain of bases ends in ``root``."""
    up = types.where("base is not null").select("package_id", F.col("base").alias("src"), F.col("name").alias("dst"))
    start = types.select("package_id").distinct().withColumn("name", F.lit(root))
    return reachable(up, start).where("depth > 0").select(*KEYS)


def dependency_closure(pending: DataFrame, definitions: DataFrame, builtins: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(name, dep_package): what pending(name) names need, through definitions(name, dep_package, refs), built-ins aside.

    aliases(alias, name): renamed imports; an alias needs what it stands for and is of its package.
    """
    known = definitions.select("name", "dep_package", "refs")
    if aliases is not None:
        named = aliases.join(known.select("name", "dep_package"), "name").select(F.col("alias"), "dep_package", F.array("name").alias("refs"))
        known = known.union(named)
    known = known.join(builtins.select("name"), "name", "left_anti")
    edges = known.select(F.lit("d").alias("package_id"), F.col("name").alias("src"), F.explode("refs").alias("dst"))
    found = _reach(pending.select(F.lit("d").alias("package_id"), "name"), edges)  # one graph of all packages
    return found.join(known.select("name", "dep_package"), "name").select("name", "dep_package").distinct()
