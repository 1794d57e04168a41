import random

import pytest
from pyspark.sql import functions as F

from apilattice.operators import graph

NODES = "package_id string, name string, has_operations boolean, is_entry_point boolean, is_root_candidate boolean"
EDGES = "package_id string, src string, dst string"


def make(spark, nodes, refs, package="p"):
    """nodes: name -> (operations, entry, candidate)."""
    n = spark.createDataFrame([(package, k, *v) for k, v in nodes.items()], NODES)
    e = spark.createDataFrame([(package, a, b) for a, b in refs if a != b], EDGES)
    return n, e


def found(spark, nodes, refs, extra=()):
    n, e = make(spark, nodes, refs)
    more = spark.createDataFrame([("p", a, b) for a, b in extra], EDGES)
    reach = graph.reachable(e.union(more), graph.roots(n, e))
    working = {k for k, v in nodes.items() if v[0]}
    return {r.name for r in reach.collect()}, working


OP, PLAIN, IFACE = (True, False, True), (False, False, True), (True, False, False)


@pytest.mark.parametrize("nodes, refs, extra, want", [
    ({"A": OP, "B": OP}, [("A", "B"), ("B", "A")], [], {"A", "B"}),
    ({"L": OP}, [], [], {"L"}),
    ({"R": OP, "E": (True, True, True)}, [("R", "E")], [], {"R", "E"}),
    ({"E": (False, True, True), "W": OP}, [("E", "W")], [], {"E", "W"}),
    ({"I": IFACE, "M": OP}, [], [], {"M"}),
    ({"I": IFACE, "C": OP}, [("I", "C")], [], {"C"}),
    ({"C": OP, "I": IFACE, "M": PLAIN}, [("C", "I")], [("I", "M")], {"C", "I", "M"}),
    ({"O": PLAIN}, [], [], set()),
    ({"A": OP, "B": OP, "C": OP, "D": OP}, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")], [], {"A", "B", "C", "D"}),
    ({"A": PLAIN, "B": OP}, [("A", "B")], [], {"A", "B"}),
])
def test_roots_and_reachability(spark, nodes, refs, extra, want):
    assert found(spark, nodes, refs, extra)[0] == want


def test_walk_and_steps_agree(spark, monkeypatch):
    rnd = random.Random(7)
    edges = [(p, rnd.randrange(n), rnd.randrange(n)) for p, n in (("a", 12), ("b", 40), ("c", 3)) for _ in range(n)]
    e = spark.createDataFrame(edges, "package_id string, src bigint, dst bigint")
    roots = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2), ("c", 99)], "package_id string, name bigint")
    nodes = spark.createDataFrame([(p, k) for p, n in (("a", 12), ("b", 40), ("d", 2)) for k in range(n)], "package_id string, name bigint")
    got = []
    for local in (100_000, 30, 0):
        monkeypatch.setattr(graph, "LOCAL", local)
        got.append((sorted(map(tuple, graph.reachable(e, roots).collect())), sorted(map(tuple, graph.components(nodes, e).collect()))))
    assert got[0] == got[1] == got[2] and ("c", 99, 0) in got[0][0]


def test_empty(spark):
    n, e = make(spark, {}, [])
    assert graph.roots(n, e).count() == 0 and graph.components(n, e).count() == 0


def components_of(nodes, edges):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed, local", [(0, 0), (1, 0), (2, 100_000), (3, 20)])
def test_random_components_and_closure(spark, seed, local, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL", local)
    rnd = random.Random(seed)
    nodes = [f"n{k:02d}" for k in range(14)]
    edges = {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(18)}
    edges = {(a, b) for a, b in edges if a != b}
    n, e = make(spark, dict.fromkeys(nodes, OP), edges)
    assert {r.name: r.scc for r in graph.components(n, e).collect()} == components_of(nodes, edges)
    paths = {(r.src, r.dst) for r in graph.closure(e).collect()}
    want, grown = set(edges), None
    while grown != len(want):
        grown = len(want)
        want |= {(a, d) for a, b in want for c, d in edges if b == c}
    assert paths == want


def test_in_degree_rule(spark):
    n, e = make(spark, {"A": OP, "B": OP}, [("A", "B"), ("B", "A")])
    assert {r.name for r in graph.in_degree_roots(n, e).collect()} == {"A", "B"}
    n, e = make(spark, {"A": OP, "B": OP}, [("A", "B")])
    assert {r.name for r in graph.in_degree_roots(n, e).collect()} == {"A"}


def test_structure(spark):
    s = spark.createDataFrame([("p", "S", "Read"), ("p", "S", "Close"), ("p", "T", "Read")], "package_id string, name string, method string")
    i = spark.createDataFrame([("p", "Reader", "Read"), ("p", "ReadCloser", "Read"), ("p", "ReadCloser", "Close")], "package_id string, name string, method string")
    assert {(r.struct, r.iface) for r in graph.structural_implements(s, i).collect()} == {("S", "Reader"), ("S", "ReadCloser"), ("T", "Reader")}


def test_promotion(spark):
    structs = spark.createDataFrame([("p", "Outer", ["Inner"])], "package_id string, name string, embeds array<string>")
    members = spark.createDataFrame([("p", "Inner", "Get", "()", None), ("p", "Inner", "Put", "(x)", "e"), ("p", "Outer", "Put", "(x)", "e")], "package_id string, owner string, name string, sig string, ret string")
    assert [(r.owner, r.name) for r in graph.promoted_methods(structs, members).collect()] == [("Outer", "Get")]


def test_bases_and_errors(spark):
    types = spark.createDataFrame([("p", "A", "class", ["Base", "IThing", "Known"]), ("p", "Known", "interface", []), ("p", "K", "interface", ["X"])], "package_id string, name string, kind string, supers array<string>")
    got = {r.name: (r.base, r.interfaces) for r in graph.split_bases(types).collect()}
    assert got == {"A": ("Base", ["IThing", "Known"]), "Known": (None, []), "K": (None, ["X"])}
    chain = spark.createDataFrame([("p", "MyError", "System.Exception"), ("p", "Sub", "MyError"), ("p", "Other", "Base")], "package_id string, name string, base string")
    assert {r.name for r in graph.error_types(chain).collect()} == {"MyError", "Sub"}


def test_no_task_makes_all_pairs_of_a_component(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 8, raising=False)
    edges = spark.createDataFrame([("p", k, (k + 1) % 64) for k in range(64)] + [("p", 0, 100)], "package_id string, src long, dst long")
    pairs = graph.closure(edges).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.src, r.dst) for r in pairs) == sorted((a, b) for a in range(64) for b in [*range(64), 100])
    of = [r.task for r in pairs]
    assert max(map(of.count, set(of))) * 2 < len(of)
