import os
import random

import duckdb
import pytest

from apilattice import registry
from apilattice.operators import graph

QUERIES = registry.load()
SF = "/root/testdata/sf0.01"
NATION = {0: 3, 20: 7}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A deep chain from a ring, a dense block and a lone pair; no line is a returned, untaxed lot of 50."""
    edges = {(k, (k + 1) % 8) for k in range(8)} | {(k, k + 1) for k in range(7, 19)}
    edges |= {(a, b) for a in range(20, 26) for b in range(20, 26) if a != b and (a * b) % 5} | {(19, 22), (30, 31)}
    rnd, folder, con = random.Random(4), tmp_path_factory.mktemp("graph"), duckdb.connect()
    lines = [(o, n, k, 1, 1.0, "N", 1, 1) for o, e in enumerate(sorted(edges)) for n, k in enumerate(e)]
    con.sql("create table lineitem (l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, l_extendedprice double, l_returnflag varchar, l_quantity int, l_tax int)")
    con.sql("create table supplier (s_suppkey bigint, s_acctbal double, s_nationkey int)")
    con.executemany("insert into lineitem values (?, ?, ?, ?, ?, ?, ?, ?)", rnd.sample(lines, len(lines)))
    con.executemany("insert into supplier values (?, ?, ?)", [(k, 2500.0 if k % 3 else 10.0, NATION.get(k, k % 3)) for k in range(34)])
    for name in ("lineitem", "supplier"):
        con.sql(f"copy {name} to '{folder}/{name}.parquet'")
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    return str(folder), edges, reach


def rows(spark, name, folder):
    return sorted(map(tuple, QUERIES[name](spark, folder).collect()))


def test_closure_and_reachability(spark, tables):
    folder, edges, reach = tables
    assert rows(spark, "closure_all", folder) == sorted(reach)
    first = {a for a, _ in edges} - {b for _, b in edges} | {0}
    assert rows(spark, "reachability_all", folder) == sorted((k,) for k in first | {b for a, b in reach if a in first})


@pytest.mark.parametrize("local", [0, 100_000])
def test_components(spark, tables, local, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL", local)
    folder, _, reach = tables
    same = {k: min([k] + [b for a, b in reach if a == k and (b, k) in reach]) for k in range(34)}
    assert rows(spark, "strong_components_all", folder) == sorted(same.items())


@pytest.mark.parametrize("name", ["scc_roots_all", "in_degree_roots_all"])
def test_roots(spark, tables, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.sql(f"create view {t} as select * from '{tables[0]}/{t}.parquet'")
    want = sorted(con.sql(registry.ORACLES[name]).fetchall())
    assert want and rows(spark, name, tables[0]) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name, steps", [("reachability_all", "_reach"), ("strong_components_all", "_coloured"), ("scc_roots_all", "_coloured"), ("closure_all", "_coloured")])
def test_whole_tables_go_step_by_step(spark, name, steps, monkeypatch):
    """The graph of a whole table is past what one task walks; its steps see the edges."""
    seen, plain = [], getattr(graph, steps)

    def noted(nodes, edges):
        seen.append(edges.count())
        return plain(nodes, edges)

    monkeypatch.setattr(graph, steps, noted)
    QUERIES[name](spark, SF)
    assert seen and max(seen) > graph.LOCAL // 2


def test_trim_and_pivots(spark, monkeypatch):
    """Two rings joined by a long tail, packages of all shapes: the tail is trimmed, the larger ring goes with its pivot."""
    monkeypatch.setattr(graph, "LOCAL", 0)
    edges = [("a", k, (k + 1) % 9) for k in range(9)] + [("a", 8, 100)] + [("a", k, k + 1) for k in range(100, 130)] + [("a", 130, 200), ("a", 200, 201), ("a", 201, 200)]
    edges += [("b", 1, 2), ("b", 2, 1), ("c", 5, 6), ("d", 1, 1)] + [("e", a, b) for a in range(12) for b in range(12) if a // 4 <= b // 4]
    df = spark.createDataFrame(edges, "package_id string, src int, dst int")
    nodes = spark.createDataFrame(sorted({(p, x) for p, a, b in edges for x in (a, b)}) + [("f", 1)], "package_id string, name int")
    got = {(r.package_id, r.name): r.scc for r in graph.components(nodes, df).collect()}
    want = {("a", k): 0 if k < 9 else 200 if k in (200, 201) else k for p, k in got if p == "a"} | {("b", 1): 1, ("b", 2): 1, ("c", 5): 5, ("c", 6): 6, ("d", 1): 1, ("f", 1): 1} | {("e", k): k // 4 * 4 for k in range(12)}
    assert got == want
