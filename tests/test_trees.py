import os

import pytest

from apilattice.sources import files, trees


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """20,000 files: wide and deep folders, excluded ones, odd names, a file that cannot be read."""
    root = tmp_path_factory.mktemp("tree")
    for a in range(20):
        for b in range(10):
            folder = root / f"pkg{a}" / ("src" if b % 2 else "node_modules") / f"d{b}"
            folder.mkdir(parents=True)
            for k in range(100):
                (folder / f"f{k}.{'py' if k % 3 else 'TXT'}").write_bytes(b"x" * (k % 7))
    deep = root
    for k in range(14):
        deep = deep / f"deep{k}"
        deep.mkdir()
        (deep / "x.py").write_text("1")
    (root / "top é.py").write_text("2")
    return root


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_equals_the_walk(spark, tree, partitions):
    got = {tuple(r)[1:] for r in trees.scan(spark, str(tree), "p", partitions=partitions).collect()}
    want = {(p, os.path.splitext(p)[1].lower(), size, ns // 100) for p, size, ns in files.walk(str(tree), max_files=1 << 30)}
    assert got == want and len(got) > 10_000


def test_pattern_depth_and_where_it_runs(spark, tree):
    rows = trees.scan(spark, str(tree), "p", pattern="*.PY", max_depth=3)
    want = {p for p, *_ in files.walk(str(tree), "*.py", max_files=1 << 30, max_depth=3)}
    assert {r.rel_path for r in rows.collect()} == want
    reader = trees.TreeReader({"path": str(tree), "partitions": "16"})
    parts = reader.partitions()
    assert 16 <= len(parts) <= 64 and sum(not p.deep for p in parts) <= 16  # the driver opens a few folders only


def test_links_cycles_and_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "f.py").write_text("1")
    (tmp_path / "a" / "b" / "up").symlink_to(tmp_path / "a")
    (tmp_path / "z").symlink_to(tmp_path / "a" / "b")
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere")
    for partitions in (1, 8):
        assert [r.rel_path for r in trees.scan(spark, str(tmp_path), "p", partitions=partitions).collect()] == ["a/b/f.py"]
    assert trees.scan(spark, str(tmp_path / "missing"), "p").collect() == []
