import json
import os

import pytest

from apilattice.sources import index as api_index
from apilattice.sources import sink


def tree(root):
    return {os.path.relpath(os.path.join(at, n), root): open(os.path.join(at, n), "rb").read().decode() for at, _, names in os.walk(root) for n in names}


def test_writes_each_row_once(spark, tmp_path):
    rows = [(f"d{k % 7}/f{k}.txt", f"text {k} é") for k in range(300)] + [("a.txt", None), (None, "x"), ("twice", "a"), ("twice", "b")]
    sink.save_files(spark.createDataFrame(rows, "path string, text string").repartition(5), str(tmp_path))
    assert tree(tmp_path) == {**{p: x for p, x in rows[:300]}, "a.txt": "", "twice": "b"}
    again = spark.createDataFrame([("twice", "c"), ("new", "n")], "path string, text string")
    sink.save_files(again, str(tmp_path), replace=False)
    assert tree(tmp_path)["twice"] == "b" and tree(tmp_path)["new"] == "n"
    sink.save_files(again, str(tmp_path))
    assert tree(tmp_path)["twice"] == "c"
    sink.save_files(again.limit(0), str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none") or tree(tmp_path / "none") == {}


@pytest.mark.parametrize("bad", ["../out", "/etc/x", "a/../../x", "a//b", "", ".staging-1/x", "a\\b", "."])
def test_a_path_out_of_the_root_leaves_nothing(spark, tmp_path, bad):
    root = tmp_path / "root"
    rows = [(f"f{k}", "x") for k in range(40)] + [(bad, "y")]
    with pytest.raises(Exception, match="not a path below the root"):
        sink.save_files(spark.createDataFrame(rows, "path string, text string"), str(root))
    assert tree(tmp_path) == {}


def test_a_task_that_fails_late_leaves_what_was_there(spark, tmp_path):
    (tmp_path / "f1").write_text("old")

    def fail(batches):
        for pdf in batches:
            yield pdf
            if (pdf["path"] == "f99").any():
                raise RuntimeError("lost")

    rows = spark.createDataFrame([(f"f{k}", "new") for k in range(100)], "path string, text string").repartition(4)
    sink.register(spark)
    with pytest.raises(Exception, match="lost"):
        rows.mapInPandas(fail, "path string, text string").write.format(sink.NAME).mode("append").save(str(tmp_path))
    assert tree(tmp_path) == {"f1": "old"}
    with pytest.raises(Exception, match="IsADirectoryError|FileExistsError|NotADirectoryError"):
        sink.save_files(spark.createDataFrame([("a", "x"), ("a/b", "y"), ("f1", "new")], "path string, text string"), str(tmp_path))
    assert tree(tmp_path) == {"f1": "old"}


def test_an_attempt_that_was_not_committed_adds_nothing(tmp_path):
    writer = sink.FileWriter(str(tmp_path), True)
    for attempt, text in (("0-1", "lost"), ("0-2", "kept")):
        os.makedirs(f"{writer.staging}/{attempt}")
        with open(f"{writer.staging}/{attempt}/{text}", "w") as out:
            out.write(text)
    writer.commit([sink.Staged(f"{writer.staging}/0-2"), None])
    assert tree(tmp_path) == {"kept": "kept"}


def test_stub_files(spark, tmp_path):
    kinds = [{"name": n, "kind": "class", "members": [{"name": "run", "kind": "method", "sig": "()", "ret": "int"}]} for n in ("B", "A")]
    made = {"package": "pkg", "containers": [{"name": "x.y", "types": kinds}, {"name": "../x.z", "types": kinds[:1]}, {"name": "empty", "types": []}]}
    index = api_index.parse_indexes(spark.createDataFrame([(json.dumps(made),)], "json string"))
    for language, ext in sink.EXTENSIONS.items():
        sink.save_files(sink.stub_files(index, language), str(tmp_path / language))
        found = tree(tmp_path / language)
        assert len(found) == 2 and all(p.startswith("pkg") and p.endswith(ext) for p in found)
        assert sorted(x.count("run") for x in found.values()) == [1, 2]
        assert f"pkg/x.y{ext}" in found and f"pkg/x.z{ext}" in found
        whole = max(found.values(), key=len)
        assert whole.index(" B") < whole.index(" A")
