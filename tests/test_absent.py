"""The library works without the corpus operators, and hides no other import error."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(where, code):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=where, env=env, capture_output=True, text=True)


def copy(tmp_path):
    shutil.copytree(f"{ROOT}/apilattice", tmp_path / "apilattice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)


def test_without_corpus_operators(tmp_path):
    copy(tmp_path)
    out = run(tmp_path, "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op1_')] and 'pipeline' not in q; e.oracle_sql()")
    assert out.returncode == 0, out.stderr


def test_other_import_errors_show(tmp_path):
    copy(tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    assert "no_such_module_at_all" in run(tmp_path, "import __spark_entry__").stderr
