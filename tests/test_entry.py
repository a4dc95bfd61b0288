"""The entry point with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"


@pytest.mark.parametrize("left_out", [("crowdgauge/llm", "tests"), ("crowdgauge/llm", "tests", "corpus_pipeline.py")])
def test_queries_without_the_subpackage(tmp_path, left_out):
    gone = {os.path.join(ROOT, x) for x in left_out}
    shutil.copytree(ROOT, copy := tmp_path / "copy", ignore=lambda d, names: [n for n in names if os.path.join(d, n) in gone or n in (".git", "__pycache__")])
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    names = said.stdout.split("SQL")[0].split()[1:]
    assert "s01_ranking" in names and len(names) > 150
    assert not [n for n in names if n.startswith("op") or n == "pipeline"]


def test_a_broken_subpackage_is_not_hidden(tmp_path):
    shutil.copytree(ROOT, copy := tmp_path / "copy", ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", "tests")])
    (copy / "crowdgauge" / "llm").mkdir(exist_ok=True)
    (copy / "crowdgauge" / "llm" / "__init__.py").write_text("")
    (copy / "crowdgauge" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode != 0 and "no_such_module_anywhere" in said.stderr
