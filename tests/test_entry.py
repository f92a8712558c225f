"""The entry module with and without the training-data folders."""

import os
import shutil
import subprocess
import sys

import pytest
from oracle import ROOT

NAMES = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"


@pytest.mark.parametrize("without", [["anamnesis/llm", "tests/llm"], ["anamnesis/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"], []])
def test_imports_without(tmp_path, without):
    gone = {os.path.join(ROOT, name) for name in without}

    def skip(folder, names):
        return [n for n in names if n in (".git", "__pycache__") or os.path.join(folder, n) in gone]

    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", NAMES], cwd=copy, env=clean, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, _, dealt = said.stdout.split()
    assert int(n) > 100 and (dealt == "True") == ("anamnesis/llm" not in without)
