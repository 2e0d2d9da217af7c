"""The entry module with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), sum(k.startswith('op') or k == 'pipeline' for k in q))"


def counts(folder):
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    return [int(x) for x in run.stdout.split()]


def test_without_the_corpus_subpackage(tmp_path):
    """The other queries stay when ``driftlens/llm`` and ``tests/llm`` are deleted."""
    without = tmp_path / "repo"
    hidden = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(ROOT, without, ignore=hidden)
    left, sql, corpus = counts(without)
    assert corpus == 0 and left > 200 and sql > 180
    if os.path.isdir(os.path.join(ROOT, "driftlens", "llm")):
        whole, _, corpus = counts(ROOT)
        assert whole == left + corpus and corpus > 0
