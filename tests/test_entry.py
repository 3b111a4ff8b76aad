"""The entry points hold without the training-data operators, whether or not corpus_pipeline.py is still there."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q); print(sum(n == 'pipeline' or n.startswith('op') for n in q))"


@pytest.mark.parametrize("gone", [("signalmill/llm", "tests/llm"), ("signalmill/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_llm(tmp_path, gone):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for g in gone:
        if (at / g).is_dir():
            shutil.rmtree(at / g)
        elif (at / g).exists():
            os.remove(at / g)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=at, env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert got.stdout.strip() == "0"
