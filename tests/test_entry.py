"""The driver's entry file, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOWN = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sorted(s.keys() - q.keys()), sorted(x for x in q if x.startswith('op') or x == 'pipeline'))"


def shown(folder):
    done = subprocess.run([sys.executable, "-c", SHOWN], cwd=folder, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"})
    assert done.returncode == 0, done.stderr
    return done.stdout.strip()


def test_the_entry_works_without_the_corpus_operators(tmp_path):
    from brindle.queries import QUERIES

    without = f"{len(QUERIES)} [] []"
    for i, gone in enumerate((("brindle/llm", "tests/llm"), ("brindle/llm", "tests/llm", "corpus_pipeline.py"))):
        at = tmp_path / str(i)
        shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
        for name in gone:
            path = at / name
            shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
        assert shown(at) == without
