"""The driver's contract."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


def test_without_the_corpus_operators():
    """The rest imports and registers its queries when the optional folder and the pipeline are gone."""
    import shutil

    to = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, check=True)


def test_an_error_inside_the_corpus_operators_is_not_swallowed():
    import shutil

    to = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    folder = to / "tidemark" / "llm"
    if folder.exists():
        (folder / "queries.py").write_text("import no_such_package\n")
        done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, capture_output=True, text=True)
        assert done.returncode and "no_such_package" in done.stderr
