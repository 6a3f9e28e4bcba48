"""Queries on executors that are processes of their own."""

from __future__ import annotations

import subprocess
import sys
import tempfile
from pathlib import Path

RUN = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
b = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false")
b = b.config("spark.checkpoint.dir", f"file://{sys.argv[2]}").config("spark.local.dir", f"{sys.argv[2]}/local").config("spark.sql.warehouse.dir", f"{sys.argv[2]}/warehouse")
print("ROWS", e.queries()["foreign_scan"](b.getOrCreate(), "/root/testdata/sf0.001").count())
"""


def test_foreign_tables_are_open_to_all_executors():
    """A database in the driver's memory is none on an executor; a written one is open to one process."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    done = subprocess.run([sys.executable, "-c", RUN, str(Path(__file__).resolve().parents[1]), folder], cwd=folder, capture_output=True, text=True, timeout=300)
    assert "ROWS 5" in done.stdout, done.stderr[-2000:]


def test_foreign_tables_keep_nulls_quotes_and_empty_strings(spark):
    from tidemark.sources import landing as ld

    rows = [(1, None, 1.5), (2, "", None), (3, 'a "quoted", word', -2e-300), (None, "zwölf\nlines", 0.1), (5, "back\\slash", 1e300), (6, "\\", 2.0), (7, '"', 0.0)]
    d = spark.createDataFrame(rows, "id long, name string, x double")
    got = ld.foreign(spark, ld.delivered(d.repartition(3), "things"), "things", '"id"', 3, options=ld.DERBY)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str) and got.rdd.getNumPartitions() == 3
