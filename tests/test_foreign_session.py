"""Queries on a session that the library did not build."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

SCRIPT = """
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert entry.entry(spark).count() > 0
for key in ("scope_summary", "usage_table", "csv_load_report"):
    assert entry.queries()[key](spark, "/root/testdata/sf0.001").count() > 0, key
print("fine")
"""


def test_plain_session_in_a_fresh_process():
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "fine" in done.stdout
