"""Queries whose tasks run in Python workers that have done nothing before, as after the loss of an executor."""

import subprocess
import sys

SCRIPT = """
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.python.worker.reuse", "false").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
for name in ("op3_katz", "op6_embed_dedup", "op8_relative_lz"):
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_fresh_workers():
    done = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == ["op3_katz", "op6_embed_dedup", "op8_relative_lz"]
