"""Jobs whose tasks need the package run from any folder."""

import os
import subprocess
import sys

import __spark_entry__

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", "false").getOrCreate()
from ledgerlight.sources import complaints_csv, packet_files
rows = spark.range(50).select(F.col("id").alias("row_idx"), *[F.lit("x").alias(c) for c in complaints_csv.NAMES.values()])
packet_files.register(spark)
spark.range(7).select(F.col("id").alias("case_id"), F.lit("<p>").alias("html")).write.format("packet_files").option("path", sys.argv[2]).mode("append").save()
print("ROWS", complaints_csv.round_trip(rows).count(), packet_files.read_packets(spark, sys.argv[2]).count())
"""


def test_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", SCRIPT, root, str(tmp_path / "out")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 50 7" in ran.stdout, ran.stderr[-2000:]
