"""Python workers find no package of this library: they start in another folder, without it on their path."""

import os
import subprocess
import sys
from pathlib import Path

from helpers import SF

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.memory", "2g").getOrCreate()
for name in ("op2_ngram_jaccard", "op3_substring_dedup", "op5_packing", "op6_toxicity", "op9_exact_dedup", "op10_secret_scan", "welch_band_power", "vif_filter"):
    print(name, entry.queries()[name](spark, {SF!r}).count() > 0, flush=True)
"""


def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.stdout.count(" True") == 8, run.stderr[-3000:]
