"""Workers that can't import the repository: the package must reach them by itself."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's alone
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp}/shared").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
assert not list(spark.range(1).rdd.map(lambda _: __import__("importlib.util").util.find_spec("tonespan")).filter(bool).collect())
import __spark_entry__
name = {name!r}
print("ROWS", __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def check(name, tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), tmp=tmp_path, name=name)], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "ROWS" in run.stdout, run.stderr[-3000:]


def test_each_query_in_a_session_of_its_own(tmp_path):
    for n, name in enumerate(("op3_minhash_near_dedup", "op6_token_store", "op9_substring_dedup")):
        (tmp_path / str(n)).mkdir()
        check(name, tmp_path / str(n))


def test_the_pipeline_in_a_session_of_its_own(tmp_path):
    check("pipeline", tmp_path)
