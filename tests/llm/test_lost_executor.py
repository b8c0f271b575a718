"""An executor that is lost and replaced after a stage's own files have gone."""

import os
import subprocess
import sys

SCRIPT = """
import os, signal
import pandas as pd
from pyspark.sql import SparkSession
from quillspark.llm import common, decontaminate

spark = (SparkSession.builder.master("local-cluster[1,1,800]").config("spark.ui.enabled", "false").config("spark.executor.memory", "600m")
    .config("spark.checkpoint.dir", "file://{shared}").config("spark.sql.shuffle.partitions", "2").getOrCreate())
words = " ".join("word%d" % k for k in range(12))
docs = spark.createDataFrame([(1, "before " + words + " after"), (2, "clean")], "doc_id long, text string")
items = spark.createDataFrame([(7, words)], "item_id long, text string")
with common.temporary(spark):
    found = decontaminate.find(docs, items)
    kept = [(r["doc_id"], r["found"]["items"]) for r in found.collect()]
assert sorted(kept) == [(1, ["7"]), (2, [])], kept

def parents(frames):
    for _ in frames:
        with open("/proc/%d/stat" % os.getppid()) as f:
            yield pd.DataFrame({{"pid": [int(f.read().rsplit(")", 1)[1].split()[1])]}})

executor = spark.range(1).mapInPandas(parents, "pid long").first()["pid"]
os.kill(executor, signal.SIGKILL)
assert spark.range(1000).repartition(2).count() == 1000
with common.temporary(spark):
    assert decontaminate.find(docs, items).where("size(found.hit) > 0").count() == 1
print("done")
"""


def test_a_new_executor_after_decontamination(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": root, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    env.pop("PYSPARK_GATEWAY_PORT", None), env.pop("PYSPARK_GATEWAY_SECRET", None)
    (tmp_path / "shared").mkdir()
    ran = subprocess.run([sys.executable, "-c", SCRIPT.format(shared=tmp_path / "shared")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert ran.stdout.strip().endswith("done"), ran.stderr[-2000:]
