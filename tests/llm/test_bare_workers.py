"""The operators where Python workers have no copy of the package: functions and broadcasts hold no class of it."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[2])
SCRIPT = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def missing(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({{"n": [int(importlib.util.find_spec("matchloom") is not None)] * b.num_rows}})
assert spark.range(1).mapInArrow(missing, "n long").first().n == 0
sys.path.insert(0, {REPO!r})
import __spark_entry__ as entry
d = "/root/testdata/sf0.001"
n = spark.read.parquet(d + "/documents.parquet").count()
for name, query in entry.queries().items():
    if name.startswith("op") and name[2].isdigit():
        rows = query(spark, d).count()
        assert rows == n or name.startswith(("op3", "op6", "op7")), (name, rows)
assert entry.queries()["pipeline"](spark, d).count() > 0
print("whole")
"""


def test_queries_run(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.endswith("whole\n"), done.stderr[-3000:]
