"""Small cases of the fourth round's findings."""

import json
import os
import subprocess
import sys
from pathlib import Path

#: Every place of the long text holds a shingle of the benchmark; a row a place with all its words takes some GB.
LONG = """
import json, sys
from pyspark.sql import SparkSession
from tandem.llm import decontamination
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[1]).config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
item = " ".join(f"word{i}" for i in range(40))
docs = spark.createDataFrame([(0, " ".join([item] * 350)), (1, "other words " * 20), (2, None)], "doc_id long, text string")
rows = decontamination.contamination(docs, spark.createDataFrame([(7, item), (8, "other")], "item_id long, text string")).collect()
print(json.dumps(sorted([r.doc_id, r.n_words, r.n_hit, r.items] for r in rows)))
"""


def test_f1_contamination_memory_is_not_places_times_words(tmp_path):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell", "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    run = subprocess.run([sys.executable, "-c", LONG, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert json.loads(run.stdout.splitlines()[-1]) == [[0, 14000, 14000, ["7"]], [1, 40, 20, ["8"]], [2, 0, 0, []]]
