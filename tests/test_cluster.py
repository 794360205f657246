"""Queries on executors that are processes of their own, as on a cluster."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__
name, folder, own = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{own}/shared", "spark.sql.warehouse.dir": f"{own}/warehouse", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print("ROWS", json.dumps([tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect()]))
"""


def on_cluster(name: str, folder: str, own: Path) -> list[tuple]:
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_SCALA_VERSION": "2.13", "SPARK_WORKER_DIR": str(own / "work"), "TZ": "UTC"}
    done = subprocess.run([sys.executable, "-c", RUN, name, folder, str(own)], cwd=own, env=env, capture_output=True, text=True, timeout=180)
    found = [x[5:] for x in done.stdout.splitlines() if x.startswith("ROWS ")]
    assert found, done.stderr[-3000:]
    return [tuple(r) for r in json.loads(found[0])]


def test_a_database_is_read_by_other_processes(tmp_path):
    rows = on_cluster("database_read", "/root/testdata/sf0.001", tmp_path)
    assert [k for k, _ in sorted(rows)] == [2, 3, 4] and all(name for _, name in rows)
