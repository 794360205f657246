"""A session with the settings that the library's semantics rest on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "quarry", **conf: str) -> SparkSession:
    """ANSI arithmetic, UTC, adaptive execution with skewed joins split; more settings as keywords with _ for the dot."""
    builder = SparkSession.builder.appName(name).config("spark.sql.ansi.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config("spark." + key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset and everything runs in one process, as in tests, it is a temporary one; on a cluster
    it is an error, as executors wouldn't see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def tasks_for(*frames: DataFrame, each: int = 16 << 20) -> int:
    """A task for each so many bytes of the files that frames read; 0 where a size isn't known. Nothing is read."""
    total = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        total += sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return 0 if total >= 1 << 60 else -(-total // each)


def too_few(spark: SparkSession, parts: int, each: int = 16 << 20) -> bool:
    """Whether the session's settings would make tasks larger than ``each``; small tables don't count."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    return parts > 8 and (size > each or parts > int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_tasks(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by columns in a task for each 16 MB of files, where the session would make larger ones."""
    parts = tasks_for(df)
    return df.repartition(parts, *by) if too_few(df.sparkSession, parts) else df
