"""Session helpers shared by the operators: shared storage, bounded filters, batch limits."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application: their Python may not find it by itself."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parents[1]
        out = tempfile.mkdtemp(prefix="quarry-")  # the driver's own; Spark serves the file to executors
        atexit.register(shutil.rmtree, out, True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{out}/{root.name}", "zip", root.parent, root.name))


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small when the session still has Spark's default, as texts can be long."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, "1000")


def materialize(df: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends, executors may be lost.

    The table goes when the application ends, if nothing discards it before; it is added to ``made``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    out = spark.read.schema(df.schema).parquet(path)
    if made is not None:
        made.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that :func:`materialize` wrote and nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sampled(column: str, wanted: int, total: int) -> Column:
    """True of about ``wanted`` of ``total`` rows, by a hash of a column; of all, if there are no more."""
    part = F.pmod(F.xxhash64(F.col(column), F.lit(3)), F.lit(1 << 40))
    return part < F.lit(min(1 << 40, (1 << 40) * wanted // max(1, total)))


def sized_shards(docs: DataFrame, column: str, each: int, least: int = 16, most: int | None = None) -> int:
    """Number of key ranges: one for each ``each`` bytes of text in all rows, which are read for it."""
    total = docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return min(max(least, -(-total // each)), most or 1 << 30)


def spread(df: DataFrame, shard: str, load: Column, by: Column, task: int) -> DataFrame:
    """``df`` and salt: rows of a shard with a load of more than ``task`` are split over several by a hash."""
    heavy = df.groupBy(F.col(shard).alias("s")).agg(F.ceil(F.sum(load) / task).alias("parts")).where("parts > 1")
    found = df.join(F.broadcast(heavy), F.col(shard) == F.col("s"), "left")  # at most one row a shard
    return found.withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("s", "parts")


def join_split(rows: DataFrame, key: str, table: DataFrame, on: str, total: int | None = None, sizes: DataFrame | None = None, how: str = "inner", least: int = 1000, most: int = 10_000) -> DataFrame:
    """``rows`` joined to ``table`` where ``key`` equals ``on``; hot keys are split over several tasks.

    A key is hot if it has more than ``least`` rows and more than one in ``most`` of all: there are fewer than
    ``most`` such keys, which bounds what is broadcast. Their rows are dealt out by a hash of the other
    columns, and the table's rows for them go to each part. ``sizes`` (split_key, split_n) and ``total`` are
    counted if they aren't given. Columns of the two sides must have different names.
    """
    total = rows.count() if total is None else total
    if total <= least:
        return rows.join(table, F.col(key) == F.col(on), how)
    limit = max(least, -(-total // most))
    if sizes is None:
        sizes = rows.groupBy(F.col(key).alias("split_key")).agg(F.count(F.lit(1)).alias("split_n"))
    hot = F.broadcast(sizes.where(F.col("split_n") > limit).select("split_key", F.ceil(F.col("split_n") / limit).alias("split_parts")))
    part = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.coalesce("split_parts", F.lit(1)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("split_parts", F.lit(1).cast("long")) - 1))
    left = rows.join(hot, F.col(key) == F.col("split_key"), "left").select(*rows.columns, part.alias("split_l"))
    right = table.join(hot, F.col(on) == F.col("split_key"), "left").select(*table.columns, every.alias("split_r"))
    return left.join(right, (F.col(key) == F.col(on)) & (F.col("split_l") == F.col("split_r")), how).drop("split_l", "split_r")


def id_filter(ids: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """A bitmap over hashed ids, always ``bits`` wide however many ids there are.

    It only spares work: false positives are removed by an exact join later, and a saturated
    bitmap lets everything pass to that join.
    """
    cell = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    rows = (
        ids.select(F.shiftright(cell, 6).alias("w"), F.expr("1L").alias("one"), (cell % 64).cast("int").alias("b"))
        .select("w", F.expr("shiftleft(one, b)").alias("v"))
        .groupBy("w")
        .agg(F.bit_or("v").alias("v"))
        .collect()
    )
    out = np.zeros(bits // 64, np.int64)
    for r in rows:
        out[r["w"]] = r["v"]
    return out.view(np.uint64)


def in_filter(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which hashes (Spark's xxhash64 of the id, int64) the bitmap holds."""
    cell = np.mod(hashed.astype(np.int64), np.int64(len(bitmap) * 64)).astype(np.uint64)
    return (bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
