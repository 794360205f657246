"""Streams: the batch expressions with watermarks, late rows dropped after a delay."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.session import shared_folder


def windowed_totals(stream: DataFrame, time: str, keys: list[str], value: str, size: str, late: str) -> DataFrame:
    """Count and sum of ``value`` for each tumbling window and key; state is dropped once the watermark passes."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def run_to_end(result: DataFrame, keys: list[str]) -> DataFrame:
    """Everything that is there now goes through the stream; ``keys`` tell the rows of ``result`` apart.

    Each batch writes the rows it changed to the shared folder (again, under the same name, if it is run
    again), and the last of each row is read back: nothing goes to the driver, and the state that a watermark
    has passed is dropped.
    """
    spark = result.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = result.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    q = result.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not rows.getFileSystem(spark._jsc.hadoopConfiguration()).exists(rows):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(f"{path}/rows")
    rest = [c for c in result.columns if c not in keys]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col("last").getField(c).alias(c) for c in result.columns])


def hourly_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream, by hour and type."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_end(windowed_totals(stream, "ts", ["event_type"], "value", "1 hour", "1 day"), ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))
