"""Pairs of rows that share a group: a result that is as large as the square of the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairs_within(df: DataFrame, key: str, groups: list[str], x: str, y: str, block: int = 1024, each: int = 1 << 25) -> DataFrame:
    """All pairs of rows that agree in ``groups``, the one with the smaller ``key`` as ``x``, the other as ``y``.

    As in SQL, nulls agree with nothing, and rows with the same key are no pair. A group is cut into blocks of
    ``block`` keys in order, and each two of its blocks are one row of two arrays, which is expanded last. So
    a task's memory doesn't follow the group's size, and there is a task for about ``each`` pairs, however
    large the group. Sizes of groups are counted at once; the rows of a group are numbered in one task.
    """
    rows = df.select(F.col(key).alias("k"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]).dropna()
    by = [f"g{i}" for i in range(len(groups))]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = sizes.agg(F.sum(F.expr("double(n) * (n - 1) / 2"))).first()[0] or 0
    place = F.row_number().over(Window.partitionBy(*by).orderBy("k")) - 1
    blocks = rows.withColumn("b", F.floor(place / block)).groupBy(*by, "b").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    blocks = blocks.join(sizes, by).withColumn("last", F.floor((F.col("n") - 1) / block))
    tile = [*by, "p", "q"]
    parts = max(1, -(-int(total) // each))
    low = blocks.select(*by, F.col("b").alias("p"), F.explode(F.sequence("b", "last")).alias("q"), F.col("ks").alias("xs")).repartition(parts, *tile)
    high = blocks.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), "b")).alias("p"), F.col("b").alias("q"), F.col("ks").alias("ys")).repartition(parts, *tile)
    pairs = low.join(high, tile).select(F.explode("xs").alias(x), "ys").select(x, F.explode("ys").alias(y))
    return pairs.where(F.col(x) < F.col(y))
