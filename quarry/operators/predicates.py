"""Predicates over other tables that have to hold at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_in(df: DataFrame, value: Column, query: DataFrame) -> DataFrame:
    """Rows whose ``value`` is among the only column of ``query``: a semi join, either side may be large."""
    return df.join(_named(query), value == F.col("_in"), "left_semi")


def not_in(df: DataFrame, value: Column, query: DataFrame) -> DataFrame:
    """Rows whose ``value`` is certainly not among the only column of ``query``, with SQL's three values.

    A null among them leaves no rows; a null value stays only if ``query`` has no rows. The engine's own
    NOT IN needs the whole query on each executor; this is an anti join that shuffles both sides, and one
    row with two counts, which is broadcast.
    """
    among = _named(query)
    counts = among.agg(F.count(F.lit(1)).alias("_rows"), F.count("_in").alias("_values"))
    rest = df.join(among, value == F.col("_in"), "left_anti").crossJoin(F.broadcast(counts))
    return rest.where((F.col("_rows") == 0) | (F.col("_rows") == F.col("_values")) & value.isNotNull()).drop("_rows", "_values")


def _named(query: DataFrame) -> DataFrame:
    if len(query.columns) != 1:
        raise ValueError("IN takes a query with one column")
    return query.toDF("_in")
