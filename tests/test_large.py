"""Results that are large or that one task must not hold."""

from __future__ import annotations

from itertools import product

import pytest
from pyspark.sql import functions as F

from quarry.operators.pairs import pairs_within
from quarry.plans import catalog
from quarry.sources import sinks


def test_pairs_of_blocks_are_all_pairs(spark):
    rows = [(k, g, s) for g in (1, 2, None) for s in ("a", None, "b") for k in [*range(25), 7, 7, None] if (k or 0) % 3 or s == "a"]
    df = spark.createDataFrame(rows, "k bigint, g int, s string")
    got = sorted(tuple(r) for r in pairs_within(df, "k", ["g", "s"], "x", "y", block=4, each=50).collect())
    full = [r for r in rows if None not in r]
    assert got == sorted((a[0], b[0]) for a, b in product(full, full) if a[1:] == b[1:] and a[0] < b[0])
    assert pairs_within(df.where("k > 99"), "k", ["g", "s"], "x", "y").collect() == []


def test_pairs_of_one_group_are_made_in_several_tasks(spark, tmp_path):
    n = 12_000
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = catalog.QUERIES["self_join"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in found) == n * (n - 1) // 2
    assert len(found) > 1


@pytest.mark.parametrize("offset", [0, 1, 3, 4, 7, 13, 14, 50])
def test_rows_after_an_offset(spark, offset):
    rows = [(k, v) for k in (5, 1, None, 3) for v in ("b", None, "a")] + [(1, "b"), (1, "b")]
    whole = sorted(rows, key=lambda r: tuple((x is None, x or "") for x in r))
    df = spark.createDataFrame(rows, "k bigint, v string").repartition(3)
    got = [tuple(r) for r in sinks.after_frame(df, ["k"], offset).collect()]
    assert [k for k, _ in got] == [k for k, _ in whole[offset:]]
    assert sorted(got, key=repr) == sorted(whole[offset:], key=repr)
    assert [r["k"] for r in sinks.after_frame(df.select("k"), ["k"], offset).collect()] == [k for k, _ in whole[offset:]]
    assert sinks.after_frame(df.where("k > 99"), ["k"], offset).collect() == []


def test_equal_rows_after_an_offset(spark):
    assert sinks.after_frame(spark.range(250_000).select(F.lit(1).alias("k")), ["k"], 20).count() == 249_980


def test_an_offset_is_not_taken_in_one_task(spark, tmp_path):
    spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = catalog.QUERIES["offset_only"](spark, str(tmp_path)).select("o_orderkey", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["o_orderkey"] for r in found] == list(range(20, 20_000))
    assert len({r["p"] for r in found}) > 1


def test_nulls_are_behind_an_offset(spark, tmp_path):
    spark.createDataFrame([(k,) for k in [None] * 3 + list(range(22))], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r[0] for r in catalog.QUERIES["offset_only"](spark, str(tmp_path)).collect()] == [20, 21, None, None, None]


def test_tasks_follow_the_size_of_the_files(spark, tmp_path):
    from quarry.session import tasks_for

    spark.range(1000).write.parquet(f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    size = tasks_for(df, each=1)
    assert size > 1000 and tasks_for(df.where("id > 3"), df, each=1) == 2 * size and tasks_for(df) == 1


def test_joins_along_keys_follow_the_size_of_the_files(spark, monkeypatch, capsys):
    from quarry import session
    from quarry.operators import relations

    folder = "/root/testdata/sf0.001"
    want = sorted(tuple(r) for r in catalog.QUERIES["fk_multi_join"](spark, folder).collect())
    for module in (session, relations):
        monkeypatch.setattr(module, "tasks_for", lambda *frames, each=0: 12)
    found = catalog.QUERIES["fk_multi_join"](spark, folder)
    assert sorted(tuple(r) for r in found.collect()) == want
    found.explain("formatted")
    assert capsys.readouterr().out.count(", 12), REPARTITION_BY_NUM") >= 6
    assert not session.too_few(spark, 8) and session.too_few(spark, 9)
