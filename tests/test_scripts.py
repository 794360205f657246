"""Temporary tables, steps, changes from objects, readers, and what queries tell of tables."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from quarry import build as B
from quarry import spec as S
from quarry.emit import to_sql
from quarry.operators import script
from quarry.operators.tables import ColumnDef, TableDef
from quarry.sources import readers
from quarry.tsql import Session, parse
from quarry.tsql.artifacts import table_artifacts


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_temp_tables_stay_as_they_were(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "id int, s string").write.parquet(path)
    kept, definition = script.temp_table(spark.read.parquet(path), "#snap", ["ID"])
    spark.createDataFrame([(2, "b")], "id int, s string").write.mode("overwrite").parquet(path)
    assert rows(kept) == rows(spark.table("snap")) == [(1, "a")] and definition.key == ("id",)
    assert script.table_exists(spark, "#snap") and script.drop_temp(spark, "#snap") and not script.table_exists(spark, "#snap")
    with pytest.raises(ValueError, match="no such columns"):
        script.temp_table(kept, "#x", ["z"])
    with pytest.raises(ValueError, match="no rows"):
        script.temp_values(spark, [], "a int", "#x")


def test_steps(spark):
    done: list = []
    assert script.run_all(lambda: done.append(1), lambda: done.append(2), lambda: len(done)) == 2
    assert script.when(True, lambda: 1) == 1 and script.when(lambda: False, lambda: 1) is None and script.when(spark.range(0), lambda: 1, lambda: 2) == 2


def test_changes_from_objects(spark):
    @dataclasses.dataclass
    class Item:
        id: int
        s: str

    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, s string, v double")
    assert rows(script.insert_objects(target, [Item(3, "c")], v=lambda x: x["id"] / 2).inserted) == [(3, "c", 1.5)]
    assert rows(script.update_objects(target, [Item(2, "z")], ["id"], also={"v": F.col("target.v") + 1}).table) == [(1, "a", 1.0), (2, "z", 3.0)]
    found = script.merge_objects(target, [Item(2, "z"), Item(9, "n")], ["id"], delete_others=True, insert_also={"v": F.lit(0.0)})
    assert rows(found.table) == [(2, "z", 2.0), (9, "n", 0.0)]
    assert rows(script.merge_objects(target, [Item(2, "z"), Item(9, "n")], ["id"], update=False, exclude=["s"]).table) == [(1, "a", 1.0), (2, "b", 2.0), (9, None, None)]
    for bad in (lambda: script.insert_objects(target, []), lambda: script.update_objects(target, [Item(1, "x")], []), lambda: script.insert_objects(target, [{"nope": 1}]), lambda: script.update_objects(target, [Item(1, "x")], ["id"], also={"s": F.lit("y")})):
        with pytest.raises(ValueError):
            bad()


def test_in_and_not_in_know_nulls(spark):
    from quarry.operators.predicates import is_in, not_in

    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    some, nulls, none = (spark.createDataFrame(x, "b int") for x in ([(2,), (2,)], [(2,), (None,)], []))
    a = F.col("a")
    assert [rows(not_in(df, a, q)) for q in (some, nulls, none)] == [[(1,)], [], [(1,), (2,), (None,)]]
    assert [rows(is_in(df, a, q)) for q in (some, nulls, none)] == [[(2,)], [(2,)], []]
    with pytest.raises(ValueError, match="one column"):
        is_in(df, a, spark.createDataFrame([(1, 2)], "a int, b int"))


def test_readers(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, s string").write.json(str(tmp_path / "j"))
    assert rows(readers.read_files(spark, str(tmp_path / "j"), "json", "id int, s string")) == [(1, "a")]
    with pytest.raises(ValueError, match="needs a schema"):
        readers.read_files(spark, str(tmp_path / "j"), "json")
    with pytest.raises(ValueError, match="unknown format"):
        readers.read_files(spark, "x", "xls")
    TableDef("catalog_users", (ColumnDef("id", "int", primary_key=True), ColumnDef("name", "string", default="x"))).recreate(spark)
    found = {t.name: t for t in readers.read_catalog(spark)}
    assert found["catalog_users"].key == ("id",) and found["catalog_users"].column("name").default == "x"
    spark.sql("DROP TABLE catalog_users")
    assert readers.shape(spark.range(1).select(F.lit("a").alias("s"))) == [("s", "string", False)]


def test_table_functions(spark):
    from pyspark.sql.functions import udtf

    @udtf(returnType="n int")
    class UpTo:
        def eval(self, most: int):
            for i in range(most):
                yield (i,)

    readers.register_table_function(spark, "up_to", UpTo)
    session = Session(spark)
    session.register("k", spark.createDataFrame([(1,), (3,)], "m int"))
    assert rows(session.query("SELECT k.m, f.n FROM k CROSS APPLY up_to(k.m) f")) == [(1, 0), (3, 0), (3, 1), (3, 2)]


def test_shape_and_artifacts(spark):
    session = Session(spark)
    session.register("t", spark.createDataFrame([(1, "a")], "id int, s string"))
    assert [x[:2] for x in session.shape("SELECT id + 1 AS k, COUNT(*) AS n FROM t WHERE s = @p GROUP BY id + 1")] == [("k", "int"), ("n", "bigint")]
    tree = parse("SELECT u.name, SUM(o.total) AS s FROM users u JOIN orders o ON o.user_id = u.id WHERE u.name LIKE 'a%' AND o.made > DATEADD(day, 1, o.sent) AND u.age BETWEEN 1 AND 2 AND o.rate IN (1, 2.5) GROUP BY u.name")
    found = {t.name: {c.name: c.type for c in t.columns} for t in table_artifacts(tree)}
    assert found == {"users": {"name": "string", "id": "int", "age": "int"}, "orders": {"total": "double", "user_id": "int", "made": "timestamp_ntz", "sent": "timestamp_ntz", "rate": "double"}}


def test_flattened_joins_and_schemas():
    a, b, d = (B.table(x) for x in "abd")
    tree = B.select(B.lit(1)).from_(a).inner_join(b, B.col("x", "a") == B.col("x", "b")).cross_join(d).node.source
    found, test = S.flatten(tree)
    assert found == [a, b, d] and test == (B.col("x", "a") == B.col("x", "b")).node
    with pytest.raises(ValueError, match="LEFT"):
        S.flatten(S.Join("LEFT", a, b, test))
    q = B.select(B.col("x")).from_(B.table("t", schema="dbo"))
    assert to_sql(q.node, "postgres", schemas={"dbo": "public"}) == 'SELECT "x" FROM "public"."t"'
