"""Data changes, definitions, relations, trees, sinks, models, functions and streams."""

from __future__ import annotations

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry import build as B
from quarry import functions as Q
from quarry import spec as S
from quarry.emit import to_sql
from quarry.operators import dml, models, params
from quarry.operators.relations import Ambiguity, RelationGraph
from quarry.operators.tables import ColumnDef, Difference, IndexDef, TableDef, compare, compare_tables, includes
from quarry.sources import sinks

c = F.col


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Data changes


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, 10, "a"), (2, 20, None), (None, 30, "c")], "id int, v int, s string")


def test_insert(spark, target):
    new = spark.createDataFrame([(1, 5), (9, 6)], "id int, v int")
    definition = TableDef("t", (ColumnDef("id", "int", True), ColumnDef("v", "int"), ColumnDef("s", "string", True, default="d")))
    change = dml.insert(target, new, unless_exists=["id"], definition=definition)
    assert rows(change.inserted) == [(9, 6, "d")] and change.table.count() == 4
    assert rows(dml.insert(target, new, also={"s": F.concat(c("id").cast("string"), F.lit("!"))}).inserted) == [(1, 5, "1!"), (9, 6, "9!")]
    numbered = dml.insert(target, new.drop("id"), identity="id").inserted
    assert sorted(i for i, *_ in rows(numbered)) == [3, 4]
    nulls = spark.createDataFrame([(None, 1)], "id int, v int")
    assert dml.insert(target, nulls, unless_exists=["id"]).inserted.count() == 0


def test_update_and_delete(spark, target):
    change = dml.update(target, {"v": c("v") * 2}, c("id") > 1)
    assert rows(change.table) == rows(spark.createDataFrame([(1, 10, "a"), (2, 40, None), (None, 30, "c")], "id int, v int, s string"))
    assert rows(dml.delete(target, c("id") > 1).table.select("v")) == [(10,), (30,)]
    assert dml.delete(target).table.count() == 0
    source = spark.createDataFrame([(1, 7), (5, 8)], "id int, w int")
    on = c("target.id") == c("source.id")
    assert rows(dml.update(target, {"v": c("source.w")}, source=source, on=on).table.select("v")) == [(20,), (30,), (7,)]
    assert rows(dml.delete(target, source=source, on=on).table.select("v")) == [(20,), (30,)]


def test_a_row_matched_twice_is_an_error(spark, target):
    twice = spark.createDataFrame([(1, 7), (1, 8)], "id int, w int")
    on = c("target.id") == c("source.id")
    with pytest.raises(Exception, match="several rows"):
        dml.update(target, {"v": c("source.w")}, source=twice, on=on).table.collect()
    assert dml.update(target, {"v": c("source.w")}, source=twice, on=on, first_match=True).table.count() == 3
    assert dml.delete(target, source=twice, on=on).deleted.count() == 1


def test_merge_outputs(spark, target):
    source = spark.createDataFrame([(1, 7), (5, 8)], "id int, w int")
    change = dml.merge(target, source, c("target.id") == c("source.id")).when_matched_update({"v": c("source.w")}).when_not_matched_insert_defaults({"id": c("source.id")}).when_not_matched_by_source_delete(c("target.v") > 25).run()
    assert rows(change.table) == [(1, 7, "a"), (2, 20, None), (5, None, None)]
    assert rows(change.output.groupBy("_action").count()) == [("DELETE", 1), ("INSERT", 1), ("UPDATE", 1)]
    assert rows(change.inserted) == [(5, None, None)] and change.deleted.count() == 2
    with pytest.raises(ValueError, match="no such"):
        dml.merge(target, source, F.lit(True)).when_matched_update({"x": F.lit(1)})


def test_commit_swaps_versions(spark, target, tmp_path):
    path = str(tmp_path / "t")
    dml.commit(spark, target, path)
    dml.commit(spark, dml.delete(spark.read.parquet(path), c("id") == 1), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]


# Definitions


USERS = TableDef("users", (ColumnDef("id", "int", primary_key=True, identity=True), ColumnDef("name", "string", size=50, default="x"), ColumnDef("org", "int", True, references=(("orgs", "id"),))), (IndexDef(("name",), unique=True),))


def test_definitions_survive_the_schema(spark):
    df = USERS.frame(spark, [(1, "a", None)])
    assert TableDef.of(df, "users").columns == USERS.columns and USERS.key == ("id",)
    USERS.recreate(spark)
    assert spark.table("users").count() == 0 and TableDef.of(spark.table("users"), "users").column("ID").identity
    USERS.drop(spark)
    with pytest.raises(ValueError, match="no table"):
        USERS.drop(spark, if_exists=False)
    with pytest.raises(ValueError, match="two columns"):
        TableDef("t", (ColumnDef("a", "int"), ColumnDef("A", "int")))


def test_comparison():
    other = USERS.with_(columns=lambda cs: [dataclasses.replace(x, type="bigint", nullable=True) if x.name == "org" else x for x in cs if x.name != "name"] + [ColumnDef("extra", "int")], indexes=())
    found = compare_tables(USERS, other)
    assert found.missing == ("name",) and found.extra == ("extra",) and found.different == {"org": Difference.TYPE} and found.indexes == USERS.indexes
    assert compare_tables(USERS, USERS) is None and compare([USERS], [USERS]) is None
    both = compare([USERS], [other, TableDef("new", ())])
    assert both.extra == ("new",) and set(both.different) == {"users"}
    assert includes(USERS, USERS.with_(columns=lambda cs: cs[:1])) and not includes(USERS.with_(columns=lambda cs: cs[:1]), USERS)


# Relations


def _diamond():
    make = lambda name, *parents: TableDef(name, (ColumnDef("id", "int", primary_key=True), *(ColumnDef(f"p_{p}", "int", references=((p, "id"),)) for p in parents)))
    return RelationGraph([make("zero"), make("a1", "zero"), make("b1", "zero"), make("ab2", "a1", "b1"), make("self", "self", "zero"), make("far")])


def test_relations(spark):
    g = _diamond()
    assert g.references("ab2") == ["a1", "b1"] and g.all_references("ab2") == ["a1", "b1", "zero"]
    assert g.referenced_by("zero") == ["a1", "b1", "self"] and g.all_referenced_by("zero") == ["a1", "b1", "self", "ab2"]
    assert g.references("self") == ["zero"] and g.references("self", itself=True) == ["self", "zero"]
    layers = g.hierarchy()
    assert layers[0] == ["zero", "far"] and layers[-1] == ["ab2"]
    assert len(g.paths("ab2", "zero")) == 2 and g.path("ab2", "zero") == ["ab2", "a1", "zero"]
    with pytest.raises(ValueError, match="2 ways"):
        g.path("ab2", "zero", Ambiguity.FAIL)
    assert g.path("ab2", "zero", lambda found: 1) == ["ab2", "b1", "zero"]
    with pytest.raises(ValueError, match="no foreign keys"):
        g.path("far", "zero")
    frames = {"zero": spark.createDataFrame([(1,)], "id int"), "a1": spark.createDataFrame([(2, 1)], "id int, p_zero int"), "b1": spark.createDataFrame([(3, 1)], "id int, p_zero int"), "ab2": spark.createDataFrame([(4, 2, 3)], "id int, p_a1 int, p_b1 int")}
    assert g.join(["ab2", "zero"], frames.get, via=["b1"]).count() == 1
    loop = lambda a, b: TableDef(a, (ColumnDef("id", "int"), ColumnDef("p", "int", references=((b, "id"),))))
    with pytest.raises(ValueError, match="circle"):
        RelationGraph([loop("x", "y"), loop("y", "x")])
    with pytest.raises(ValueError, match="isn't there"):
        RelationGraph([loop("x", "nowhere")])


# Trees and their text


def test_trees_are_walked_rewritten_and_stored():
    q = B.select(B.col("a", "t").as_("x"), B.call("SUM", B.col("b")).as_("s")).from_(B.table("t")).where(B.col("a") == 1).where(None).group_by(B.col("a", "t")).order_by(B.col("a").desc())
    tree = q.node
    assert {x.name for x in tree.walk() if isinstance(x, S.Col)} == {"a", "b"}
    assert tree.first(lambda x: isinstance(x, S.Call)).name == "SUM"
    renamed = tree.transform(lambda n: n.with_(name="z") if isinstance(n, S.Col) and n.name == "a" else n)
    assert {x.name for x in renamed.walk() if isinstance(x, S.Col)} == {"z", "b"} and tree.first(lambda x: isinstance(x, S.Col)).name == "a"
    assert tree.transform(lambda n: None if isinstance(n, S.Item) and n.alias == "s" else n).items == tree.items[:1]
    assert any(p is tree for _, p in tree.walk_with_parent())
    assert S.from_plain(S.to_plain(tree)) == tree and S.from_json(S.to_json(tree)) == tree and S.from_xml(S.to_xml(tree)) == tree
    assert S.tables(tree) == {"t": {"a", "b"}}
    assert tree == B.select(B.col("a", "t").as_("x"), B.call("SUM", B.col("b")).as_("s")).from_(B.table("t")).where(B.col("a") == 1).group_by(B.col("a", "t")).order_by(B.col("a").desc()).node


def test_text_for_other_engines():
    q = B.select(B.call("LEN", B.col("n")).as_("k"), (B.col("n") + "x").as_("j"), top=3).from_(B.table("t")).where(B.col("n").like("a%") & ~(B.col("v").in_(1, 2)) | B.col("o").is_null())
    assert to_sql(q.node, "tsql").startswith("SELECT TOP (3) LEN([n]) AS [k]") and "([n] + 'x')" in to_sql(q.node, "tsql")
    assert to_sql(q.node, "postgres").endswith("LIMIT 3") and '("n" || \'x\')' in to_sql(q.node, "postgres")
    assert "CONCAT(`n`, 'x')" in to_sql(q.node, "mysql") and "LENGTH(RTRIM(" in to_sql(q.node, "sqlite")
    assert to_sql(S.Literal("it's \\"), "spark") == r"'it\'s \\'" and to_sql(S.Literal("it's"), "postgres") == "'it''s'"
    assert to_sql(S.Col("a`b"), "spark") == "`a``b`" and to_sql(S.Col("a]b"), "tsql") == "[a]]b]"
    assert to_sql(B.date_diff("day", B.col("a"), B.col("b")).node, "tsql") == "DATEDIFF(DAY, [a], [b])"
    assert to_sql(B.select(B.lit(1).as_("a")).union(B.select(B.lit(2).as_("a"))).node) == "SELECT 1 AS `a` UNION SELECT 2 AS `a`"
    for bad in (lambda: B.col("a").in_(), lambda: B.values([(1, 2)], "v", "a"), lambda: to_sql(S.Call("f; DROP", ())), lambda: to_sql(S.Call("LEN", ())), lambda: to_sql(S.Cast(S.Literal(1), "nope")), lambda: B.select(B.col("a")).as_("q", "x", "y")):
        with pytest.raises(ValueError):
            bad()


def test_built_queries_run(spark):
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, s string").createOrReplaceTempView("built")
    t = B.table("built", "t")
    q = B.select(B.col("k", "t"), B.call("COUNT", B.col("s"), distinct=True).as_("n")).from_(t).group_by(B.col("k", "t"))
    assert rows(spark.sql(q.sql())) == [(1, 1), (2, 2)]
    outer = B.select(B.col("n", "d").as_("n")).from_(q.as_("d")).where(B.col("n", "d") > 1)
    assert rows(spark.sql(B.with_(outer).sql() if False else outer.sql())) == [(2,)]
    ranked = B.select(B.col("s"), B.call("ROW_NUMBER").over([B.col("k")], [B.col("s").desc()]).as_("r")).from_(B.table("built"))
    assert rows(spark.sql(ranked.sql())) == [("a", 1), ("b", 2), ("c", 1)]
    vs = B.values([(1, "x")], "v", "k", "w")
    assert rows(spark.sql(B.select(B.col("s", "t"), B.col("w", "v")).from_(t).left_join(vs, B.col("k", "t") == B.col("k", "v")).sql())) == [("a", "x"), ("b", None), ("c", None)]
    cased = B.select(B.case((B.col("k") == 1, "one"), otherwise="many").as_("c")).from_(B.table("built")).order_by(B.col("k")).offset_fetch(1, 1)
    assert rows(spark.sql(cased.sql())) == [("many",)]
    cte = B.with_(B.select(B.call("MAX", B.col("k")).as_("m")).from_(B.table("x")), x=B.select(B.col("k")).from_(B.table("built")))
    assert rows(spark.sql(cte.sql())) == [(2,)]


# Sinks, parameters, models


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, s string")
    assert sinks.fold(df, 0, lambda n, r: n + r["k"]) == 6
    seen: list = []
    sinks.each(df, lambda r: seen.append(r["k"]))
    assert sorted(seen) == sorted(r["k"] for r in sinks.stream_rows(df)) == [1, 2, 3]
    assert sorted(sinks.to_list(df, lambda r: r["k"], lambda k: k > 1)) == [2, 3]
    assert sinks.to_dict(df, lambda r: r["k"], lambda r: r["s"]) == {1: "a", 2: "b", 3: "a"}
    with pytest.raises(KeyError, match="more than once"):
        sinks.to_dict(df, lambda r: r["s"])
    assert sinks.to_dict(df, lambda r: r["s"], lambda r: r["k"], lambda k, old, new: old + new) == {"a": 4, "b": 2}
    assert sinks.scalar(df.orderBy("k")) == 1 and sinks.scalar(df.limit(0)) is None
    page = sinks.page(df, ["k"], 1, 5, lambda r: r["k"])
    assert page == sinks.Page([2, 3], 1, 3) and sinks.page(df, ["k"], 10, 5).total == 3
    with pytest.raises(ValueError):
        sinks.page(df, ["k"], -1, 5)
    raw = spark.createDataFrame([(bytearray(b"\x00\xff"), dt.date(2020, 1, 2))], "b binary, d date")
    for name, kind in (("b", "binary"), ("d", "date")):
        assert sinks.column_from_text(sinks.column_text(raw, name), name, kind).first()[0] == raw.first()[name]
    with sinks.cancellable(spark) as stop:
        assert df.count() == 3 and callable(stop)


def test_parameters(spark):
    assert params.bind("SELECT '@x', @a -- @b\n FROM t WHERE k IN (@l)", {"A": 1, "l": [2, 3]}) == ("SELECT '@x', :a -- @b\n FROM t WHERE k IN (:l_0, :l_1)", {"a": 1, "l_0": 2, "l_1": 3})
    for sql, values, part in (("@a", {}, "no value"), ("IN (@a)", {"a": []}, "empty"), ("= @a", {"a": [1]}, "IN"), ("@a", {"a": 1, "b": 2}, "no such"), ("@a", {"a": 1, "A": 2}, "case")):
        with pytest.raises(ValueError, match=part):
            params.bind(sql, values)


def test_models(spark):
    @dataclasses.dataclass
    class Pet:
        id: int
        name: str

    df = models.frame_of(spark, [Pet(1, "a"), Pet(2, "b")], big=lambda p: p.id > 1)
    assert rows(df.select("id", "big")) == [(1, False), (2, True)] and sorted(models.objects(df, Pet), key=lambda p: p.id) == [Pet(1, "a"), Pet(2, "b")]
    with pytest.raises(ValueError, match="twice"):
        models.frame_of(spark, [Pet(1, "a")], name=len)
    with pytest.raises(ValueError, match="no items"):
        models.frame_of(spark, [])
    toys = spark.createDataFrame([(1, "ball")], "pet int, toy string")
    joined = models.model_select(df, "pet").left(toys, "toy", lambda p, t: p.id == t.pet)
    found = joined.find(0, 10, ["pet.id"])
    assert found.total == 2 and found.items[0]["toy"]["toy"] == "ball" and found.items[1]["toy"] is None
    with pytest.raises(ValueError, match="joined already"):
        joined.inner(toys, "toy", lambda *x: F.lit(True))
    assert df.where(models.all_of(None, c("id") > 1)).count() == 1 and df.where(models.any_of()).count() == 0 and df.where(models.all_of()).count() == 2


# Functions


def test_functions(spark):
    one = spark.range(1)
    get = lambda x: one.select(x).first()[0]
    assert [get(Q.int_div(F.lit(a), F.lit(b))) for a, b in ((7, 2), (-7, 2), (7, -2), (1, 0))] == [3, -3, -3, None]
    assert get(Q.text_len(F.lit("ab  "), trailing=False)) == 2 and get(Q.text_len(F.lit("Ж "))) == 2 and get(Q.data_length(F.lit("Ж"))) == 2
    assert get(Q.index_of("x", F.lit("axx"))) == 2 and get(Q.left(F.lit("abc"), 0)) == "" and get(Q.right(F.lit("abc"), 2)) == "bc"
    assert get(Q.concat_text(F.lit(None), F.lit(1), F.lit("x"))) == "1x"
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    for part, n in (("year", 1), ("month", 1), ("day", 1), ("hour", 1), ("minute", 1), ("second", 1), ("millisecond", 1)):
        assert get(Q.date_diff(part, stamp("2020-12-31 23:59:59.999"), stamp("2021-01-01 00:00:00"))) == n
    with pytest.raises(ValueError, match="weeks"):
        Q.date_diff("wk", stamp("2020-01-01"), stamp("2020-01-02"))
    with pytest.raises(ValueError, match="unknown date part"):
        Q.date_add("eon", 1, stamp("2020-01-01"))
    with pytest.raises(ValueError, match="takes 1"):
        Q.portable("LOWER", F.lit("a"), F.lit("b"))
    start = dt.datetime(2023, 11, 6, 1, 33, 45)
    step, at, stamps = 1, start, []
    while at < start + dt.timedelta(days=730):
        stamps.append((at,))
        at += dt.timedelta(seconds=step)
        step = min(step * 2, 2 * 86400)
    df = spark.createDataFrame(stamps, "e timestamp_ntz").select("e", *[Q.date_diff(p, F.lit(start).cast("timestamp_ntz"), c("e")).alias(p) for p in ("year", "month", "day", "hour", "minute", "second")])
    trunc = {"day": lambda d: d.replace(hour=0, minute=0, second=0), "hour": lambda d: d.replace(minute=0, second=0), "minute": lambda d: d.replace(second=0), "second": lambda d: d}
    for r in df.collect():
        e = r["e"]
        assert r["year"] == e.year - 2023 and r["month"] == (e.year - 2023) * 12 + e.month - 11
        for p, f in trunc.items():
            assert r[p] == int((f(e) - f(start)).total_seconds()) // {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[p]


# Streams


def test_late_rows_and_state(spark, tmp_path):
    from quarry.streaming import run_to_end, windowed_totals

    schema = "at timestamp, k string, v double"
    one = [(dt.datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (1, 5, 61 % 60)] + [(dt.datetime(2024, 1, 1, 1, 30), "b", 2.0)]
    spark.createDataFrame(one, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = rows(run_to_end(windowed_totals(stream, "at", ["k"], "v", "1 hour", "10 minutes"), ["start", "k"]))
    assert [(k, n, t) for _, k, n, t in got] == [("a", 3, 3.0), ("b", 1, 2.0)]


def test_store_changes_tables_together(spark, tmp_path):
    from quarry.operators.store import Conflict, Store

    store = Store(spark, str(tmp_path / "store"))
    assert store.versions() == {}
    store.commit({"a": spark.range(3).toDF("id"), "b": spark.range(2).toDF("id")})
    before = store.versions()
    with store.transaction() as t:
        t.write("a", dml.delete(t.read("a"), c("id") == 0))
        t.write("a", dml.update(t.read("a"), {"id": c("id") + 10}))
        t.drop("b")
        assert rows(store.read("a")) == [(0,), (1,), (2,)] and rows(t.read("a")) == [(11,), (12,)]
        with pytest.raises(KeyError):
            t.read("b")
    assert rows(store.read("a")) == [(11,), (12,)] and set(store.versions()) == {"a"}
    assert rows(store.read("a", before)) == [(0,), (1,), (2,)] and rows(store.read("b", before)) == [(0,), (1,)]
    with pytest.raises(ZeroDivisionError), store.transaction() as t:
        t.write("a", spark.range(1).toDF("id"))
        1 / 0
    with pytest.raises(Conflict), store.transaction() as t:
        t.write("a", t.read("a").limit(1))
        store.commit({"a": spark.range(7).toDF("id")})
    assert store.read("a").count() == 7
    store.clean()
    assert store.read("a").count() == 7 and len(list((tmp_path / "store" / "a").iterdir())) == 1


def test_numbers_are_consecutive_after_a_shuffle(spark, target):
    new = spark.range(500).repartition(7).select(F.lit("n").alias("s"))
    got = dml.insert(target, new.withColumn("v", F.lit(0.0)), identity="id").inserted
    start = target.agg(F.max("id")).first()[0]
    assert sorted(r["id"] for r in got.collect()) == list(range(start + 1, start + 501))


def test_merge_that_only_inserts(spark, target):
    source = spark.createDataFrame([(1, 5), (1, 6), (8, 7), (8, 9), (9, -1)], "id int, w int")
    m = dml.merge(target, source, c("target.id") == c("source.id")).when_not_matched_insert({"id": c("source.id"), "v": c("source.w")}, c("source.w") > 0).run()
    assert rows(m.inserted) == [(8, 7, None), (8, 9, None)] and rows(m.table) == sorted([*rows(target), *rows(m.inserted)], key=repr)
    assert m.deleted.count() == 0 and {r["_action"] for r in m.output.collect()} == {"INSERT"}
    assert not any(x in m.table._jdf.queryExecution().executedPlan().toString() for x in ("Window", "Generate"))
