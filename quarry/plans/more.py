"""Further queries over the driver's tables: sinks, scripts, definitions, trees and texts, with the SQL that gives the same rows."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import build as B
from quarry import spec as S
from quarry.emit import to_sql
from quarry.plans.catalog import Tables, c, lit, money, query


def _rows(t: Tables, rows: list, schema: str) -> DataFrame:
    """A few rows that were worked out on the driver."""
    return t.spark.createDataFrame(rows, schema)


def _session(t: Tables):
    from quarry.tsql import Session

    s = Session(t.spark)
    for name in ("region", "nation", "supplier", "customer", "part", "orders"):
        s.register(name, getattr(t, name))
    return s


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Sources


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10")
def temp_table_scan(t):
    from quarry.operators import script

    script.temp_table(t.nation.where("n_nationkey < 10"), "#quarry_scan", ["n_nationkey"])
    return t.spark.table("quarry_scan").select("n_nationkey", "n_name")


@query("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def alias_registry(t):
    auto = B.Aliases()
    a, b = auto("nation"), auto("nation")
    q = B.select(a.col("n_name").as_("one"), b.col("n_name").as_("other")).from_(a).inner_join(b, (a.col("n_regionkey") == b.col("n_regionkey")) & (a.col("n_nationkey") < b.col("n_nationkey")))
    return _session(t).run(q.node)


@dataclasses.dataclass
class Word:
    k: int
    word: str


_WORDS = (Word(0, "zero"), Word(1, "it's"), Word(3, "three"))
_WORDS_SQL = "(VALUES (0, 'zero'), (1, 'it''s'), (3, 'three')) AS v(k, word)"


@query(f"SELECT n_name, word, word || '!' AS loud FROM nation JOIN {_WORDS_SQL} ON k = n_regionkey")
def objects_as_table(t):
    from quarry.operators.models import frame_of

    words = frame_of(t.spark, _WORDS, "k int, word string, loud string", loud=lambda x: x.word + "!")
    return t.nation.join(F.broadcast(words), c("k") == c("n_regionkey")).select("n_name", "word", "loud")


@query("SELECT n_name, g.i AS step FROM nation, generate_series(1, n_regionkey) AS g(i) WHERE n_regionkey > 0")
def aliased_table_function(t):
    from pyspark.sql.functions import udtf

    from quarry.sources.readers import register_table_function

    @udtf(returnType="i: bigint")
    class Steps:
        def eval(self, n: int):
            for i in range(1, n + 1):
                yield (i,)

    name = f"quarry_steps_{uuid.uuid4().hex[:8]}"
    register_table_function(t.spark, name, Steps)
    return t.spark.sql(f"SELECT n_name, g.i AS step FROM {{nation}} CROSS JOIN LATERAL {name}(n_regionkey) AS g(i)", nation=t.nation)


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def database_read(t):
    """Another database by JDBC: one that driver and executors open from the shared folder."""
    from quarry.sources.readers import read_database
    from quarry.sources.sinks import DERBY_DRIVER, derby_archive

    t.spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = derby_archive(t.region, "region_copy")
    return read_database(t.spark, url, "region_copy", driver=DERBY_DRIVER).where("r_regionkey > 1").select("r_regionkey", "r_name")


@query("SELECT * FROM (VALUES ('k', 'int', false, true), ('word', 'string', true, false)) AS v(name, kind, nullable, pk)")
def definition_from_schema(t):
    from quarry.operators.tables import ColumnDef, TableDef

    made = TableDef("w", (ColumnDef("k", "int", primary_key=True), ColumnDef("word", "string", True))).schema()
    found = TableDef.of(t.spark.createDataFrame([], made), "w")
    return _rows(t, [(x.name, x.type, x.nullable, x.primary_key) for x in found.columns], "name string, kind string, nullable boolean, pk boolean")


# Sinks: what they give for a small table


@query("SELECT CAST(sum(n_nationkey * n_regionkey) AS BIGINT) AS total, count(*) AS n FROM nation")
def sink_fold(t):
    from quarry.sources import sinks

    total = sinks.fold(t.nation, 0, lambda a, r: a + r["n_nationkey"] * r["n_regionkey"])
    seen: list = []
    sinks.each(t.nation, lambda r: seen.append(r["n_name"]))
    return _rows(t, [(total, len(seen))], "total bigint, n bigint")


@query("SELECT n_name FROM nation WHERE n_name LIKE 'C%'")
def sink_list(t):
    from quarry.sources import sinks

    return _rows(t, [(x,) for x in sinks.to_list(t.nation, lambda r: r["n_name"], lambda n: n.startswith("C"))], "n_name string")


@query("SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def sink_dictionary(t):
    from quarry.sources import sinks

    found = sinks.to_dict(t.nation, lambda r: r["n_regionkey"], lambda r: r["n_name"], lambda k, a, b: f"{a},{b}")
    return _rows(t, [(k, ",".join(sorted(v.split(",")))) for k, v in found.items()], "k int, names string")


@query("SELECT max(o_totalprice) AS v, CAST(NULL AS DOUBLE) AS none FROM orders")
def sink_scalar(t):
    from quarry.sources import sinks

    return _rows(t, [(sinks.scalar(t.orders.agg(F.max("o_totalprice"))), sinks.scalar(t.orders.where("false").select("o_totalprice")))], "v double, none double")


@query("SELECT n_nationkey FROM nation")
def sink_stream(t):
    from quarry.sources import sinks

    return _rows(t, [(r["n_nationkey"],) for r in sinks.stream_rows(t.nation)], "n_nationkey int")


@query("SELECT value FROM events WHERE event_id % 50 = 0")
def column_text_round_trip(t):
    from quarry.sources import sinks

    return sinks.column_from_text(sinks.column_text(t.events.where("event_id % 50 = 0"), "value"), "value", "double")


# Scripts, transactions, parameters


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def statement_list(t):
    from quarry.operators import script

    kept: dict = {}

    def first():
        kept["open"], _ = script.temp_table(t.orders.where("o_orderstatus = 'O'"), "#quarry_open")

    return script.run_all(first, lambda: None, lambda: kept["open"].agg(F.count(lit(1)).alias("n")))


@query("SELECT n_nationkey, n_regionkey + 10 AS n_regionkey FROM nation WHERE n_nationkey <> 3")
def transaction(t):
    """What an inner error takes back, and what stays."""
    s = _session(t)
    with s.transaction():
        s.execute("DELETE FROM nation WHERE n_nationkey = 3")
        try:
            with s.transaction():
                s.execute("DELETE FROM nation")
                raise KeyError
        except KeyError:
            pass
        s.execute("UPDATE nation SET n_regionkey = n_regionkey + 10")
    return s.query("SELECT n_nationkey, n_regionkey FROM nation")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus IN ('O', 'P') AND o_orderpriority <> '1-URGENT'")
def literals_as_parameters(t):
    from quarry.change_text import parametrised
    from quarry.tsql import parse

    tree, values = parametrised(parse("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus IN ('O', 'P') AND o_orderpriority <> '1-URGENT'"))
    return _session(t).run(tree, values)


@query("SELECT n_name, n_regionkey * 2 + 1 AS v FROM nation")
def unsafe_value(t):
    return _session(t).run(B.select(B.col("n_name"), B.raw("n_regionkey * 2 + 1").as_("v")).from_(B.table("nation")).node)


# Joins and queries put together


@query("SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000")
def join_flattened(t):
    """A tree of joins as sources and one condition."""
    tree = S.Join("INNER", S.Table("customer"), S.Join("INNER", S.Table("nation"), S.Table("region"), (B.col("n_regionkey") == B.col("r_regionkey")).node), (B.col("c_nationkey") == B.col("n_nationkey")).node)
    sources, test = S.flatten(tree)
    out = sources[0]
    for s in sources[1:]:
        out = S.Join("CROSS", out, s)
    q = B.select(B.col("c_custkey"), B.col("r_name")).from_(out).where(B.E(test)).where(B.col("c_acctbal") > 9000)
    return _session(t).run(q.node)


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 3")
def join_added_later(t):
    """A join, an order and a page put on a query that was made before."""
    q = B.select(B.col("o_orderkey"), B.col("c_name")).from_(B.table("orders"))
    q = q.inner_join(B.table("customer"), B.col("o_custkey") == B.col("c_custkey"))
    return _session(t).run(q.order_by(B.col("o_totalprice").desc(), B.col("o_orderkey")).offset_fetch(3, 7).node)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4 OFFSET 2")
def top_after_offset(t):
    return _session(t).query("SELECT TOP 4 o_orderkey FROM orders ORDER BY o_orderkey OFFSET 2 ROWS")


@query("SELECT * FROM (VALUES ('first', 'd,b,a'), ('picked', 'd,c,a'), ('fail', 'error')) AS v(policy, way)")
def ambiguous_path(t):
    from quarry.operators.relations import Ambiguity, RelationGraph
    from quarry.operators.tables import ColumnDef, TableDef

    key = ColumnDef("id", "int", primary_key=True)
    ref = lambda *to: tuple(ColumnDef(f"{x}_id", "int", references=((x, "id"),)) for x in to)
    g = RelationGraph([TableDef("a", (key,)), TableDef("b", (key, *ref("a"))), TableDef("c", (key, *ref("a"))), TableDef("d", (key, *ref("b", "c")))])
    try:
        failed = ",".join(g.path("d", "a", Ambiguity.FAIL))
    except ValueError:
        failed = "error"
    return _rows(t, [("first", ",".join(g.path("d", "a"))), ("picked", ",".join(g.path("d", "a", lambda ways: len(ways) - 1))), ("fail", failed)], "policy string, way string")


@query("SELECT e.event_id, (SELECT max(o.ts) FROM events o WHERE o.user_id = e.user_id AND o.ts < e.ts AND o.event_type = 'purchase') AS before FROM events e WHERE e.event_type = 'click'")
def join_as_of(t):
    """The last purchase before each click, by a window over both instead of a join of all pairs."""
    both = t.events.where("event_type IN ('click', 'purchase')")
    past = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    micros = both.withColumn("ts", F.unix_micros(c("ts").cast("timestamp")))
    last = F.max(F.when(c("event_type") == "purchase", c("ts"))).over(past)
    return micros.withColumn("last", last).where("event_type = 'click'").select("event_id", F.timestamp_micros("last").cast("timestamp_ntz").alias("before"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS rich FROM orders GROUP BY o_orderpriority")
def agg_filter(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(c("o_orderstatus") == "O").alias("open"), F.count_distinct(F.when(c("o_totalprice") > 100000, c("o_custkey"))).alias("rich"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events")
def window_range_frame(t):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(c("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return t.events.select("event_id", F.count(lit(1)).over(w).alias("n"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1")
def window_qualify(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey")


# Functions


@query("SELECT true AS now, true AS utc, true AS near")
def current_times(t):
    s = _session(t)
    return s.query("SELECT CAST(CASE WHEN GETDATE() > '2020-01-01' THEN 1 ELSE 0 END AS bit) AS now, CAST(CASE WHEN GETUTCDATE() > '2020-01-01' THEN 1 ELSE 0 END AS bit) AS utc, CAST(CASE WHEN ABS(DATEDIFF(hour, SYSDATETIME(), SYSUTCDATETIME())) < 25 THEN 1 ELSE 0 END AS bit) AS near")


@query("SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS a, strlen(p_name) AS b, repeat(p_brand, 2) AS c, CAST(strpos(p_name, 'e') AS INTEGER) AS d, CAST(strpos(p_name, 'e') AS INTEGER) AS e FROM part")
def function_aliases(t):
    return _session(t).query("SELECT p_partkey, CHAR_LENGTH(p_name) AS a, OCTET_LENGTH(p_name) AS b, REPLICATE(p_brand, 2) AS c, LOCATE('e', p_name) AS d, STRPOS(p_name, 'e') AS e FROM part").withColumn("b", c("b").cast("bigint"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, CAST(len(list(event_type)) AS INTEGER) AS n FROM events GROUP BY user_id")
def array_functions(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.count("event_type").cast("int").alias("n"))


@query("SELECT n_name, reverse(n_name) AS v FROM nation")
def function_by_name(t):
    return _session(t).run(B.select(B.col("n_name"), B.call("reverse", B.col("n_name")).as_("v")).from_(B.table("nation")).node)


@query("SELECT n_nationkey, n_nationkey * 2 AS a, n_nationkey * 3 AS b FROM nation WHERE n_nationkey * 2 > 10")
def functions_with_schema(t):
    s = _session(t)
    s.register_function("dbo.twice", lambda x: None if x is None else 2 * x, "int")
    s.register_function("main.dbo.thrice", lambda x: None if x is None else 3 * x, "int")
    return s.query("SELECT n_nationkey, dbo.twice(n_nationkey) AS a, main.dbo.thrice(n_nationkey) AS b FROM nation WHERE dbo.twice(n_nationkey) > 10")


# Changes


def _execute(t: Tables, text: str, table: str = ""):
    s = _session(t)
    change = s.execute(text)
    return getattr(change, table) if table else change.table


@query("SELECT * FROM (VALUES (100, 'ATLANTIS'), (101, 'MU')) AS v(n_nationkey, n_name)")
def insert_output(t):
    return _execute(t, "INSERT INTO nation (n_nationkey, n_name, n_regionkey) OUTPUT INSERTED.n_nationkey, INSERTED.n_name VALUES (100, 'ATLANTIS', 0), (101, 'MU', NULL)", "output")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (40, 'own'), (41, 'next'), (42, 'next')) AS v(a, b)")
def identity_insert(t):
    from quarry.operators import dml

    return dml.insert(t.region, t.values("(40, 'own'), (NULL, 'next'), (NULL, 'next')", "r_regionkey", "r_name"), identity="r_regionkey", keep_identity=True).table


@query("SELECT c_custkey, CASE WHEN r_name = 'ASIA' THEN c_acctbal + n_regionkey + 1 ELSE c_acctbal END AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def tsql_update_joins(t):
    return _execute(t, "UPDATE c SET c_acctbal = c.c_acctbal + n.n_regionkey + 1 FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey INNER JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def tsql_delete_left_join(t):
    return _execute(t, "DELETE c FROM customer AS c LEFT JOIN orders AS o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NULL").select("c_custkey")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def tsql_delete_output(t):
    return _execute(t, "DELETE c OUTPUT DELETED.c_custkey FROM customer AS c INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey INNER JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'", "output")


_MERGE_TEXT = """MERGE INTO orders AS t USING (SELECT o_orderkey * 3 AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F') AS s ON t.o_orderkey = s.k
WHEN MATCHED AND s.p < 50000 THEN DELETE WHEN MATCHED THEN UPDATE SET o_totalprice = s.p
WHEN NOT MATCHED THEN INSERT (o_orderkey, o_totalprice) VALUES (s.k, s.p)
WHEN NOT MATCHED BY SOURCE AND t.o_orderstatus = 'P' THEN DELETE WHEN NOT MATCHED BY SOURCE AND t.o_orderstatus = 'O' THEN UPDATE SET o_orderstatus = 'X';"""
_MERGE_SIDES = "WITH s AS (SELECT o_orderkey * 3 AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F'), j AS (SELECT t.o_orderkey AS tk, t.o_totalprice AS tp, t.o_orderstatus AS st, k, p FROM orders t FULL JOIN s ON t.o_orderkey = k) "


@query(_MERGE_SIDES + "SELECT coalesce(tk, k) AS o_orderkey, CASE WHEN k IS NULL THEN tp ELSE p END AS o_totalprice, CASE WHEN k IS NULL AND st = 'O' THEN 'X' ELSE st END AS o_orderstatus FROM j WHERE NOT coalesce(tk IS NOT NULL AND k IS NOT NULL AND p < 50000, false) AND NOT coalesce(k IS NULL AND st = 'P', false)")
def merge_orders(t):
    """A merge of whole tables with all kinds of clauses."""
    return _execute(t, _MERGE_TEXT).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(_MERGE_SIDES + "SELECT CASE WHEN tk IS NULL THEN 'INSERT' WHEN k IS NULL AND st = 'P' OR k IS NOT NULL AND p < 50000 THEN 'DELETE' ELSE 'UPDATE' END AS action, count(*) AS n FROM j WHERE NOT coalesce(k IS NULL AND st = 'F', false) GROUP BY ALL")
def merge_orders_output(t):
    return _execute(t, _MERGE_TEXT, "output").groupBy(c("_action").alias("action")).agg(F.count(lit(1)).alias("n"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT DISTINCT n_nationkey, NULL FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def merge_insert_defaults(t):
    return _execute(t, "MERGE INTO region AS t USING nation AS s ON t.r_regionkey = s.n_nationkey WHEN NOT MATCHED THEN INSERT DEFAULT VALUES;")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 4")
def committed_versions(t):
    """Versions in a folder, seen together from one moment on."""
    from quarry.operators import dml
    from quarry.operators.store import Store
    from quarry.session import shared_folder

    store = Store(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")
    store.commit({"nation": t.nation.select("n_nationkey", "n_name"), "region": t.region})
    with store.transaction() as x:
        x.write("nation", dml.delete(x.read("nation"), c("n_nationkey") < 5))
        x.drop("region")
    return store.read("nation")


# Text for other engines


def _texts(t: Tables, tree: S.Node) -> DataFrame:
    return _rows(t, [(d, to_sql(tree, d)) for d in ("tsql", "postgres", "mysql", "sqlite")], "engine string, text string")


_UPDATE_TEXT = "UPDATE c SET x = n.y FROM t AS c INNER JOIN u AS n ON c.k = n.k WHERE n.y > 1"
_UPDATES = {
    "tsql": "UPDATE [c] SET [x] = [n].[y] FROM [t] AS [c] INNER JOIN [u] AS [n] ON ([c].[k] = [n].[k]) WHERE ([n].[y] > 1)",
    "postgres": 'UPDATE "t" AS "c" SET "x" = "n"."y" FROM "u" AS "n" WHERE (("c"."k" = "n"."k") AND ("n"."y" > 1))',
    "mysql": "UPDATE `t` AS `c` INNER JOIN `u` AS `n` ON (`c`.`k` = `n`.`k`) SET `c`.`x` = `n`.`y` WHERE (`n`.`y` > 1)",
    "sqlite": 'UPDATE "t" AS "c" SET "x" = "n"."y" FROM "u" AS "n" WHERE (("c"."k" = "n"."k") AND ("n"."y" > 1))',
}


@query("SELECT * FROM (VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in _UPDATES.items()) + ") AS v(engine, text)")
def change_texts(t):
    from quarry.tsql import parse

    return _texts(t, parse(_UPDATE_TEXT))


@query("SELECT * FROM (VALUES ('spark', '`it''s``x`', '''a\\''b\\\\c'''), ('tsql', '[it''s`x]', '''a''''b\\c'''), ('postgres', '\"it''s`x\"', '''a''''b\\c''')) AS v(engine, name, value)")
def escaping(t):
    from quarry.emit import Emitter

    return _rows(t, [(d, Emitter(d).ident("it's`x"), Emitter(d).sql(S.Literal("a'b\\c"))) for d in ("spark", "tsql", "postgres")], "engine string, name string, value string")


@query("SELECT 'SELECT \"o\".\"id\" FROM \"public\".\"orders\" AS \"o\"' AS text")
def schema_mapping(t):
    return _rows(t, [(to_sql(B.select(B.col("id", "o")).from_(B.table("orders", "o", "dbo")).node, "postgres", schemas={"dbo": "public"}),)], "text string")


# Trees


_TREE = "SELECT c.c_custkey FROM customer AS c WHERE c.c_acctbal > 100 AND c.c_nationkey IN (1, 2, 3)"


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 100 AND c_nationkey IN (1, 2, 3)")
def tree_stored(t):
    """A query stored as rows, JSON and XML, read back, and run."""
    from quarry.tsql import parse

    tree = parse(_TREE)
    for put, get in ((S.to_plain, S.from_plain), (S.to_json, S.from_json), (S.to_xml, S.from_xml)):
        again = get(put(tree))
        if again != tree:
            raise ValueError("a tree isn't the same when it is read back")
        tree = again
    return _session(t).run(tree)


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_nationkey IN (1, 2, 3)")
def tree_rewritten(t):
    from quarry.tsql import parse

    return _session(t).run(parse(_TREE).transform(lambda n: n.with_(value=1000) if n == S.Literal(100) else n))


@query("SELECT * FROM (VALUES ('Col', 3), ('Literal', 4), ('Table', 1)) AS v(kind, n)")
def tree_walked(t):
    from quarry.tsql import parse

    count: dict[str, int] = {}
    for x in parse(_TREE).walk():
        count[type(x).__name__] = count.get(type(x).__name__, 0) + 1
    return _rows(t, [(k, count[k]) for k in ("Col", "Literal", "Table")], "kind string, n int")


@query("SELECT * FROM (VALUES ('customer', 'c_acctbal', 'int'), ('customer', 'c_custkey', 'int'), ('customer', 'c_nationkey', 'int')) AS v(name, field, kind)")
def table_artifacts(t):
    from quarry.tsql import parse
    from quarry.tsql.artifacts import table_artifacts as artifacts

    return _rows(t, [(d.name, x.name, x.type) for d in artifacts(parse(_TREE)) for x in d.columns], "name string, field string, kind string")


@query("SELECT * FROM (VALUES ('there is no table nowhere'), ('customer has no column wrong'), ('x has no column b'), ('there is no schema other')) AS v(message)")
def binding_errors(t):
    from quarry.tsql import TsqlError

    s, out = _session(t), []
    for text in ("SELECT * FROM nowhere", "SELECT wrong FROM customer", "SELECT x.b FROM (SELECT c_name AS a FROM customer) AS x", "SELECT * FROM other.customer"):
        try:
            s.query(text)
        except TsqlError as e:
            out.append((str(e),))
    return _rows(t, out, "message string")


# Definitions and relations


@query("SELECT * FROM (VALUES ('b', 'TYPE'), ('c', 'missing'), ('d', 'extra')) AS v(field, difference)")
def definitions_compared(t):
    from quarry.operators.tables import ColumnDef, TableDef, compare_tables, includes

    a = TableDef("t", (ColumnDef("a", "int"), ColumnDef("b", "int"), ColumnDef("c", "int")))
    b = TableDef("t", (ColumnDef("a", "int"), ColumnDef("b", "string"), ColumnDef("d", "int")))
    if not includes(a, a.with_(columns=lambda cs: cs[:2])) or includes(a, b):
        raise ValueError("inclusion is wrong")
    found = compare_tables(a, b)
    rows = [*((n, "missing") for n in found.missing), *((n, "extra") for n in found.extra), *((n, d.name) for n, d in found.different.items())]
    return _rows(t, rows, "field string, difference string")


@query("SELECT * FROM (VALUES ('missing', 'gone'), ('extra', 'new'), ('same', 'yes')) AS v(what, which)")
def table_lists_compared(t):
    from quarry.operators.tables import ColumnDef, TableDef, compare

    key = (ColumnDef("id", "int", primary_key=True),)
    base = TableDef("kept", key)
    made = base.with_(columns=lambda cs: [*cs, ColumnDef("note", "string", True)])  # built at run time
    found = compare([made, TableDef("gone", key)], [made, TableDef("new", key)])
    same = "yes" if compare([made], [made]) is None and found.different == {} else "no"
    return _rows(t, [("missing", ",".join(found.missing)), ("extra", ",".join(found.extra)), ("same", same)], "what string, which string")


@query("SELECT * FROM (VALUES (0, 'part,region'), (1, 'nation'), (2, 'customer,supplier'), (3, 'orders'), (4, 'lineitem')) AS v(layer, names)")
def key_hierarchy(t):
    from quarry.operators.relations import driver_graph

    return _rows(t, [(i, ",".join(sorted(x))) for i, x in enumerate(driver_graph(t).hierarchy())], "layer int, names string")


@query("SELECT * FROM (VALUES ('up', 'customer,nation,region'), ('down', 'lineitem'), ('next', 'customer')) AS v(way, names)")
def graph_navigation(t):
    from quarry.operators.relations import driver_graph

    g = driver_graph(t)
    return _rows(t, [("up", ",".join(sorted(g.all_references("orders")))), ("down", ",".join(sorted(g.all_referenced_by("orders")))), ("next", ",".join(g.references("orders")))], "way string, names string")


# Models


@dataclasses.dataclass
class Place:
    id: int
    name: str


@query("SELECT r_regionkey AS k, upper(r_name) || '!' AS v FROM region")
def model_updates(t):
    """Rows as objects, changed, and put back by their keys."""
    from quarry.operators import script
    from quarry.operators.models import ModelMap

    m = ModelMap(Place, ["id"], {"id": "r_regionkey", "name": "r_name"})
    changed = [dataclasses.replace(x, name=x.name.upper() + "!") for x in m.objects(t.region)]
    return script.update_objects(t.region, m.rows(changed), m.key_columns).table.select(c("r_regionkey").alias("k"), c("r_name").alias("v"))


@query("SELECT n_name, r_name, count(*) OVER () AS total FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name LIMIT 5 OFFSET 5")
def model_page(t):
    from quarry.operators.models import model_select

    found = model_select(t.nation, "n").inner(t.region, "r", lambda n, r: n["n_regionkey"] == r["r_regionkey"]).find(5, 5, [c("n.n_name")])
    return _rows(t, [(x["n"]["n_name"], x["r"]["r_name"], found.total) for x in found.items], "n_name string, r_name string, total bigint")


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority")
def portable_node(t):
    q = B.select(B.col("o_orderpriority"), B.call("SUM", B.col("o_totalprice")).as_("total")).from_(B.table("orders")).group_by(B.col("o_orderpriority"))
    return _session(t).run(q.node).withColumn("total", money("total"))


# Functions that give tables, scripts of text, visitors, tokens


@query("SELECT n_name, g.i AS step FROM nation, generate_series(1, n_regionkey) AS g(i) WHERE n_regionkey > 0")
def table_function_with_schema(t):
    from pyspark.sql.functions import udtf

    @udtf(returnType="i: bigint")
    class Steps:
        def eval(self, n: int):
            for i in range(1, n + 1):
                yield (i,)

    s = _session(t)
    s.register_table_function("main.dbo.steps", Steps)
    return s.query("SELECT n.n_name, g.i AS step FROM nation AS n CROSS APPLY main.dbo.steps(n.n_regionkey) AS g(i)")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 0 AND n_nationkey < 20")
def script_of_text(t):
    """Statements one after the other; the last one's rows."""
    return _session(t).script("DELETE FROM nation WHERE n_regionkey = 0; -- a comment; with a semicolon\nMERGE INTO nation AS t USING region AS r ON t.n_nationkey = r.r_regionkey + 20 WHEN MATCHED THEN DELETE; SELECT n_nationkey, n_name FROM nation WHERE n_name <> ';'")[-1]


@query("SELECT n_nationkey FROM nation")
def sink_async(t):
    import asyncio

    from quarry.sources import sinks

    async def all_rows():
        return [r["n_nationkey"] async for r in sinks.stream_rows_async(t.nation)]

    return _rows(t, [(x,) for x in asyncio.run(all_rows())], "n_nationkey int")


@query("SELECT * FROM (VALUES ('customer', 'c_custkey'), ('customer', 'c_acctbal'), ('customer', 'c_nationkey')) AS v(source, field)")
def tree_visitor(t):
    from quarry.tsql import parse

    class Fields(S.Visitor):
        def __init__(self):
            self.of, self.found = {}, []

        def enter_table(self, x):
            self.of[x.alias or x.name] = x.name

        def leave_select(self, x):
            self.found += [(self.of[f.source], f.name) for f in x.walk() if isinstance(f, S.Col)]

    v = Fields()
    v.visit(parse(_TREE))
    return _rows(t, sorted(set(v.found)), "source string, field string")


@query("SELECT * FROM (VALUES (1, 'name', '[a b]'), (2, 'symbol', '>='), (3, 'string', '''it''''s''')) AS v(place, kind, text)")
def tokens(t):
    from quarry.tsql.parser import lex

    kinds = {"[": "name", ">": "symbol", "'": "string"}
    return _rows(t, [(i, kinds[x.text[0]], x.text) for i, x in enumerate(lex("SELECT [a b] /* >= */ >= 'it''s' -- end")[1:4], 1)], "place int, kind string, text string")
