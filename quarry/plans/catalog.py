"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import functions as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def values(self, rows: str, *names: str) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS v({', '.join(names)})")


def query(sql: str | None):
    """Register a function of the tables under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


c, lit = F.col, F.lit
revenue = lambda: c("l_extendedprice") * (1 - c("l_discount"))
money = lambda x: F.round(x, 2)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(t):
    keep = t.lineitem.where(c("l_shipdate") <= lit("1998-09-02").cast("timestamp_ntz"))
    return keep.groupBy("l_returnflag", "l_linestatus").agg(money(F.sum("l_quantity")).alias("sum_qty"), money(F.sum("l_extendedprice")).alias("sum_base"), money(F.sum(revenue())).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(lit(1)).alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY n_name")
def nation_revenue(t):
    o = t.orders.where(c("o_orderdate") >= lit("1994-01-01").cast("timestamp_ntz"))
    # The small dimension joins after the facts are reduced.
    by = t.customer.join(o, c("c_custkey") == c("o_custkey")).join(t.lineitem, c("l_orderkey") == c("o_orderkey")).groupBy("c_nationkey").agg(F.sum(revenue()).alias("r"))
    return by.join(t.nation, c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(money(F.sum("r")).alias("revenue"))


# Sources and projection


@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_project(t):
    return t.orders.select("o_orderkey", "o_totalprice")


@query("SELECT * FROM nation")
def all_columns(t):
    return t.nation.select("*")


@query("SELECT n_nationkey AS id, n_name AS label, n_regionkey * 10 AS tenfold FROM nation")
def column_alias(t):
    return t.nation.select(c("n_nationkey").alias("id"), c("n_name").alias("label"), (c("n_regionkey") * 10).alias("tenfold"))


@query("SELECT * FROM (VALUES (1, 'a', CAST(NULL AS DOUBLE)), (2, 'b', 2.5), (3, NULL, 3.5)) AS v(id, name, x)")
def inline_values(t):
    return t.values("(1, 'a', CAST(NULL AS DOUBLE)), (2, 'b', 2.5D), (3, NULL, 3.5D)", "id", "name", "x")


@query("SELECT n_name, v.word FROM nation JOIN (VALUES (0, 'zero'), (1, 'one')) AS v(k, word) ON n_regionkey = v.k")
def join_values(t):
    v = t.spark.createDataFrame([(0, "zero"), (1, "one")], "k int, word string")
    return t.nation.join(v, c("n_regionkey") == c("k")).select("n_name", "word")


@query("SELECT d.seg, d.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) d WHERE d.n > 10")
def derived_table(t):
    d = t.customer.groupBy("c_mktsegment").agg(F.count(lit(1)).alias("n")).toDF("seg", "n").alias("d")
    return d.where("d.n > 10").select("d.seg", "d.n")


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1) SELECT o_custkey, n FROM per WHERE n > 1")
def cte_chain(t):
    big = t.orders.where("o_totalprice > 200000")
    return big.groupBy("o_custkey").agg(F.count(lit(1)).alias("n")).where("n > 1")


@query("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")
def recursive_cte(t):
    return t.spark.sql("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")


@query("WITH RECURSIVE p(id, parent) AS (SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN NULL ELSE n_nationkey // 2 END FROM nation), up(id, parent, depth) AS (SELECT id, parent, 1 FROM p WHERE parent IS NOT NULL UNION ALL SELECT u.id, p.parent, u.depth + 1 FROM up u JOIN p ON p.id = u.parent WHERE p.parent IS NOT NULL) SELECT id, parent, depth FROM up")
def tree_closure(t):
    t.nation.createOrReplaceTempView("quarry_nation")
    return t.spark.sql("WITH RECURSIVE p(id, parent) AS (SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN NULL ELSE n_nationkey div 2 END FROM quarry_nation), up(id, parent, depth) AS (SELECT id, parent, 1 FROM p WHERE parent IS NOT NULL UNION ALL SELECT u.id, p.parent, u.depth + 1 FROM up u JOIN p ON p.id = u.parent WHERE p.parent IS NOT NULL) SELECT id, cast(parent AS int) AS parent, depth FROM up")


@query("SELECT 1 AS one, 'x' AS s")
def select_without_from(t):
    return t.spark.range(1).select(lit(1).alias("one"), lit("x").alias("s"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT DISTINCT p_size FROM part ORDER BY p_size LIMIT 7")
def top_distinct(t):
    return t.part.select("p_size").distinct().orderBy("p_size").limit(7)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 20")
def offset_only(t):
    from quarry.sources.sinks import after_frame

    return after_frame(t.orders.select("o_orderkey"), ["o_orderkey"], 20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 15")
def offset_fetch(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(15).limit(5)


@query("SELECT c_name, c_acctbal, total FROM (SELECT c_name, c_acctbal, c_custkey, count(*) OVER () AS total FROM customer WHERE c_acctbal > 0) ORDER BY c_custkey LIMIT 10 OFFSET 10")
def page_with_total(t):
    from quarry.sources.sinks import page_frame

    return page_frame(t.customer.where("c_acctbal > 0"), ["c_custkey"], 10, 10, "total").select("c_name", "c_acctbal", "total")


# Predicates


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND NOT (o_totalprice < 1000) AND o_custkey <> 7")
def where_bool(t):
    return t.orders.where(((c("o_orderstatus") == "F") | (c("o_orderstatus") == "O")) & ~(c("o_totalprice") < 1000) & (c("o_custkey") != 7)).select("o_orderkey")


for _name, _op in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):

    def _compare(t, op=_op):
        return t.part.where(f"p_size {op} 15").select("p_partkey", "p_size")

    _compare.__name__ = f"compare_{_name}"
    query(f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 15")(_compare)


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)")
def in_values(t):
    return t.part.where(c("p_size").isin(1, 5, 9)).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def in_subquery(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def not_in_subquery(t):
    from quarry.operators.predicates import not_in

    return not_in(t.customer.select("c_custkey"), c("c_custkey"), t.orders.where("o_totalprice > 150000").select("o_custkey"))


@query("SELECT a FROM (VALUES (1), (2), (NULL)) AS x(a) WHERE a NOT IN (SELECT b FROM (VALUES (2), (NULL)) AS y(b))")
def not_in_with_null(t):
    from quarry.operators.predicates import not_in

    return not_in(t.values("(1), (2), (NULL)", "a"), c("a"), t.values("(2), (NULL)", "b"))


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 40)")
def exists_corr(t):
    return t.customer.join(t.orders, (c("o_custkey") == c("c_custkey")) & (c("o_totalprice") > c("c_acctbal") * 40), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def not_exists(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%'")
def like(t):
    return t.part.where(c("p_name").like("%a%e%")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_type NOT LIKE 'S%'")
def not_like(t):
    return t.part.where(~c("p_type").like("S%")).select("p_partkey")


@query("SELECT i FROM (VALUES (0, 'Some simple text'), (1, 'a%b%c'), (2, 'aabcc')) AS v(i, s) WHERE s LIKE 'a!%b!%c' ESCAPE '!'")
def like_escape(t):
    return t.values("(0, 'Some simple text'), (1, 'a%b%c'), (2, 'aabcc')", "i", "s").where("s LIKE 'a!%b!%c' ESCAPE '!'").select("i")


@query("SELECT i FROM (VALUES (0, 'a%b'), (1, 'axb'), (2, 'b1'), (3, 'd1')) AS v(i, s) WHERE s LIKE 'a\\%b' ESCAPE '\\' OR regexp_full_match(s, '[a-c][0-9]')")
def like_classes(t):
    v = t.values("(0, 'a%b'), (1, 'axb'), (2, 'b1'), (3, 'd1')", "i", "s")
    return v.where(Q.like_classes(c("s"), "a[%]b") | Q.like_classes(c("s"), "[a-c][0-9]")).select("i")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def between(t):
    return t.orders.where(c("o_totalprice").between(1000, 50000)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 300000")
def not_between(t):
    return t.orders.where(~c("o_totalprice").between(1000, 300000)).select("o_orderkey")


@query("SELECT c_custkey, o_orderkey IS NULL AS none FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000 WHERE o_orderkey IS NULL OR c_acctbal IS NOT NULL")
def is_null(t):
    j = t.customer.join(t.orders.where("o_totalprice > 350000"), c("o_custkey") == c("c_custkey"), "left")
    return j.where(c("o_orderkey").isNull() | c("c_acctbal").isNotNull()).select("c_custkey", c("o_orderkey").isNull().alias("none"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (1, 2, 3, 5, 8, 13, 21, 34)")
def named_parameters(t):
    from quarry.operators.params import sql_with_params

    return sql_with_params(t.spark, "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = @seg AND c_custkey IN (@ids)", {"seg": "BUILDING", "ids": [1, 2, 3, 5, 8, 13, 21, 34]}, customer=t.customer)


# Joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_left(t):
    return t.customer.join(t.orders, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(t):
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey"), "right").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
def join_full(t):
    return t.supplier.join(t.customer, (c("s_suppkey") == c("c_custkey")) & (c("s_nationkey") == c("c_nationkey")), "full").select("s_suppkey", "c_custkey")


@query("SELECT a.r_name AS left_name, b.r_name AS right_name FROM region a CROSS JOIN region b")
def join_cross(t):
    a, b = t.region.alias("a"), t.region.alias("b")  # five rows each
    return a.crossJoin(b).select(c("a.r_name").alias("left_name"), c("b.r_name").alias("right_name"))


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_nationkey").alias("x"), c("b.n_nationkey").alias("y"))


@query("SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey")
def self_join(t):
    from quarry.operators.pairs import pairs_within

    return pairs_within(t.customer, "c_custkey", ["c_nationkey", "c_mktsegment"], "x", "y")


@query("SELECT n_name, s.s_suppkey FROM nation n CROSS JOIN LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n.n_nationkey) s")
def cross_apply(t):
    inner = t.supplier.where(c("s_nationkey") == c("n_nationkey").outer()).select("s_suppkey")
    return t.nation.lateralJoin(inner).select("n_name", "s_suppkey")


@query("SELECT n_name, s.s_suppkey FROM nation n LEFT JOIN LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n.n_nationkey) s ON true")
def outer_apply(t):
    inner = t.supplier.where(c("s_nationkey") == c("n_nationkey").outer()).select("s_suppkey")
    return t.nation.lateralJoin(inner, how="left").select("n_name", "s_suppkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_per_group(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
def semi_join(t):
    return t.supplier.join(t.lineitem.where("l_quantity >= 50"), c("l_suppkey") == c("s_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def anti_join(t):
    return t.part.join(t.lineitem.where("l_quantity > 48"), c("l_partkey") == c("p_partkey"), "left_anti").select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def fk_path_join(t):
    from quarry.operators.relations import driver_graph

    return driver_graph(t).join(["lineitem", "nation"], t.__getattr__).select("l_orderkey", "l_linenumber", "n_name")


@query("SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def fk_path_checkpoint(t):
    from quarry.operators.relations import driver_graph

    return driver_graph(t).join(["lineitem", "nation"], t.__getattr__, via=["customer"]).select("l_orderkey", "l_linenumber", "n_name")


@query("SELECT c_name, p_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def fk_multi_join(t):
    from quarry.operators.relations import driver_graph
    from quarry.session import in_tasks

    return in_tasks(driver_graph(t).join(["customer", "part"], t.__getattr__), "c_name", "p_name").groupBy("c_name", "p_name").agg(F.count(lit(1)).alias("n"))


@query("SELECT c_custkey AS id, o_orderkey AS order_id, o_orderkey IS NULL AS none FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def model_join(t):
    from quarry.operators.models import model_select

    j = model_select(t.customer, "customer").left(t.orders.where("o_orderstatus = 'P'"), "orders", lambda a, b: a.c_custkey == b.o_custkey).frame()
    return j.select(c("customer.c_custkey").alias("id"), c("orders.o_orderkey").alias("order_id"), c("orders").isNull().alias("none"))


# Aggregation


@query("SELECT count(*) AS n, count(o_orderkey) AS k, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders")
def agg_global(t):
    return t.orders.agg(F.count(lit(1)).alias("n"), F.count("o_orderkey").alias("k"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), money(F.sum("o_totalprice")).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment")
def agg_group(t):
    return t.customer.groupBy("c_mktsegment").agg(F.count(lit(1)).alias("n"), money(F.sum("c_acctbal")).alias("balance"))


@query("SELECT year(o_orderdate) % 2 AS parity, count(*) AS n FROM orders GROUP BY year(o_orderdate) % 2")
def agg_group_expr(t):
    return t.orders.groupBy((F.year("o_orderdate").cast("long") % 2).alias("parity")).agg(F.count(lit(1)).alias("n"))


@query("SELECT count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines, avg(DISTINCT l_linenumber) AS mean, min(DISTINCT l_quantity) AS lo, max(DISTINCT l_quantity) AS hi FROM lineitem")
def agg_distinct(t):
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.sum_distinct("l_linenumber").alias("lines"), F.expr("avg(DISTINCT l_linenumber)").alias("mean"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("SELECT o_orderstatus, stddev_samp(o_custkey) > 0 AS spread, bool_and(o_totalprice > 0) AS positive FROM orders GROUP BY o_orderstatus")
def agg_by_name(t):
    return t.orders.groupBy("o_orderstatus").agg((F.call_function("stddev_samp", c("o_custkey")) > 0).alias("spread"), F.call_function("bool_and", c("o_totalprice") > 0).alias("positive"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def having_as_derived(t):
    return t.orders.groupBy("o_custkey").agg(F.count(lit(1)).alias("n")).where("n > 15")


@query("SELECT round(sum(l_extendedprice) / count(*), 4) AS ratio FROM lineitem")
def aggregate_as_value(t):
    return t.lineitem.agg(F.round(F.sum("l_extendedprice") / F.count(lit(1)), 4).alias("ratio"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube(t):
    return t.customer.cube("c_mktsegment", "c_nationkey").agg(F.count(lit(1)).alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def rollup(t):
    return t.customer.rollup("c_mktsegment", "c_nationkey").agg(F.count(lit(1)).alias("n"))


# Windows: over each customer's orders, which are few


_W = lambda: Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_PEERS, _PEERS_SQL = lambda: Window.partitionBy("o_custkey").orderBy("o_orderpriority"), "OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"
_WHOLE = Window.unboundedPreceding, Window.unboundedFollowing
for _name, _value, _sql in (
    ("row_number", lambda: F.row_number().over(_W()), f"row_number() {_OVER})"),
    ("rank", lambda: F.rank().over(_PEERS()), f"rank() {_PEERS_SQL}"),
    ("dense_rank", lambda: F.dense_rank().over(_PEERS()), f"dense_rank() {_PEERS_SQL}"),
    ("ntile", lambda: F.ntile(4).over(_W()), f"ntile(4) {_OVER})"),
    ("cume_dist", lambda: F.cume_dist().over(_PEERS()), f"cume_dist() {_PEERS_SQL}"),
    ("percent_rank", lambda: F.percent_rank().over(_PEERS()), f"percent_rank() {_PEERS_SQL}"),
    ("first_value", lambda: F.first_value("o_totalprice").over(_W()), f"first_value(o_totalprice) {_OVER})"),
    ("last_value", lambda: F.last_value("o_totalprice").over(_W().rowsBetween(*_WHOLE)), f"last_value(o_totalprice) {_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    ("last_value_default", lambda: F.last_value("o_totalprice").over(_W()), f"last_value(o_totalprice) {_OVER})"),
    ("lag", lambda: F.lag("o_totalprice", 2, 0.0).over(_W()), f"lag(o_totalprice, 2, 0) {_OVER})"),
    ("lead", lambda: F.lead("o_totalprice").over(_W()), f"lead(o_totalprice) {_OVER})"),
    ("sum", lambda: money(F.sum("o_totalprice").over(Window.partitionBy("o_custkey"))), "round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2)"),
    ("running", lambda: money(F.sum("o_totalprice").over(_W().rowsBetween(Window.unboundedPreceding, 0))), f"round(sum(o_totalprice) {_OVER} ROWS UNBOUNDED PRECEDING), 2)"),
    ("frame", lambda: F.round(F.avg("o_totalprice").over(_W().rowsBetween(-1, 2)), 4), f"round(avg(o_totalprice) {_OVER} ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), 4)"),
    ("count", lambda: F.count(lit(1)).over(Window.partitionBy("o_custkey", "o_orderstatus")), "count(*) OVER (PARTITION BY o_custkey, o_orderstatus)"),
    ("distinct", lambda: Q.distinct_count_over(c("o_orderstatus"), Window.partitionBy("o_custkey")), "count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey)"),
    ("by_name", lambda: F.call_function("row_number").over(_W()), f"row_number() {_OVER})"),
    ("share", lambda: F.round(c("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 6), "round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6)"),
):

    def _window(t, value=_value):
        return t.orders.select("o_orderkey", value().alias("v"))

    _window.__name__ = f"window_{_name}"
    query(f"SELECT o_orderkey, {_sql} AS v FROM orders")(_window)


# Sort and set operators


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC NULLS FIRST, c_custkey DESC LIMIT 25")
def order_by(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.asc_nulls_first("c_acctbal"), F.desc("c_custkey")).limit(25)


_A, _B = "SELECT n_regionkey AS k FROM nation", "SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 3"


def _sides(t):
    return t.nation.select(c("n_regionkey").alias("k")), t.customer.where("c_nationkey < 3").select(c("c_nationkey").alias("k"))


for _name, _op, _do in (
    ("union_all", "UNION ALL", lambda a, b: a.union(b)),
    ("union", "UNION", lambda a, b: a.union(b).distinct()),
    ("except_", "EXCEPT", lambda a, b: a.subtract(b)),
    ("intersect", "INTERSECT", lambda a, b: a.intersect(b)),
    ("except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b)),
    ("intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b)),
):

    def _set(t, do=_do):
        return do(*_sides(t))

    _set.__name__ = f"set_{_name.rstrip('_')}"
    query(f"{_A} {_op} {_B}")(_set)


@query("(SELECT 1 AS k UNION SELECT 2 AS k) EXCEPT SELECT 2 AS k")
def set_chain(t):
    one, two = t.spark.range(1).select(lit(1).alias("k")), t.spark.range(1).select(lit(2).alias("k"))
    return one.union(two).distinct().subtract(two)


@query(f"SELECT k FROM ({_A} UNION {_B}) ORDER BY k DESC LIMIT 3 OFFSET 1")
def set_ordered(t):
    a, b = _sides(t)
    return a.union(b).distinct().orderBy(F.desc("k")).offset(1).limit(3)


# Sub-queries


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def scalar_subquery(t):
    o = t.orders
    return o.where(c("o_totalprice") > o.select(F.avg("o_totalprice") * 1.5).scalar()).select("o_orderkey")


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer")
def scalar_subquery_corr(t):
    most = t.orders.where(c("o_custkey") == c("c_custkey").outer()).select(F.max("o_totalprice")).scalar()
    return t.customer.select("c_custkey", most.alias("most"))


# Scalar expressions


@query("SELECT p_partkey, p_size + 1 AS a, p_size - 7 AS b, p_size * 3 AS m, p_size // 4 AS d, p_size % 4 AS r, -p_size AS neg, p_retailprice / 7 AS f FROM part")
def arithmetic(t):
    s = c("p_size")
    return t.part.select("p_partkey", (s + 1).alias("a"), (s - 7).alias("b"), (s * 3).alias("m"), Q.int_div(s, lit(4)).cast("int").alias("d"), (s % 4).alias("r"), (-s).alias("neg"), (c("p_retailprice") / 7).alias("f"))


@query("SELECT p_partkey, p_size & 6 AS a, p_size | 9 AS o, xor(p_size, 5) AS x, ~p_size AS n FROM part")
def bitwise(t):
    s = c("p_size")
    return t.part.select("p_partkey", s.bitwiseAND(6).alias("a"), s.bitwiseOR(9).alias("o"), s.bitwiseXOR(5).alias("x"), F.bitwise_not(s).alias("n"))


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS s FROM customer")
def string_concat(t):
    return t.customer.select("c_custkey", F.concat("c_name", lit("/"), "c_mktsegment").alias("s"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS one FROM part")
def case_when(t):
    s = c("p_size")
    return t.part.select("p_partkey", F.when(s < 10, "small").when(s < 30, "medium").otherwise("large").alias("size"), F.expr("if(p_size = 1, 1, 0)").alias("one"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS DOUBLE) AS d, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS SMALLINT) AS h FROM part")
def casts(t):
    return t.part.select("p_partkey", c("p_size").cast("string").alias("s"), c("p_size").cast("double").alias("d"), c("p_retailprice").cast("long").alias("i"), c("p_size").cast("short").alias("h"))


@query("SELECT i, TRY_CAST(s AS INTEGER) AS v FROM (VALUES (1, '12'), (2, 'x'), (3, NULL)) AS t(i, s)")
def try_convert(t):
    return t.values("(1, '12'), (2, 'x'), (3, NULL)", "i", "s").select("i", c("s").try_cast("int").alias("v"))


@query("SELECT i, coalesce(a, b) AS x, coalesce(a, b, 0) AS y, nullif(a, 1) AS z FROM (VALUES (1, NULL, 5), (2, 1, NULL), (3, NULL, NULL), (4, 7, 1)) AS t(i, a, b)")
def null_functions(t):
    v = t.values("(1, NULL, 5), (2, 1, NULL), (3, NULL, NULL), (4, 7, 1)", "i", "a", "b")
    return v.select("i", F.coalesce("a", "b").alias("x"), F.coalesce("a", "b", lit(0)).alias("y"), F.nullif(c("a"), lit(1)).alias("z"))


@query("SELECT c_custkey, lower(c_name) AS lo, upper(c_name) AS up, trim('  a ') AS tr, ltrim('  a ') AS lt, rtrim('  a ') AS rt, replace(c_name, '0', 'o') AS re, substring(c_name, 3, 4) AS su FROM customer")
def string_functions(t):
    n, blank = c("c_name"), lit("  a ")
    return t.customer.select("c_custkey", Q.portable("LOWER", n).alias("lo"), Q.portable("UPPER", n).alias("up"), Q.portable("TRIM", blank).alias("tr"), Q.portable("LTRIM", blank).alias("lt"), Q.portable("RTRIM", blank).alias("rt"), F.replace(n, lit("0"), lit("o")).alias("re"), F.substring(n, 3, 4).alias("su"))


@query("SELECT c_custkey, CAST(length(c_name) AS INTEGER) AS n, CAST(strlen('Ж') AS INTEGER) AS bytes, CAST(strpos(c_name, '#') AS INTEGER) AS at, left(c_name, 3) AS l, right(c_name, 2) AS r, repeat('ab', 2) AS rep, left(c_name, 0) AS l0, concat(NULL, c_mktsegment) AS cc FROM customer")
def string_measures(t):
    n = c("c_name")
    return t.customer.select("c_custkey", Q.text_len(n).alias("n"), Q.data_length(lit("Ж")).alias("bytes"), Q.index_of("#", n).alias("at"), Q.left(n, 3).alias("l"), Q.right(n, 2).alias("r"), F.repeat(lit("ab"), 2).alias("rep"), Q.left(n, 0).alias("l0"), Q.concat_text(lit(None), c("c_mktsegment")).alias("cc"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS ce FROM customer")
def math_functions(t):
    b = c("c_acctbal")
    return t.customer.select("c_custkey", F.abs(b).alias("a"), F.round(b, 1).alias("r"), F.floor(b).alias("f"), F.ceil(b).alias("ce"))


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s FROM events")
def date_parts(t):
    names = {"y": F.year, "mo": F.month, "d": F.day, "h": F.hour, "mi": F.minute, "s": F.second}
    return t.events.select("event_id", *[f("ts").alias(n) for n, f in names.items()])


@query("SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate + INTERVAL 1 YEAR AS y, o_orderdate - INTERVAL 10 DAY AS d, o_orderdate + INTERVAL 2 WEEK AS w, o_orderdate + INTERVAL 90 MINUTE AS mi, TIMESTAMP '2020-01-31' + INTERVAL 1 MONTH AS clamp FROM orders")
def date_add(t):
    o = c("o_orderdate")
    return t.orders.select("o_orderkey", Q.date_add("mm", 1, o).alias("m"), Q.date_add("yyyy", 1, o).alias("y"), Q.date_add("d", -10, o).alias("d"), Q.date_add("wk", 2, o).alias("w"), Q.date_add("mi", 90, o).alias("mi"), Q.date_add("month", 1, lit("2020-01-31").cast("timestamp_ntz")).alias("clamp"))


@query("SELECT event_id, " + ", ".join(f"date_diff('{p}', TIMESTAMP '2023-11-06 01:33:45', ts) AS {p}s" for p in ("year", "month", "day", "hour", "minute", "second", "millisecond")) + " FROM events")
def date_diff(t):
    start = lit("2023-11-06 01:33:45").cast("timestamp_ntz")
    return t.events.select("event_id", *[Q.date_diff(p, start, c("ts")).alias(f"{p}s") for p in ("year", "month", "day", "hour", "minute", "second", "millisecond")])


@query("SELECT k, CAST(unnest(x) AS INTEGER) AS v FROM (VALUES (1, [10, 12, 14, 15]), (2, [20, 22, 24, 25])) AS t(k, x)")
def json_array(t):
    data = t.values("""(1, '{"array":[10,12,14,15]}'), (2, '{"array":[20,22,24,25]}')""", "k", "j")
    return data.select("k", F.explode(F.from_json(F.get_json_object("j", "$.array"), "array<int>")).alias("v"))


# Data modification: each query returns the table as it is afterwards, or the rows affected


def _dml():
    from quarry.operators import dml

    return dml


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT * FROM (VALUES (100, 'ATLANTIS', 0), (101, 'MU', NULL)) AS v(a, b, c)")
def insert_values(t):
    return _dml().insert(t.nation, t.values("(100, 'ATLANTIS', 0), (101, 'MU', NULL)", "n_nationkey", "n_name", "n_regionkey")).table


@query("SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def insert_select(t):
    return _dml().insert(t.region, t.nation.where("n_regionkey = 1").select((c("n_nationkey") + 100).alias("r_regionkey"), c("n_name").alias("r_name"))).table


@query("SELECT * FROM region UNION ALL SELECT * FROM (VALUES (77, 'NEW')) AS v(a, b)")
def insert_if_absent(t):
    new = t.values("(1, 'AGAIN'), (77, 'NEW')", "r_regionkey", "r_name")
    return _dml().insert(t.region, new, unless_exists=["r_regionkey"]).table


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_where(t):
    return _dml().update(t.customer, {"c_acctbal": c("c_acctbal") + 100}, c("c_mktsegment") == "BUILDING").table.select("c_custkey", "c_acctbal")


@query("SELECT n_nationkey, CASE WHEN r_regionkey <= 2 THEN r_name ELSE n_name END AS n_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def update_from(t):
    return _dml().update(t.nation, {"n_name": c("source.r_name")}, source=t.region.where("r_regionkey <= 2"), on=c("target.n_regionkey") == c("source.r_regionkey")).table.select("n_nationkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 100000, false)")
def delete_where(t):
    return _dml().delete(t.orders, c("o_totalprice") > 100000).table.select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def delete_output(t):
    return _dml().delete(t.customer, source=t.orders.where("o_totalprice > 300000"), on=c("target.c_custkey") == c("source.o_custkey")).deleted.select("c_custkey", "c_name")


_MERGED = """
WITH target AS (SELECT * FROM (VALUES (1, 10, 0), (2, 11, 0), (4, 40, 0), (5, 50, 1)) AS v(id, value, version)),
source AS (SELECT * FROM (VALUES (1, 100), (2, -1), (3, 12)) AS v(id, value)),
j AS (SELECT t.id AS tid, t.value AS tv, t.version AS ver, s.id AS sid, s.value AS sv FROM target t FULL JOIN source s ON t.id = s.id)
"""


def _merge(t):
    target = t.values("(1, 10, 0), (2, 11, 0), (4, 40, 0), (5, 50, 1)", "id", "value", "version")
    source = t.values("(1, 100), (2, -1), (3, 12)", "id", "value")
    s, g = (lambda x: c(f"source.{x}")), (lambda x: c(f"target.{x}"))
    return (
        _dml()
        .merge(target, source, g("id") == s("id"))
        .when_matched_delete(s("value") < 0)
        .when_matched_update({"value": s("value"), "version": g("version") + 1})
        .when_not_matched_insert({"id": s("id"), "value": s("value"), "version": lit(0)})
        .when_not_matched_by_source_delete(g("version") > 0)
        .when_not_matched_by_source_update({"value": g("value") * 2})
        .run()
    )


@query(_MERGED + "SELECT coalesce(tid, sid) AS id, CASE WHEN tid IS NULL OR sid IS NOT NULL THEN sv ELSE tv * 2 END AS value, CASE WHEN tid IS NULL THEN 0 WHEN sid IS NOT NULL THEN ver + 1 ELSE ver END AS version FROM j WHERE NOT (tid IS NOT NULL AND sid IS NOT NULL AND sv < 0) AND NOT (sid IS NULL AND ver > 0)")
def merge_all_clauses(t):
    return _merge(t).table


@query(_MERGED + "SELECT CASE WHEN tid IS NULL THEN 'INSERT' WHEN sid IS NOT NULL AND sv < 0 OR sid IS NULL AND ver > 0 THEN 'DELETE' ELSE 'UPDATE' END AS action, tid AS old_id, CASE WHEN sid IS NOT NULL AND tid IS NOT NULL AND sv < 0 OR sid IS NULL AND ver > 0 THEN NULL ELSE coalesce(tid, sid) END AS new_id FROM j")
def merge_output(t):
    return _merge(t).output.select(c("_action").alias("action"), c("deleted.id").alias("old_id"), c("inserted.id").alias("new_id"))


# Scripts and changes from objects


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def temp_table_from_query(t):
    from quarry.operators import script

    kept, _ = script.temp_table(t.nation.where("n_regionkey = 2"), "#quarry_asia", ["n_nationkey"])
    return t.spark.table("quarry_asia").select("n_nationkey", "n_name")


@query("SELECT n_name, word FROM nation JOIN (VALUES (0, 'zero'), (3, 'three')) AS v(k, word) ON k = n_regionkey")
def temp_table_from_values(t):
    from quarry.operators import script

    words, _ = script.temp_values(t.spark, [(0, "zero"), (3, "three")], "k int, word string", "#quarry_words", ["k"])
    return t.nation.join(words, c("k") == c("n_regionkey")).select("n_name", "word")


@query("SELECT r_name AS found FROM region WHERE r_regionkey = 1")
def if_exists(t):
    from quarry.operators import script

    pick = lambda k: lambda: t.region.where(c("r_regionkey") == k).select(c("r_name").alias("found"))
    return script.when(t.nation.where("n_nationkey = 0"), lambda: script.when(t.nation.where("n_nationkey = -1"), pick(0), pick(1)), pick(2))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (50, 'LEMURIA'), (51, 'HYPERBOREA')) AS v(a, b)")
def insert_objects(t):
    from quarry.operators import script

    return script.insert_objects(t.region, [{"r_regionkey": 50}, {"r_regionkey": 51}], r_name=lambda x: "LEMURIA" if x["r_regionkey"] == 50 else "HYPERBOREA").table


@query("SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE r_name END AS r_name FROM region")
def update_objects(t):
    from quarry.operators import script

    return script.update_objects(t.region, [{"r_regionkey": 1, "r_name": "one"}, {"r_regionkey": 2, "r_name": "two"}], ["r_regionkey"]).table


@query("SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'one' ELSE r_name END AS r_name FROM region WHERE r_regionkey IN (1, 0) UNION ALL SELECT 9, 'new'")
def merge_objects(t):
    from quarry.operators import script

    return script.merge_objects(t.region, [{"r_regionkey": 1, "r_name": "one"}, {"r_regionkey": 9, "r_name": "new"}], ["r_regionkey"], delete_others=c("target.r_regionkey") > 0).table


@query("SELECT n_nationkey, i AS v FROM nation, generate_series(1, n_regionkey) AS g(i)")
def table_function(t):
    t.nation.createOrReplaceTempView("quarry_nation_tf")
    return t.spark.sql("SELECT n_nationkey, v FROM quarry_nation_tf CROSS JOIN LATERAL explode(CASE WHEN n_regionkey > 0 THEN sequence(1, n_regionkey) ELSE array() END) AS g(v)").select("n_nationkey", c("v").cast("long").alias("v"))


@query("SELECT column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' ELSE 'string' END AS kind FROM information_schema.columns WHERE table_name = 'customer'")
def result_shape(t):
    from quarry.sources.readers import shape

    return t.spark.createDataFrame([(n, k) for n, k, _ in shape(t.customer)], "name string, kind string")


@query("SELECT event_id, ts + INTERVAL 2 YEAR AS y, ts + INTERVAL 3 HOUR AS h, date_diff('day', TIMESTAMP '2023-11-06', ts) AS d, CAST(1.5 AS DECIMAL(10,2)) AS x FROM events")
def date_sugar(t):
    return t.events.select("event_id", Q.add_years(c("ts"), 2).alias("y"), Q.add_hours(c("ts"), 3).alias("h"), Q.diff_days(lit("2023-11-06").cast("timestamp_ntz"), c("ts")).alias("d"), Q.typed("1.5", "decimal(10,2)").alias("x"))


# The T-SQL front-end: the same relations, written as text


def _tsql(name: str, text: str, sql: str):
    def run(t):
        from quarry.tsql import Session

        session = Session(t.spark)
        for table in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events"):
            session.register(table, t.__getattr__(table))
        return session.query(text, {"low": 5, "names": ["FRANCE", "GERMANY", "CHINA"]} if "@" in text else None)

    run.__name__ = f"tsql_{name}"
    query(sql)(run)


_tsql("select", "SELECT TOP 5 [c].[c_custkey] AS id, c.c_name nm FROM dbo.customer AS c WHERE c.c_acctbal >= 0 AND c.c_nationkey IN (1, 2, 3) ORDER BY c.c_custkey DESC", "SELECT c_custkey AS id, c_name AS nm FROM customer WHERE c_acctbal >= 0 AND c_nationkey IN (1, 2, 3) ORDER BY c_custkey DESC LIMIT 5")
_tsql("join_group", "SELECT r.r_name, COUNT(*) AS n, SUM(c.c_acctbal) / COUNT(1) * 0 AS z FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT OUTER JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name", "SELECT r_name, count(*) AS n, sum(c_acctbal) / count(*) * 0 AS z FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
_tsql("integer_division", "SELECT p_partkey, p_size / 4 AS q, LEN(p_name + '  ') AS n, ISNULL(p_brand, N'none') AS b, CHARINDEX('a', p_name) AS at FROM part", "SELECT p_partkey, p_size // 4 AS q, CAST(length(p_name) AS INTEGER) AS n, coalesce(p_brand, 'none') AS b, CAST(strpos(p_name, 'a') AS INTEGER) AS at FROM part")
_tsql("parameters", "SELECT n_nationkey FROM nation WHERE n_nationkey > @low AND NOT n_name IN (@names)", "SELECT n_nationkey FROM nation WHERE n_nationkey > 5 AND n_name NOT IN ('FRANCE', 'GERMANY', 'CHINA')")
_tsql("apply", "SELECT n.n_name, s.s_suppkey FROM nation n OUTER APPLY (SELECT TOP 1 x.s_suppkey FROM supplier x WHERE x.s_nationkey = n.n_nationkey ORDER BY x.s_suppkey) s", "SELECT n_name, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS s_suppkey FROM nation")
_tsql("window_frame", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS k FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS k FROM orders")
_tsql("cte_set", "WITH a AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1), b (k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey < 9) SELECT k FROM a UNION ALL SELECT k FROM b ORDER BY k OFFSET 2 ROWS FETCH NEXT 6 ROWS ONLY", "SELECT k FROM (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey < 9) ORDER BY k LIMIT 6 OFFSET 2")
_tsql("dates", "SELECT event_id, DATEDIFF(hh, '2023-11-06 01:33:45', ts) AS h, DATEDIFF(month, '2023-11-06', ts) AS m, DATEADD(day, 3, ts) AS later, YEAR(ts) AS y FROM events", "SELECT event_id, date_diff('hour', TIMESTAMP '2023-11-06 01:33:45', ts) AS h, date_diff('month', TIMESTAMP '2023-11-06', ts) AS m, ts + INTERVAL 3 DAY AS later, CAST(year(ts) AS INTEGER) AS y FROM events")
_tsql("case_like", "SELECT p_partkey, CASE WHEN p_type LIKE '%B[A-R]%' THEN 'b' ELSE IIF(p_size > 20, 'big', 'small') END AS kind FROM part WHERE p_name NOT LIKE '%z%' AND p_size BETWEEN 1 AND 40", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'B[A-R]') THEN 'b' WHEN p_size > 20 THEN 'big' ELSE 'small' END AS kind FROM part WHERE p_name NOT LIKE '%z%' AND p_size BETWEEN 1 AND 40")
_tsql("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")


# Streams, run to their end


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows(t):
    from quarry.streaming import hourly_totals

    return hourly_totals(t.spark, t.folder)
