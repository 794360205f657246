"""The T-SQL front-end: what it takes, what it refuses, and changes made through it."""

from __future__ import annotations

import pytest

from quarry import spec as S
from quarry.emit import to_sql
from quarry.operators.tables import ColumnDef, TableDef
from quarry.tsql import Session, TsqlError, bind, parse


@pytest.fixture
def session(spark):
    s = Session(spark)
    s.register("people", spark.createDataFrame([(1, "Ann", 30, None), (2, "Bob", 41, 1), (3, "Cy", None, 1)], "id int, name string, age int, boss int"), TableDef("people", (ColumnDef("id", "int", primary_key=True), ColumnDef("name", "string", default="none"), ColumnDef("age", "int", True), ColumnDef("boss", "int", True))))
    s.register("pets", spark.createDataFrame([(10, 1, "cat"), (11, 3, "dog")], "id int, owner int, kind string"))
    return s


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT p.name FROM people p WHERE p.age / 4 = 7", [("Ann",)]),
        ("SELECT COUNT(*) AS n, COUNT(age) AS k, MAX(age) AS m FROM people", [(3, 2, 41)]),
        ("SELECT a.name, b.name AS boss FROM people a LEFT JOIN people b ON a.boss = b.id", [("Ann", None), ("Bob", "Ann"), ("Cy", "Ann")]),
        ("SELECT name FROM people WHERE id NOT IN (SELECT owner FROM pets)", [("Bob",)]),
        ("SELECT name FROM people p WHERE NOT EXISTS (SELECT 1 FROM pets q WHERE q.owner = p.id)", [("Bob",)]),
        ("SELECT name, (SELECT COUNT(*) FROM pets q WHERE q.owner = p.id) AS n FROM people p", [("Ann", 1), ("Bob", 0), ("Cy", 1)]),
        ("SELECT v.x * 2 AS y FROM (VALUES (1), (2)) AS v(x)", [(2,), (4,)]),
        ("SELECT 'a' + name AS s FROM people WHERE name LIKE '[A-B]%' AND name <> 'Bob'", [("aAnn",)]),
        ("SELECT name FROM people WHERE name LIKE 'A!_%' ESCAPE '!'", []),
        ("SELECT CONCAT(name, NULL, '!') AS s FROM people WHERE id = 1", [("Ann!",)]),
        ("SELECT ISNULL(age, -1) AS a FROM people WHERE boss IS NOT NULL", [(-1,), (41,)]),
        ("SELECT TRY_CAST('x' AS int) AS a, CAST('7' AS bigint) AS b", [(None, 7)]),
        ("SELECT DISTINCT TOP (1) boss FROM people ORDER BY boss DESC", [(1,)]),
        ("SELECT id FROM people EXCEPT SELECT owner FROM pets", [(2,)]),
        ("SELECT id FROM people INTERSECT SELECT owner FROM pets UNION ALL SELECT 9", [(1,), (3,), (9,)]),
        ("WITH x AS (SELECT id FROM people), y AS (SELECT id FROM x WHERE id > 1) SELECT MIN(id) AS m FROM y", [(2,)]),
        ("WITH r (n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT SUM(n) AS s FROM r", [(10,)]),
        ("SELECT p.name, q.kind FROM people p CROSS APPLY (SELECT x.kind FROM pets x WHERE x.owner = p.id) q", [("Ann", "cat"), ("Cy", "dog")]),
        ("SELECT name, ROW_NUMBER() OVER (ORDER BY age DESC) AS r FROM people", [("Ann", 2), ("Bob", 1), ("Cy", 3)]),
        ("SELECT CASE boss WHEN 1 THEN 'low' ELSE 'top' END AS k, COUNT(*) AS n FROM people GROUP BY CASE boss WHEN 1 THEN 'low' ELSE 'top' END", [("low", 2), ("top", 1)]),
        ("SELECT [name] AS [the name] FROM [dbo].[people] /* a comment */ WHERE id = 1 -- end", [("Ann",)]),
        ("SELECT DATEDIFF(year, '2020-12-31', '2021-01-01') AS y, DATEADD(month, 1, '2020-01-31') AS d", None),
    ],
)
def test_selects(session, text, want):
    got = rows(session.query(text))
    if want is None:
        assert got[0][0] == 1 and str(got[0][1]) == "2020-02-29 00:00:00"
    else:
        assert got == sorted(want, key=repr)


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("SELECT * INTO x FROM people", "INTO"), ("SELECT name FROM people GROUP BY name HAVING COUNT(*) > 1", "HAVING"), ("SELECT TOP 5 PERCENT * FROM people", "PERCENT"),
        ("SELECT name, COUNT(*) FROM people", "neither grouped"), ("SELECT * FROM people, pets", "CROSS JOIN"), ("SELECT * FROM people p JOIN pets p ON 1 = 1", "two sources"),
        ("SELECT * FROM people FOR JSON AUTO", "FOR"), ("SELECT * FROM people OPTION (RECOMPILE)", "OPTION"), ("DROP TABLE people", "DROP"), ("CREATE TABLE x (a int)", "CREATE"), ("EXEC p", "EXEC"),
        ("SELECT 1; SELECT 2", "one statement"), ("SELECT 'open", "string isn't closed"), ("SELECT /* open", "comment isn't closed"), ('SELECT "x"', "double quotes"), ("SELECT SUM(*) FROM people", "isn't supported"),
        ("SELECT id FROM people UNION SELECT id FROM pets FETCH NEXT 1 ROWS ONLY", "FETCH comes after OFFSET"), ("SELECT CONVERT(int, '1', 3)", "style"), ("SELECT a COLLATE x FROM people", "COLLATE"), ("SELECT 1 WHERE 1 = ANY (SELECT 1)", "ANY"),
        ("SELECT SUM(id) OVER (ORDER BY id RANGE UNBOUNDED PRECEDING) FROM people", "RANGE"), ("SELECT id FROM people INTERSECT ALL SELECT 1", "ALL"), ("SELECT CAST(1 AS geography)", "unknown type"), ("SELECT * FROM people PIVOT (x)", "PIVOT"),
        ("SELECT * FROM people WITH (NOLOCK)", "WITH"), ("UPDATE people SET age = 1 OUTPUT INSERTED.id", "OUTPUT"), ("UPDATE TOP (1) people SET age = 1", "TOP"), ("UPDATE people SET age = 1, AGE = 2", "set twice"), ("INSERT INTO people (id) VALUES (1, 2)", "as many values"),
        ("MERGE people USING pets ON 1 = 1 WHEN MATCHED THEN DELETE", "ends with ;"), ("MERGE people USING pets ON 1 = 1 WHEN MATCHED THEN INSERT (id) VALUES (1);", "doesn't go"), ("MERGE people USING pets ON 1 = 1;", "WHEN is missing"),
        ("WITH a AS (SELECT 1), a AS (SELECT 2) SELECT * FROM a", "one name"), ("SELECT GROUP FROM people", "missing"), ("", "missing"), ("SELECT DATEDIFF(day, 1)", "three arguments"), ("SELECT COUNT(DISTINCT id) FILTER (WHERE 1 = 1) FROM people", "FILTER"),
        ("SELECT x.* FROM (VALUES (1, 2)) AS x(a)", "as many values"), ("SELECT * FROM (SELECT 1 AS a)", "needs a name"), ("SELECT TOP 1 id FROM people ORDER BY id OFFSET 1 ROWS FETCH NEXT 1 ROWS ONLY", "don't go together"),
    ],
)
def test_refused(text, part):
    with pytest.raises(TsqlError, match="(?i)" + part.replace("(", r"\(")):
        parse(text)


@pytest.mark.parametrize(("text", "part"), [("SELECT * FROM nowhere", "no table nowhere"), ("SELECT wrong FROM people", "no column wrong"), ("SELECT * FROM other.people", "no schema other"), ("DELETE FROM people", "execute"), ("SELECT id FROM people WHERE id = @a", "no value")])
def test_checked_against_tables(session, text, part):
    with pytest.raises(TsqlError, match=part):
        session.query(text)


def test_parameters():
    tree = parse("SELECT id FROM people WHERE id IN (@ids) AND name = @n")
    bound, args = bind(tree, {"ids": [3, 4], "n": "x"})
    assert args == {"ids_0": 3, "ids_1": 4, "n": "x"} and ":ids_0, :ids_1" in to_sql(bound)
    for values, part in (({"ids": [], "n": 1}, "empty"), ({"ids": [1]}, "no value"), ({"ids": [1], "n": [2]}, "IN"), ({"ids": [1], "n": 1, "z": 2}, "no such"), ({"ids": [1], "n": 1, "N": 2}, "case")):
        with pytest.raises(TsqlError, match=part):
            bind(tree, values)


def test_values_never_become_text(session):
    evil = "x' OR '1'='1"
    assert session.query("SELECT id FROM people WHERE name = @n", {"n": evil}).count() == 0
    session.execute("UPDATE people SET name = @n WHERE id = 1", {"n": evil + "\\"})
    assert session.query("SELECT name FROM people WHERE id = 1").first()[0] == evil + "\\"


def test_insert_update_delete(session):
    session.execute("INSERT INTO people (id, name) VALUES (4, DEFAULT), (5, 'Eve')")
    session.execute("INSERT INTO people (id, name, age) SELECT id, kind, 1 FROM pets")
    assert rows(session.query("SELECT id, name, age FROM people WHERE id > 3")) == [(10, "cat", 1), (11, "dog", 1), (4, "none", None), (5, "Eve", None)]
    session.execute("UPDATE p SET age = age + 1, boss = q.id FROM people p INNER JOIN pets q ON q.owner = p.id WHERE q.kind = 'cat'")
    assert rows(session.query("SELECT age, boss FROM people WHERE id = 1")) == [(31, 10)]
    session.execute("DELETE p FROM people p INNER JOIN pets q ON q.owner = p.id WHERE p.id = 3")
    session.execute("DELETE FROM people WHERE id >= @n", {"n": 10})
    assert rows(session.query("SELECT id FROM people")) == [(1,), (2,), (4,), (5,)]
    with pytest.raises(ValueError, match="no such columns"):
        session.execute("UPDATE people SET wrong = 1")


def test_merge(session):
    session.execute("""
        MERGE INTO people AS t USING (SELECT owner AS id, kind FROM pets UNION ALL SELECT 7, 'eel') AS s ON t.id = s.id
        WHEN MATCHED AND s.kind = 'dog' THEN DELETE
        WHEN MATCHED THEN UPDATE SET name = s.kind
        WHEN NOT MATCHED THEN INSERT (id, name) VALUES (s.id, s.kind)
        WHEN NOT MATCHED BY SOURCE THEN UPDATE SET age = 0;""")
    assert rows(session.query("SELECT id, name, age FROM people")) == [(1, "cat", 30), (2, "Bob", 0), (7, "eel", None)]


def test_round_trip_through_text():
    for text in ("SELECT TOP 3 a.x AS y FROM t a WHERE a.x IN (1, 2) ORDER BY a.x DESC", "SELECT COUNT(DISTINCT x) AS n FROM t GROUP BY y", "WITH c AS (SELECT 1 AS k) SELECT k FROM c UNION ALL SELECT 2 AS k", "SELECT x FROM t ORDER BY x OFFSET 5 ROWS FETCH NEXT 2 ROWS ONLY"):
        tree = parse(text)
        assert parse(to_sql(tree, "tsql")) == tree
        assert S.from_json(S.to_json(tree)) == tree and S.from_xml(S.to_xml(tree)) == tree


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("SELECT x.nope FROM (SELECT id, name FROM people) AS x", "x has no column nope"),
        ("SELECT x.id FROM (SELECT nope AS id FROM people) AS x", "people has no column nope"),
        ("WITH a AS (SELECT id AS k FROM people) SELECT a.id FROM a", "a has no column id"),
        ("WITH a (k, m) AS (SELECT id, name FROM people) SELECT k, name FROM a", "a has no column name"),
        ("SELECT v.z FROM (VALUES (1, 2)) AS v(a, b)", "v has no column z"),
        ("SELECT p.id FROM people AS p WHERE EXISTS (SELECT 1 FROM pets AS q WHERE q.owner = p.nope)", "people has no column nope"),
        ("SELECT p.id FROM people AS p WHERE EXISTS (SELECT 1 FROM pets AS q WHERE r.owner = p.id)", "no source r"),
        ("SELECT x.id FROM (SELECT * FROM people UNION ALL SELECT * FROM people) AS x WHERE x.wrong = 1", "x has no column wrong"),
        ("SELECT (SELECT MAX(zz) FROM pets) AS m FROM people", "pets has no column zz"),
    ],
)
def test_columns_are_checked_where_they_are_named(session, text, part):
    with pytest.raises(TsqlError, match=part):
        session.query(text)


def test_scopes_see_what_is_around_them(session):
    text = "WITH RECURSIVE_ AS (SELECT id AS k FROM people) SELECT p.name, x.n FROM people AS p CROSS APPLY (SELECT COUNT(*) AS n FROM pets AS q WHERE q.owner = p.id AND age > 1) AS x WHERE p.id IN (SELECT k FROM RECURSIVE_) ORDER BY n"
    assert session.query(text).count() == 3
    assert session.query("SELECT id AS z FROM people ORDER BY z").count() == 3


def test_functions_with_a_schema(session):
    session.register_function("dbo.twice", lambda x: None if x is None else 2 * x, "int")
    session.register_function("main.dbo.thrice", lambda x: None if x is None else 3 * x, "int")
    assert rows(session.query("SELECT dbo.twice(id) AS a, main.dbo.thrice(id) AS b FROM people WHERE dbo.TWICE(id) > 2")) == [(4, 6), (6, 9)]
    with pytest.raises(Exception, match="other"):
        session.query("SELECT other.twice(id) AS a FROM people")


def test_output_of_changes(session):
    assert rows(session.execute("INSERT INTO people (id, name) OUTPUT INSERTED.id, INSERTED.name VALUES (40, 'x'), (41, 'y')").output) == [(40, "x"), (41, "y")]
    assert rows(session.execute("DELETE FROM people OUTPUT DELETED.* WHERE id = 40").output.select("id", "name")) == [(40, "x")]
    assert rows(session.execute("DELETE p OUTPUT DELETED.id FROM people AS p LEFT JOIN pets AS q ON q.owner = p.id WHERE q.id IS NULL").output) == [(2,), (41,)]


def test_changes_with_several_joins(session):
    session.execute("UPDATE p SET age = b.age + 100, name = DEFAULT FROM people AS p LEFT JOIN pets AS q ON q.owner = p.id INNER JOIN people AS b ON b.id = 2 WHERE q.id IS NULL OR p.id = 1")
    assert rows(session.query("SELECT id, name FROM people WHERE age > 99 OR age IS NULL")) != []
    with pytest.raises(ValueError, match="several rows"):
        session.execute("UPDATE p SET age = q.id FROM people AS p CROSS JOIN pets AS q")
    session.execute("DELETE FROM people FROM pets AS q WHERE q.owner = people.id")
    assert rows(session.query("SELECT id FROM people")) == [(2,)]


def test_transactions_put_tables_back(session):
    before = rows(session.query("SELECT id, name FROM people"))
    with pytest.raises(ZeroDivisionError), session.transaction():
        session.execute("DELETE FROM people")
        with session.transaction():
            session.execute("INSERT INTO people (id) VALUES (77)")
        assert rows(session.query("SELECT id FROM people")) == [(77,)]
        1 / 0
    assert rows(session.query("SELECT id, name FROM people")) == before
    with session.transaction():
        session.execute("DELETE FROM people WHERE id = 1")
    assert session.query("SELECT id FROM people WHERE id = 1").count() == 0


def test_scripts_of_text(session):
    out = session.script("UPDATE people SET age = @a WHERE id = 1; SELECT age FROM people WHERE id = @i;", {"a": 5, "i": 1})
    assert len(out) == 2 and rows(out[1]) == [(5,)]
    with pytest.raises(TsqlError, match="no such parameter"):
        session.script("SELECT id FROM people", {"z": 1})


def test_plans_do_not_grow_with_changes(session):
    for i in range(17):
        session.execute("UPDATE people SET age = @n WHERE id = 1", {"n": i})
    plan = session.tables["people"]._jdf.queryExecution().optimizedPlan().toString()
    assert rows(session.query("SELECT age FROM people WHERE id = 1")) == [(16,)] and len(plan.splitlines()) < 8
