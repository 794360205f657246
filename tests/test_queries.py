"""Every registered query of the relational part against DuckDB on the same files."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from quarry.plans import catalog, more  # noqa: F401 (adds to the catalog's queries)

FOLDER = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def test_each_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_filters_and_columns_reach_the_scan(spark, capsys):
    catalog.QUERIES["between"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_totalprice" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    catalog.QUERIES["pricing_summary"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Exchange") and "l_comment" not in plan and "PushedFilters: [IsNotNull(l_shipdate)" in plan
