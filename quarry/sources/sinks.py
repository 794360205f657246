"""Ways to take rows out of a DataFrame: folds, handlers, lists, dictionaries, pages and scalars."""

from __future__ import annotations

import asyncio
import contextlib
import itertools
import os
import shutil
import tempfile
import uuid
from collections.abc import AsyncIterator, Callable, Iterator
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_folder, tasks_for


def fold(df: DataFrame, seed: Any, step: Callable[[Any, Row], Any]) -> Any:
    """Rows one after the other through ``step``; one partition at a time is on the driver."""
    for row in df.toLocalIterator():
        seed = step(seed, row)
    return seed


def each(df: DataFrame, handler: Callable[[Row], None]) -> None:
    for row in df.toLocalIterator():
        handler(row)


def stream_rows(df: DataFrame) -> Iterator[Row]:
    """Rows as they are asked for; the next partition is fetched meanwhile."""
    yield from df.toLocalIterator(prefetchPartitions=True)


async def stream_rows_async(df: DataFrame, at_once: int = 1000) -> AsyncIterator[Row]:
    """Rows as they are asked for, fetched in another thread: the event loop goes on meanwhile."""
    rows = df.toLocalIterator(prefetchPartitions=True)
    while part := await asyncio.to_thread(lambda: list(itertools.islice(rows, at_once))):
        for r in part:
            yield r


def to_list(df: DataFrame, make: Callable[[Row], Any] = lambda r: r, keep: Callable[[Any], bool] | None = None) -> list:
    made = map(make, df.toLocalIterator())
    return [x for x in made if keep is None or keep(x)]


def to_dict(df: DataFrame, key: Callable[[Row], Any], value: Callable[[Row], Any] = lambda r: r, on_duplicate: Callable[[Any, Any, Any], Any] | None = None) -> dict:
    """A dictionary; a key met again is an error unless ``on_duplicate`` (key, old, new) gives a value."""
    out: dict = {}
    for r in df.toLocalIterator():
        k, v = key(r), value(r)
        if k in out:
            if on_duplicate is None:
                raise KeyError(f"the key {k!r} occurs more than once")
            v = on_duplicate(k, out[k], v)
        out[k] = v
    return out


def scalar(df: DataFrame) -> Any:
    """The first column of the first row; None without rows."""
    row = df.first()
    return None if row is None else row[0]


@dataclass(frozen=True)
class Page:
    items: list
    offset: int
    total: int


def page(df: DataFrame, order: list, offset: int, size: int, make: Callable[[Row], Any] = lambda r: r) -> Page:
    """Some rows in order and the number of all, which is right for a page past the end, too."""
    if offset < 0 or size < 1:
        raise ValueError("a page starts at 0 or later and has a row at least")
    return Page([make(r) for r in df.orderBy(*order).offset(offset).limit(size).collect()], offset, df.count())


def page_frame(df: DataFrame, order: list, offset: int, size: int, total: str) -> DataFrame:
    """A page as a DataFrame with the number of all rows in ``total``: one row is joined, no window over all is sorted."""
    count = df.select(F.count(F.lit(1)).alias(total))
    return df.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(count))


def after_frame(df: DataFrame, order: list[str], offset: int) -> DataFrame:
    """All rows but the first ones, ascending, nulls last: no task holds or sorts all rows.

    Equal rows by ``order`` are told apart by the other columns. The first ``offset`` rows, a number that
    doesn't grow with the table, are in one task; what is behind the last of them is a filter. Rows that
    are the same as that one in every column are counted, and as many as are left are made again.
    """
    if offset < 0:
        raise ValueError("an offset is 0 or more")
    by = [*order, *(x for x in df.columns if x not in order)]
    parts = tasks_for(df)

    def ordered(rows):  # small tables are left to the engine, which may join tasks
        keys = list(map(F.asc_nulls_last, order))
        return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if parts > 8 else rows.orderBy(*keys)

    if not offset:
        return ordered(df)
    first = df.orderBy(*map(F.asc_nulls_last, by)).limit(offset).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    last = first.orderBy(*map(F.desc_nulls_first, by)).limit(1).select(*[F.col(x).alias(f"last_{i}") for i, x in enumerate(by)], F.col("n").alias("last_n"))
    both = df.crossJoin(F.broadcast(last))
    behind, same = F.lit(False), F.lit(True)
    for i, x in reversed(list(enumerate(by))):
        v, w = F.col(x), F.col(f"last_{i}")
        behind = F.coalesce(v > w, v.isNull() & w.isNotNull()) | (v.eqNullSafe(w) & behind)
        same = same & v.eqNullSafe(w)
    left = both.where(same).groupBy(*df.columns).agg((F.count(F.lit(1)) - F.max("last_n")).alias("last_n")).where("last_n > 0")
    some = left.select("*", F.explode(F.expr("sequence(0L, (last_n - 1) div 100000)")).alias("last_k")).repartition("last_k")
    again = some.select(*df.columns, F.explode(F.expr("sequence(1L, least(100000L, last_n - 100000L * last_k))"))).select(*df.columns)
    return ordered(both.where(behind).select(*df.columns).union(again))


@contextlib.contextmanager
def cancellable(spark: SparkSession):
    """A tag under which all that is started inside runs; calling what is yielded stops it."""
    tag = f"quarry-{uuid.uuid4().hex}"
    spark.addTag(tag)
    try:
        yield lambda: spark.interruptTag(tag)
    finally:
        spark.removeTag(tag)


def column_text(df: DataFrame, name: str) -> DataFrame:
    """A column as text that ``column_from_text`` reads back."""
    kind = df.schema[name].dataType.typeName()
    return df.select((F.base64(name) if kind == "binary" else F.col(name).cast("string")).alias(name))


def column_from_text(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.select((F.unbase64(name) if kind == "binary" else F.col(name).cast(kind)).alias(name))


_DERBY = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "CLOB"}
DERBY_DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def derby_archive(df: DataFrame, table: str) -> str:
    """The rows as a table of a new Derby database; its JDBC address.

    Derby lets one JVM open a database, or any number an archived one, read-only. So the driver makes it, row
    by row, and archives it in the shared folder, where each executor opens it. That folder has to be a path
    of the machines; the archive goes when the application ends.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/derby-{uuid.uuid4().hex}.jar")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if (scheme := files.getUri().getScheme()) != "file":
        raise RuntimeError(f"Derby opens files of the machine only: spark.checkpoint.dir is a folder of {scheme}")
    if unknown := {kind for _, kind in df.dtypes} - set(_DERBY):
        raise ValueError(f"no type of Derby for {', '.join(sorted(unknown))}")
    own = tempfile.mkdtemp(prefix="quarry-")  # the driver's own, until it is archived
    try:
        driver = jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver()
        address, none = f"jdbc:derby:{own}/made/db", jvm.java.util.Properties()
        con = driver.connect(f"{address};create=true", none)
        con.setAutoCommit(False)
        quoted = ['"' + n.replace('"', '""') + '"' for n in df.columns]
        con.createStatement().execute(f"CREATE TABLE {table} ({', '.join(f'{n} {_DERBY[k]}' for n, (_, k) in zip(quoted, df.dtypes, strict=True))})")
        put = con.prepareStatement(f"INSERT INTO {table} VALUES ({', '.join('?' * len(quoted))})")
        for row in df.toLocalIterator():
            for i, v in enumerate(row, 1):
                put.setObject(i, v)
            put.executeUpdate()
        con.commit()
        con.close()
        try:
            driver.connect(f"{address};shutdown=true", none)
        except Py4JJavaError as e:  # the answer to a shutdown that went well is an exception, too
            if e.java_exception.getSQLState() != "08006":
                raise
        made = shutil.make_archive(f"{own}/db", "zip", f"{own}/made")
        files.copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(made), path)
        files.deleteOnExit(path)
    finally:
        shutil.rmtree(own, True)
    return f"jdbc:derby:jar:({os.path.abspath(path.toUri().getPath())})db"
