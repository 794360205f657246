"""Scripts: temporary tables that don't change with their source, conditions, and steps one after the other."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import dml
from quarry.operators.models import frame_of
from quarry.operators.tables import TableDef
from quarry.session import shared_folder


def temp_table(df: DataFrame, name: str, keys: Iterable[str] = ()) -> tuple[DataFrame, TableDef]:
    """The rows as they are now under a session's name, and their definition with ``keys`` as the key.

    They are written to the shared folder, so that later changes of the source don't show and a lost
    executor costs nothing.
    """
    definition = TableDef.of(df, name)
    wanted = {k.lower() for k in keys}
    if unknown := wanted - {c.name.lower() for c in definition.columns}:
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    definition = definition.with_(columns=lambda cs: [replace(c, primary_key=c.name.lower() in wanted, nullable=c.nullable and c.name.lower() not in wanted) for c in cs])
    path = f"{shared_folder(df.sparkSession)}/temp-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.createOrReplaceTempView(name.lstrip("#"))
    return kept, definition


def temp_values(spark: SparkSession, rows: list[tuple], schema: str, name: str, keys: Iterable[str] = ()) -> tuple[DataFrame, TableDef]:
    """Given rows as a temporary table."""
    if not rows:
        raise ValueError("there are no rows")
    return temp_table(spark.createDataFrame(rows, schema), name, keys)


def drop_temp(spark: SparkSession, name: str) -> bool:
    """Whether there was one."""
    return spark.catalog.dropTempView(name.lstrip("#"))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name.lstrip("#"))


def when(test: bool | DataFrame | Callable[[], bool], then: Callable, otherwise: Callable | None = None):
    """One of two steps; a DataFrame counts as true if it has a row."""
    holds = not test.isEmpty() if isinstance(test, DataFrame) else test() if callable(test) else test
    return then() if holds else otherwise() if otherwise else None


def run_all(*steps: Callable):
    """Steps in order; the result of the last one."""
    out = None
    for s in steps:
        out = s()
    return out


# Changes from objects: dataclasses or dictionaries become rows, then it is a change like any other


def _rows(target: DataFrame, items: Iterable, more: dict[str, Callable]) -> DataFrame:
    made = [dict(x) if isinstance(x, dict) else vars(x) for x in items]
    if not made:
        raise ValueError("there are no items")
    names = [*made[0], *more]
    types = {f.name: f.dataType.simpleString() for f in target.schema}
    if unknown := set(names) - set(types):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    return frame_of(target.sparkSession, made, ", ".join(f"`{n}` {types[n]}" for n in names), **more)


def insert_objects(target: DataFrame, items: Iterable, unless_exists: list[str] | None = None, also: dict | None = None, definition: TableDef | None = None, **more: Callable) -> dml.Change:
    return dml.insert(target, _rows(target, items, more), unless_exists, also, definition)


def _on(keys: Iterable[str]) -> Column:
    out = None
    for k in keys:
        one = F.col(f"target.{k}") == F.col(f"source.{k}")
        out = one if out is None else out & one
    if out is None:
        raise ValueError("there are no keys")
    return out


def update_objects(target: DataFrame, items: Iterable, keys: list[str], also: dict | None = None, **more: Callable) -> dml.Change:
    """Rows with an object's keys take its other values, and ``also``'s expressions."""
    source = _rows(target, items, more)
    values = {c: F.col(f"source.{c}") for c in source.columns if c not in keys}
    if clash := set(values) & set(also or {}):
        raise ValueError(f"set twice: {', '.join(sorted(clash))}")
    return dml.update(target, values | (also or {}), source=source, on=_on(keys))


def merge_objects(target: DataFrame, items: Iterable, keys: list[str], update: bool = True, insert: bool = True, delete_others: bool | Column = False, update_also: dict | None = None, insert_also: dict | None = None, exclude: Iterable[str] = (), and_on: Column | None = None, definition: TableDef | None = None, **more: Callable) -> dml.Change:
    """Objects merged by keys: matches updated, new ones inserted, rows without an object deleted, as asked."""
    source = _rows(target, items, more)
    on = _on(keys) if and_on is None else _on(keys) & and_on
    out = dml.merge(target, source, on, definition)
    if update:
        out.when_matched_update({c: F.col(f"source.{c}") for c in source.columns if c not in keys} | (update_also or {}))
    if insert:
        skip = set(exclude)
        out.when_not_matched_insert({c: F.col(f"source.{c}") for c in source.columns if c not in skip} | (insert_also or {}))
    if delete_others is not False:
        out.when_not_matched_by_source_delete(None if delete_others is True else delete_others)
    return out.run()
