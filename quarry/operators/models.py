"""Joins whose rows hold one object for each table, and rows made from objects."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.sinks import Page, page


class ModelSelect:
    """Tables joined one after the other; each becomes a struct column, null where an outer join found nothing."""

    def __init__(self, df: DataFrame, name: str):
        self.names, self._df = [name], self._packed(df, name)

    @staticmethod
    def _packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))

    def _join(self, df: DataFrame, name: str, on: Callable[..., Column], how: str) -> ModelSelect:
        if name in self.names:
            raise ValueError(f"{name} is joined already")
        out = object.__new__(ModelSelect)
        out.names = [*self.names, name]
        out._df = self._df.join(self._packed(df, name), on(*[F.col(n) for n in out.names]), how)
        return out

    def inner(self, df: DataFrame, name: str, on: Callable[..., Column]) -> ModelSelect:
        return self._join(df, name, on, "inner")

    def left(self, df: DataFrame, name: str, on: Callable[..., Column]) -> ModelSelect:
        return self._join(df, name, on, "left")

    def frame(self) -> DataFrame:
        return self._df

    def get(self, where: Column | None = None, order: list | None = None) -> DataFrame:
        out = self._df if where is None else self._df.where(where)
        return out.orderBy(*order) if order else out

    def find(self, offset: int, size: int, order: list, where: Column | None = None) -> Page:
        return page(self.get(where), order, offset, size)


def model_select(df: DataFrame, name: str) -> ModelSelect:
    return ModelSelect(df, name)


def frame_of(spark: SparkSession, items: Iterable, schema: str | None = None, **more: Callable) -> DataFrame:
    """A DataFrame of dataclass objects or dictionaries; ``more`` adds columns computed from each. Without items: an error unless there is a schema."""
    rows = []
    for x in items:
        row = dataclasses.asdict(x) if dataclasses.is_dataclass(x) else dict(x)
        if clash := set(row) & set(more):
            raise ValueError(f"given twice: {', '.join(sorted(clash))}")
        rows.append(row | {k: f(x) for k, f in more.items()})
    if not rows and schema is None:
        raise ValueError("there are no items, and no schema")
    return spark.createDataFrame(rows, schema) if schema else spark.createDataFrame(rows)


def objects(df: DataFrame, kind: type) -> list:
    """Rows as objects of a dataclass, fields by name."""
    names = [f.name for f in dataclasses.fields(kind)]
    return [kind(**{n: r[n] for n in names}) for r in df.select(*names).toLocalIterator()]


class ModelMap:
    """A dataclass and the columns its fields stand for, in both directions.

    ``columns`` maps fields to columns of other names; ``keys`` are the fields that tell objects apart.
    """

    def __init__(self, kind: type, keys: Iterable[str] = (), columns: dict[str, str] | None = None):
        self.kind, self.keys = kind, tuple(keys)
        names = [f.name for f in dataclasses.fields(kind)]
        if unknown := {*self.keys, *(columns or {})} - set(names):
            raise ValueError(f"no such fields: {', '.join(sorted(unknown))}")
        self.columns = {n: (columns or {}).get(n, n) for n in names}

    def read(self, row) -> object:
        """An object from a row, by name."""
        return self.kind(**{f: row[c] for f, c in self.columns.items()})

    def read_ordinal(self, row, start: int = 0) -> object:
        """An object from a row's values in the order of the fields."""
        return self.kind(*[row[start + i] for i in range(len(self.columns))])

    def select(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in self.columns.values()])

    def objects(self, df: DataFrame) -> list:
        return [self.read(r) for r in self.select(df).toLocalIterator()]

    def key_of(self, x) -> dict:
        return {self.columns[k]: getattr(x, k) for k in self.keys}

    def update_of(self, x) -> dict:
        """The columns that aren't keys, with an object's values."""
        return {c: getattr(x, f) for f, c in self.columns.items() if f not in self.keys}

    def rows(self, items: Iterable) -> list[dict]:
        return [{c: getattr(x, f) for f, c in self.columns.items()} for x in items]

    @property
    def key_columns(self) -> list[str]:
        return [self.columns[k] for k in self.keys]


def all_of(*predicates: Column | None) -> Column:
    """AND of those that aren't None; true without any."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def any_of(*predicates: Column | None) -> Column:
    """OR of those that aren't None; false without any."""
    return reduce(lambda a, b: a | b, [p for p in predicates if p is not None], F.lit(False))
