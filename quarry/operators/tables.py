"""Table definitions with keys, defaults and indexes; they are compared, and kept in a schema's metadata."""

from __future__ import annotations

import enum
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = False
    primary_key: bool = False
    identity: bool = False
    default: object = None
    references: tuple[tuple[str, str], ...] = ()
    size: int | None = None

    def field(self) -> T.StructField:
        meta = {"pk": self.primary_key, "identity": self.identity, "default": json.dumps(self.default), "fk": [list(r) for r in self.references], "size": self.size or 0}
        return T.StructField(self.name, T._parse_datatype_string(self.type), self.nullable, {"quarry": json.dumps(meta)})


@dataclass(frozen=True)
class IndexDef:
    columns: tuple[str, ...]
    unique: bool = False
    clustered: bool = False
    descending: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    indexes: tuple[IndexDef, ...] = ()

    def __post_init__(self):
        names = [c.name.lower() for c in self.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"{self.name} has two columns of one name")

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise KeyError(f"{self.name} has no column {name}")

    @property
    def key(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.primary_key)

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def with_(self, name: str | None = None, columns=None, indexes=None) -> TableDef:
        """A copy; functions given get the old columns or indexes."""
        made = lambda f, old: old if f is None else tuple(f(old)) if callable(f) else tuple(f)
        return replace(self, name=name or self.name, columns=made(columns, self.columns), indexes=made(indexes, self.indexes))

    def frame(self, spark: SparkSession, rows: list[tuple]) -> DataFrame:
        """Rows of this table."""
        return spark.createDataFrame(rows, self.schema())

    # DDL

    def create(self, spark: SparkSession) -> None:
        """An empty Parquet table; keys and defaults go to the fields' metadata."""
        spark.createDataFrame([], self.schema()).write.saveAsTable(self.name)

    def drop(self, spark: SparkSession, if_exists: bool = True) -> None:
        if not if_exists and not spark.catalog.tableExists(self.name):
            raise ValueError(f"no table {self.name}")
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", {"name": self.name})

    def recreate(self, spark: SparkSession) -> None:
        self.drop(spark)
        self.create(spark)

    @staticmethod
    def of(df: DataFrame, name: str) -> TableDef:
        """The definition that a schema, and metadata left by :meth:`schema`, tell."""
        out = []
        for f in df.schema:
            m = json.loads(f.metadata["quarry"]) if "quarry" in f.metadata else {}
            refs = tuple((a, b) for a, b in m.get("fk", []))
            out.append(ColumnDef(f.name, f.dataType.simpleString(), f.nullable, m.get("pk", False), m.get("identity", False), json.loads(m.get("default", "null")), refs, m.get("size") or None))
        return TableDef(name, tuple(out))


class Difference(enum.Flag):
    NONE = 0
    TYPE = enum.auto()
    SIZE = enum.auto()
    NULLABILITY = enum.auto()
    KEY = enum.auto()
    DEFAULT = enum.auto()
    REFERENCES = enum.auto()
    ALL = TYPE | SIZE | NULLABILITY | KEY | DEFAULT | REFERENCES


def column_difference(a: ColumnDef, b: ColumnDef, look: Difference = Difference.ALL) -> Difference:
    out = Difference.NONE
    for flag, f in ((Difference.TYPE, lambda c: c.type), (Difference.SIZE, lambda c: c.size), (Difference.NULLABILITY, lambda c: c.nullable), (Difference.KEY, lambda c: (c.primary_key, c.identity)), (Difference.DEFAULT, lambda c: c.default), (Difference.REFERENCES, lambda c: frozenset(c.references))):
        if flag in look and f(a) != f(b):
            out |= flag
    return out


@dataclass(frozen=True)
class TableComparison:
    missing: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    different: dict[str, Difference] = field(default_factory=dict)
    indexes: tuple[IndexDef, ...] = ()
    key_order: bool = False


def compare_tables(a: TableDef, b: TableDef, look: Difference = Difference.ALL) -> TableComparison | None:
    """What ``b`` lacks, has besides, or has otherwise; None if nothing."""
    mine, theirs = ({c.name.lower(): c for c in t.columns} for t in (a, b))
    missing = tuple(c.name for k, c in mine.items() if k not in theirs)
    extra = tuple(c.name for k, c in theirs.items() if k not in mine)
    different = {c.name: d for k, c in mine.items() if k in theirs and (d := column_difference(c, theirs[k], look))}
    indexes = tuple(set(a.indexes) ^ set(b.indexes))
    order = [k.lower() for k in a.key] != [k.lower() for k in b.key]
    return TableComparison(missing, extra, different, indexes, order) if missing or extra or different or indexes or order else None


@dataclass(frozen=True)
class Comparison:
    missing: tuple[str, ...]
    extra: tuple[str, ...]
    different: dict[str, TableComparison]


def compare(a: list[TableDef], b: list[TableDef], look: Difference = Difference.ALL) -> Comparison | None:
    mine, theirs = ({t.name.lower(): t for t in x} for x in (a, b))
    out = Comparison(
        tuple(t.name for k, t in mine.items() if k not in theirs),
        tuple(t.name for k, t in theirs.items() if k not in mine),
        {t.name: d for k, t in mine.items() if k in theirs and (d := compare_tables(t, theirs[k], look))},
    )
    return out if out.missing or out.extra or out.different else None


def includes(a: TableDef, b: TableDef, look: Difference = Difference.TYPE) -> bool:
    """Whether ``a`` has all columns of ``b``, alike in what is looked at."""
    found = compare_tables(b, a, look)
    return found is None or not (found.missing or found.different)
