"""A strict T-SQL subset: text is parsed to a tree, checked against the tables known, and run by Spark.

What the subset lacks is refused with a message; nothing is ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import spec as S
from quarry.emit import Emitter
from quarry.operators import dml
from quarry.operators.script import temp_table
from quarry.operators.tables import TableDef
from quarry.sources.readers import register_table_function, shape
from quarry.tsql.parser import TsqlError, parse, split
from quarry.tsql.scopes import check_columns

__all__ = ["Session", "TsqlError", "parse"]


#: Changes of a table after which it is written to the shared folder.
SNAPSHOT = 8


class Session:
    """Tables by name, and T-SQL over them. Changes give new DataFrames and register them under the old name."""

    def __init__(self, spark: SparkSession, schema: str = "dbo"):
        self.spark, self.schema, self.tables, self.views = spark, schema, {}, {}
        self.functions: dict[str, str] = {}
        self._changes: dict[str, int] = {}
        self.definitions: dict[str, TableDef] = {}

    def register(self, name: str, df: DataFrame, definition: TableDef | None = None) -> None:
        view = f"quarry_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(view)
        self.tables[name.lower()], self.views[name.lower()] = df, view
        if definition:
            self.definitions[name.lower()] = definition

    def register_function(self, name: str, function, returns: str = "string") -> None:
        """A Python function, or a pandas_udf, under a bare name or one with its schema, or database and schema."""
        own = f"quarry_{uuid.uuid4().hex[:12]}"
        if hasattr(function, "returnType"):
            self.spark.udf.register(own, function)
        else:
            self.spark.udf.register(own, function, returns)
        self.functions[name.lower()] = own

    def register_table_function(self, name: str, function) -> None:
        """A class decorated with ``udtf`` under a name like those of :meth:`register_function`, for FROM and APPLY."""
        own = f"quarry_{uuid.uuid4().hex[:12]}"
        register_table_function(self.spark, own, function)
        self.functions[name.lower()] = own

    def script(self, text: str, params: dict | None = None) -> list[DataFrame | dml.Change]:
        """Statements parted by semicolons, one after the other: what each of them gives.

        Each takes those of the parameters that it names; one that none of them names is an error.
        """
        given = {k.lower().lstrip("@"): v for k, v in (params or {}).items()}
        parts = [p for p in split(text) if p.strip(" ;\n\t\r")]
        trees = [parse(p) for p in parts]
        named = [{x.name.lower() for x in tree.walk() if isinstance(x, S.Param)} for tree in trees]
        if spare := set(given) - set().union(*named):
            raise TsqlError(f"no such parameter: {', '.join(sorted(spare))}")
        out = []
        for part, tree, names in zip(parts, trees, named, strict=True):
            run = self.execute if isinstance(tree, (S.Insert, S.Update, S.Delete, S.Merge)) else self.query
            out.append(run(part, {k: v for k, v in given.items() if k in names}))
        return out

    @contextmanager
    def transaction(self) -> Iterator[Session]:
        """All changes made inside, or none: an error puts every table back. Transactions may be nested.

        Tables are values and a change registers a new one, so what others read meanwhile stays as it was.
        Files are changed by :class:`quarry.operators.store.Store`, which takes several tables at once.
        """
        kept = dict(self.tables), dict(self.views), dict(self.definitions)
        try:
            yield self
        except BaseException:
            self.tables, self.views, self.definitions = kept
            raise

    def check(self, tree: S.Node) -> None:
        """Every table must exist, and every column in the scope where it is named."""
        for name in S.tables(tree):
            if name.lower() not in self.tables:
                raise TsqlError(f"there is no table {name}")
        check_columns(tree, {k: {c.lower() for c in t.columns} for k, t in self.tables.items()})
        for x in tree.walk():
            if isinstance(x, S.Table) and x.schema and x.schema.lower() != self.schema:
                raise TsqlError(f"there is no schema {x.schema}")

    def _emitter(self, tree: S.Node) -> Emitter:
        owner = {(x.alias or x.name).lower(): x.name.lower() for x in tree.walk() if isinstance(x, S.Table)}
        kinds = {t: dict(self.tables[t].dtypes) for t in set(owner.values()) if t in self.tables}

        def integral(source: str, name: str) -> bool:
            found = [k.get(name) for t, k in kinds.items() if not source or owner.get(source.lower()) == t]
            return any(f in ("tinyint", "smallint", "int", "bigint") for f in found)

        return Emitter("spark", integral, self.views, functions=self.functions)

    def query(self, text: str, params: dict | None = None) -> DataFrame:
        tree = parse(text)
        if isinstance(tree, (S.Insert, S.Update, S.Delete, S.Merge)):
            raise TsqlError("this changes a table; use execute()")
        return self.run(tree, params)

    def run(self, tree: S.Node, params: dict | None = None) -> DataFrame:
        tree, args = bind(tree, params or {})
        self.check(tree)
        return self.spark.sql(self._emitter(tree).sql(tree), args)

    def shape(self, text: str) -> list[tuple[str, str, bool]]:
        """Names, types and nullability of a query's result; parameters are taken as null, and nothing runs."""
        tree = parse(text)
        return shape(self.run(tree, {x.name: None for x in tree.walk() if isinstance(x, S.Param)}))

    def _bare(self, x: S.Node | None, tree: S.Node, sides: dict[str, str], loose: dict[str, str] | None = None) -> Column | None:
        """An expression as a Column over target and source structs; ``loose`` has the side of names without one."""
        if x is None:
            return None

        def placed(n: S.Node):
            if not isinstance(n, S.Col):
                return n
            if n.source:
                return n.with_(source=sides.get(n.source.lower(), n.source))
            side = (loose or {}).get(n.name.lower(), "")
            if side == "both":
                raise TsqlError(f"{n.name} is a column of both sides")
            return n.with_(source=side)

        return F.expr(self._emitter(tree).sql(x.transform(placed)))

    def _source(self, source: S.Node) -> tuple[DataFrame, str]:
        alias = getattr(source, "alias", "") or source.name
        plain = S.Select((S.Star(),), source)
        return self.run(plain), alias

    def execute(self, text: str, params: dict | None = None) -> dml.Change:
        """Insert, update, delete or merge; the table's new version is registered."""
        tree, _ = bind(parse(text), params or {}, inline=True)
        name = tree.target.name.lower()
        if name not in self.tables:
            raise TsqlError(f"there is no table {tree.target.name}")
        target, definition = self.tables[name], self.definitions.get(name)
        mine = {(tree.target.alias or tree.target.name).lower(): "target", name: "target"}
        value = lambda a, sides, loose=None: dml.DEFAULT if a.value is None else self._bare(a.value, tree, sides, loose)
        if isinstance(tree, S.Insert):
            columns = list(tree.columns or target.columns)
            if isinstance(tree.source, S.Values):
                rows = tree.source.rows
                frames = []
                for r in rows:
                    if len(r) != len(columns):
                        raise TsqlError("a row has not as many values as there are columns")
                    cells = [(dml._value(dml.DEFAULT, c, definition) if isinstance(x, S.Raw) and x.text == "DEFAULT" else self._bare(x, tree, {})).cast(target.schema[c].dataType).alias(c) for c, x in zip(columns, r, strict=True)]
                    frames.append(self.spark.range(1).select(*cells))
                new = frames[0]
                for f in frames[1:]:
                    new = new.unionAll(f)
            else:
                new = self.run(tree.source)
                if len(new.columns) != len(columns):
                    raise TsqlError("the query has not as many columns as are listed")
                new = new.toDF(*columns)
            change = dml.insert(target, new, definition=definition)
        elif isinstance(tree, S.Merge):
            source, alias = self._source(tree.source)
            sides = mine | {alias.lower(): "source"}
            loose = _loose(target, source)
            m = dml.merge(target, source, self._bare(tree.on, tree, sides, loose), definition)
            for c in tree.clauses:
                when, assign = self._bare(c.when, tree, sides, loose), {a.column: value(a, sides, loose) for a in c.assigns}
                if c.action == "DELETE":
                    (m.when_matched_delete if c.kind == "MATCHED" else m.when_not_matched_by_source_delete)(when)
                elif c.action == "UPDATE":
                    (m.when_matched_update if c.kind == "MATCHED" else m.when_not_matched_by_source_update)(assign, when)
                elif c.action == "DEFAULTS":
                    m.when_not_matched_insert_defaults(_keys(tree, sides), when)
                else:
                    m.when_not_matched_insert(assign, when)
            change = m.run()
        else:
            source = tree.source
            if source is None:
                flat = {k: "" for k in mine}
                where = self._bare(tree.where, tree, flat)
                change = dml.delete(target, where) if isinstance(tree, S.Delete) else dml.update(target, {a.column: value(a, flat) for a in tree.assigns}, where, definition=definition)
            else:
                change = self._joined(tree, target, definition)
        if getattr(tree, "output", ()):
            rows = change.inserted if isinstance(tree, S.Insert) else change.deleted
            change.output = rows.select(*["*" if c == "*" else F.col(f"`{c}`") for c in tree.output])
        self._changes[name] = self._changes.get(name, 0) + 1
        if self._changes[name] % SNAPSHOT == 0:  # else a table's plan would grow with every change
            change.table = dml.snapshot(change.table)
        self.register(tree.target.name, change.table)
        return change

    def _joined(self, tree: S.Update | S.Delete, target: DataFrame, definition: TableDef | None) -> dml.Change:
        """UPDATE or DELETE with FROM, whatever its joins: rows of the target are numbered in a snapshot, and met by number.

        A row that is updated from several rows of the other tables is an error.
        """
        number, copy = "quarry_row", f"quarry_{uuid.uuid4().hex[:12]}"
        alias = tree.target.alias or tree.target.name
        mine = lambda x: isinstance(x, S.Table) and (x.alias or x.name).lower() == alias.lower()
        source = tree.source if tree.source.first(mine) else S.Join("CROSS", tree.target, tree.source)
        source = source.transform(lambda x: S.Table(copy, "", alias) if mine(x) else x)
        numbered, _ = temp_table(target.withColumn(number, F.monotonically_increasing_id()), copy)
        inner = Session(self.spark, self.schema)
        inner.tables, inner.views, inner.functions = dict(self.tables), dict(self.views), self.functions
        inner.register(copy, numbered)
        assigns = tree.assigns if isinstance(tree, S.Update) else ()
        values = tuple(S.Item(a.value, f"quarry_{i}") for i, a in enumerate(assigns) if a.value is not None)
        found = inner.run(S.Select((S.Item(S.Col(number, alias), number), *values), source, tree.where))
        met = F.col(f"target.{number}") == F.col(f"source.{number}")
        if isinstance(tree, S.Delete):
            change = dml.delete(numbered, None, found, met)
        else:
            given = {a.column: dml.DEFAULT if a.value is None else F.col(f"source.quarry_{i}") for i, a in enumerate(assigns)}
            change = dml.update(numbered, given, None, found, met, definition)
        return dml.Change(*[x if x is None else x.drop(number) for x in (change.table, change.inserted, change.deleted)])


def _loose(target: DataFrame, source: DataFrame) -> dict[str, str]:
    """The side of each column name."""
    out = {c.lower(): "target" for c in target.columns}
    return out | {c.lower(): "both" if c.lower() in out else "source" for c in source.columns}


def _keys(tree: S.Merge, sides: dict[str, str]) -> dict:
    """Target columns that the ON condition sets equal to the source's."""
    out = {}
    for x in tree.on.walk():
        if isinstance(x, S.Binary) and x.op == "=" and isinstance(x.left, S.Col) and isinstance(x.right, S.Col):
            for a, b in ((x.left, x.right), (x.right, x.left)):
                if sides.get(a.source.lower()) == "target" and sides.get(b.source.lower()) == "source":
                    out[a.name] = F.col(f"source.{b.name}")
    return out


def bind(tree: S.Node, values: dict, inline: bool = False) -> tuple[S.Node, dict]:
    """Give @parameters their values: lists only inside IN; missing, spare and empty ones are errors."""
    by_name = {k.lower().lstrip("@"): v for k, v in values.items()}
    if len(by_name) < len(values):
        raise TsqlError("parameter names differ in case only")
    args, used = {}, set()

    def put(name: str, v):
        if inline:
            return S.Literal(v)
        args[name] = v
        return S.Param(name)

    def change(n: S.Node):
        if isinstance(n, S.In) and len(n.items) == 1 and isinstance(n.items[0], S.Raw) and n.items[0].text.startswith("@"):
            name = n.items[0].text[1:]
            items = list(by_name[name])
            if not items:
                raise TsqlError(f"@{name} is an empty list")
            return n.with_(items=tuple(put(f"{name}_{i}", v) for i, v in enumerate(items)))
        if isinstance(n, S.In) and any(isinstance(x, S.Raw) and x.text.startswith("@") for x in n.items):
            raise TsqlError("a list stands alone in IN ( )")
        if isinstance(n, S.Param):
            name = n.name.lower()
            if name not in by_name:
                raise TsqlError(f"no value for the parameter @{n.name}")
            used.add(name)
            v = by_name[name]
            return S.Raw("@" + name) if isinstance(v, (list, tuple, set, frozenset)) else put(name, v)
        return n

    out = tree.transform(change)
    for n in out.walk():
        if isinstance(n, S.Raw) and n.text.startswith("@"):
            raise TsqlError(f"{n.text} is a list, which stands in IN ( ) only")
    if spare := set(by_name) - used:
        raise TsqlError(f"no such parameter: {', '.join(sorted(spare))}")
    return out, args
