"""Insert, update, delete and merge over tables without row-level writes: each gives the new table as a DataFrame.

Nothing is written until :func:`commit` puts a new version in a path's place. All are joins and filters, so
they run in parallel; a source that matches a target row more than once is an error unless told otherwise.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.tables import TableDef
from quarry.session import shared_folder


@dataclass
class Change:
    """The table afterwards, and the rows touched."""

    table: DataFrame
    inserted: DataFrame | None = None
    deleted: DataFrame | None = None
    output: DataFrame | None = None


class Default:
    """Stands for a column's default in an assignment."""


DEFAULT = Default()


def _value(v, column: str, definition: TableDef | None) -> Column:
    if isinstance(v, Default):
        v = definition.column(column).default if definition else None
    return v if isinstance(v, Column) else F.lit(v)


def insert(target: DataFrame, rows: DataFrame, unless_exists: list[str] | None = None, also: dict | None = None, definition: TableDef | None = None, identity: str | None = None, keep_identity: bool = False) -> Change:
    """Rows added. Columns that ``rows`` lacks get their default or null; ``also`` adds expressions for all.

    ``unless_exists``: only rows that differ from all of the target's in these columns (null equals null).
    ``identity``: a column numbered on from the target's largest value, without gaps. With ``keep_identity``
    the values that rows bring stay, and rows without one are numbered on from the largest of all.
    """
    for name, v in (also or {}).items():
        rows = rows.withColumn(name, _value(v, name, definition))
    if unless_exists:
        have = target.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(unless_exists)]).distinct()
        on = None
        for i, c in enumerate(unless_exists):
            one = F.col(c).eqNullSafe(F.col(f"_k{i}"))
            on = one if on is None else on & one
        rows = rows.join(have, on, "left_anti")
    if identity:
        start = target.agg(F.coalesce(F.max(identity), F.lit(0))).first()[0]
        if keep_identity:
            rows = snapshot(rows)
            own = rows.where(F.col(identity).isNotNull())
            start = max(start, own.agg(F.coalesce(F.max(identity), F.lit(0))).first()[0])
            rows = own.unionByName(_numbered(rows.where(F.col(identity).isNull()), identity, start))
        else:
            rows = _numbered(rows, identity, start)
    cast = {f.name: f.dataType for f in target.schema}
    new = rows.select(*[(F.col(c) if c in rows.columns else _value(DEFAULT, c, definition)).cast(cast[c]).alias(c) for c in target.columns])
    return Change(target.unionByName(new), inserted=new)


def _numbered(rows: DataFrame, name: str, start: int) -> DataFrame:
    """Consecutive numbers after ``start``: partitions are counted first, so that all are numbered at once.

    The rows are written once, as a source that is read again could come in another order.
    """
    marked = snapshot(rows.drop(name)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each partition
    before, total = [], start
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    offsets = rows.sparkSession.createDataFrame(before, "_p long, _before long")
    out = marked.join(F.broadcast(offsets), part == F.col("_p"))
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_p", "_before")


def snapshot(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the shared folder; they go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return spark.read.schema(df.schema).parquet(path)


def _sides(target: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = target.select(F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("target"), F.monotonically_increasing_id().alias("_row"))
    s = source.select(F.struct(*[F.col(f"`{c}`") for c in source.columns]).alias("source"))
    return t, s


def update(target: DataFrame, assign: dict[str, object], where: Column | None = None, source: DataFrame | None = None, on: Column | None = None, definition: TableDef | None = None, first_match: bool = False) -> Change:
    """Assignments to the rows for which ``where`` is true, or that match ``source`` (columns target.x, source.y)."""
    unknown = set(assign) - set(target.columns)
    if unknown:
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    types = {f.name: f.dataType for f in target.schema}
    if source is None:
        p = F.coalesce(where if where is not None else F.lit(True), F.lit(False))
        new = target.select(*[(F.when(p, _value(assign[c], c, definition)).otherwise(F.col(c)).cast(types[c]).alias(c) if c in assign else F.col(c)) for c in target.columns])
        return Change(new, deleted=target.where(p))
    return _joined(target, source, on, [("UPDATE", where, assign)], [], [], definition, first_match)


def delete(target: DataFrame, where: Column | None = None, source: DataFrame | None = None, on: Column | None = None) -> Change:
    """The rows without those for which ``where`` is true (all, if it is None) or that match ``source``."""
    if source is None:
        p = F.coalesce(where if where is not None else F.lit(True), F.lit(False))
        return Change(target.where(~p), deleted=target.where(p))
    on = on if where is None else on & where
    t, s = target.alias("target"), source.alias("source")
    return Change(t.join(s, on, "left_anti").select("target.*"), deleted=t.join(s, on, "left_semi").select("target.*"))


def _joined(target, source, on, matched, new, alone, definition, first_match) -> Change:
    t, s = _sides(target, source)
    types = {f.name: f.dataType for f in target.schema}
    names = target.columns

    def row(assign, keep: bool) -> Column:
        old = lambda c: F.col("target").getField(c) if keep else _value(DEFAULT, c, definition)
        return F.struct(*[(_value(assign[c], c, definition) if c in assign else old(c)).cast(types[c]).alias(c) for c in names])

    def applied(clauses, keep: bool) -> tuple[Column, Column]:
        """Action and new row: the first clause whose condition holds acts."""
        empty = F.lit(None).cast(kind)
        action, result = F.lit(None).cast("string"), F.col("target") if keep else empty
        for what, when, assign in reversed(clauses):
            p = F.coalesce(when if when is not None else F.lit(True), F.lit(False))
            action = F.when(p, what).otherwise(action)
            result = F.when(p, empty if what == "DELETE" else row(assign, keep)).otherwise(result)
        return action, result

    kind = t.schema["target"].dataType
    if not matched and not alone:  # the target stays as it is, and what it lacks comes besides
        action, row_ = applied(new, False)
        out = s.join(t, on, "left_anti").select(action.alias("_action"), F.lit(None).cast(kind).alias("deleted"), row_.alias("inserted")).where(F.col("_action").isNotNull())
        fresh = out.select(*[F.col("inserted").getField(c).alias(c) for c in names])
        return Change(target.unionByName(fresh), fresh, target.limit(0), out)
    # One join, of both sides in full if new rows are wanted. That no target row is met twice is seen before, over
    # the rows that match only: the whole target isn't shuffled again for it.
    if matched and not first_match:
        twice = t.join(s, on).groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not twice.isEmpty():
            raise ValueError("a row of the target matches several rows of the source")
    pairs = t.join(s, on, "full" if new else "left")
    if first_match or not matched:
        pairs = pairs.withColumn("_row", F.coalesce("_row", -1 - F.monotonically_increasing_id()))
        pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy("source"))).where("_n = 1")
    there, hit = F.col("target").isNotNull(), F.col("target").isNotNull() & F.col("source").isNotNull()
    by_hit, by_target, by_source = applied(matched, True), applied(alone, True), applied(new, False)
    pick = lambda i: F.when(hit, by_hit[i]).when(there, by_target[i]).otherwise(by_source[i])
    out = pairs.select(pick(0).alias("_action"), F.col("target").alias("deleted"), pick(1).alias("inserted"))
    table = out.where(F.col("inserted").isNotNull()).select(*[F.col("inserted").getField(c).alias(c) for c in names])
    touched = out.where(F.col("_action").isNotNull())
    side = lambda name, *actions: touched.where(F.col("_action").isin(*actions)).select(f"{name}.*")
    return Change(table, side("inserted", "INSERT"), side("deleted", "DELETE", "UPDATE"), touched)


@dataclass
class Merge:
    """A merge under construction; clauses of a kind are tried in the order given."""

    target: DataFrame
    source: DataFrame
    on: Column
    definition: TableDef | None = None
    first_match: bool = False
    matched: list = field(default_factory=list)
    new: list = field(default_factory=list)
    alone: list = field(default_factory=list)

    def _add(self, where: list, kind: str, when, assign) -> Merge:
        if unknown := set(assign) - set(self.target.columns):
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        where.append((kind, when, assign))
        return self

    def when_matched_update(self, assign: dict, when: Column | None = None) -> Merge:
        return self._add(self.matched, "UPDATE", when, assign)

    def when_matched_delete(self, when: Column | None = None) -> Merge:
        return self._add(self.matched, "DELETE", when, {})

    def when_not_matched_insert(self, assign: dict, when: Column | None = None) -> Merge:
        return self._add(self.new, "INSERT", when, assign)

    def when_not_matched_insert_defaults(self, keys: dict, when: Column | None = None) -> Merge:
        """Only the keys are given; the rest gets its default."""
        return self._add(self.new, "INSERT", when, keys)

    def when_not_matched_by_source_update(self, assign: dict, when: Column | None = None) -> Merge:
        return self._add(self.alone, "UPDATE", when, assign)

    def when_not_matched_by_source_delete(self, when: Column | None = None) -> Merge:
        return self._add(self.alone, "DELETE", when, {})

    def run(self) -> Change:
        return _joined(self.target, self.source, self.on, self.matched, self.new, self.alone, self.definition, self.first_match)


def merge(target: DataFrame, source: DataFrame, on: Column, definition: TableDef | None = None, first_match: bool = False) -> Merge:
    """Merge ``source`` into ``target``; conditions and values name columns target.x and source.y."""
    return Merge(target, source, on, definition, first_match)


def commit(spark: SparkSession, change: Change | DataFrame, path: str) -> None:
    """Put the new version in the path's place: it is written whole beside it, then names are swapped.

    One writer at a time. There is a moment between the two renames in which the path doesn't exist; if the
    writer dies there, the old version is at path.old. :class:`quarry.operators.store.Store` has no such moment.
    """
    table = change.table if isinstance(change, Change) else change
    new, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    table.write.parquet(new)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(old), True)
    if fs.exists(fs_path(path)):
        fs.rename(fs_path(path), fs_path(old))
    fs.rename(fs_path(new), fs_path(path))
    fs.delete(fs_path(old), True)
