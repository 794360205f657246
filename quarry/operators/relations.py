"""The graph of foreign keys: navigation, paths, and joins along them."""

from __future__ import annotations

import enum
from collections import deque
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame

from quarry.operators.tables import ColumnDef, TableDef
from quarry.session import tasks_for, too_few


class Ambiguity(enum.Enum):
    """What to do where several shortest paths lead to a table."""

    FIRST = "first"
    FAIL = "fail"


class RelationGraph:
    """Tables as nodes, foreign keys as edges; a table may refer to itself but no cycle spans tables."""

    def __init__(self, tables: Iterable[TableDef]):
        self.tables = {t.name: t for t in tables}
        self.up: dict[str, dict[str, list[tuple[str, str]]]] = {n: {} for n in self.tables}
        for t in self.tables.values():
            for c in t.columns:
                for parent, column in c.references:
                    if parent not in self.tables:
                        raise ValueError(f"{t.name}.{c.name} refers to {parent}, which isn't there")
                    self.up[t.name].setdefault(parent, []).append((c.name, column))
        self.hierarchy()

    def references(self, table: str, itself: bool = False) -> list[str]:
        return [p for p in self.up[table] if itself or p != table]

    def referenced_by(self, table: str, itself: bool = False) -> list[str]:
        return [t for t in self.tables if table in self.up[t] and (itself or t != table)]

    def _all(self, table: str, step: Callable[[str], list[str]]) -> list[str]:
        out, todo = [], deque(step(table))
        while todo:
            t = todo.popleft()
            if t not in out:
                out.append(t)
                todo.extend(step(t))
        return out

    def all_references(self, table: str) -> list[str]:
        return self._all(table, self.references)

    def all_referenced_by(self, table: str) -> list[str]:
        return self._all(table, self.referenced_by)

    def hierarchy(self) -> list[list[str]]:
        """Layers: each table comes after all that it refers to."""
        left, out = dict.fromkeys(self.tables), []
        while left:
            layer = [t for t in left if not any(p in left for p in self.references(t))]
            if not layer:
                raise ValueError(f"foreign keys go round in a circle among {', '.join(left)}")
            out.append(layer)
            for t in layer:
                del left[t]
        return out

    def paths(self, start: str, end: str) -> list[list[str]]:
        """All shortest ways from one table to another, over foreign keys in either direction."""
        best: list[list[str]] = []
        todo = deque([[start]])
        while todo:
            way = todo.popleft()
            if best and len(way) > len(best[0]):
                break
            if way[-1] == end:
                best.append(way)
                continue
            todo.extend([*way, n] for n in [*self.references(way[-1]), *self.referenced_by(way[-1])] if n not in way)
        return best

    def path(self, start: str, end: str, policy: Ambiguity | Callable[[list[list[str]]], int] = Ambiguity.FIRST) -> list[str]:
        found = self.paths(start, end)
        if not found:
            raise ValueError(f"no foreign keys lead from {start} to {end}")
        if len(found) == 1 or policy is Ambiguity.FIRST:
            return found[0]
        if policy is Ambiguity.FAIL:
            raise ValueError(f"{len(found)} ways lead from {start} to {end}: {found}")
        return found[policy(found)]

    def _pairs(self, left: str, right: str) -> list[tuple[str, str]]:
        return self.up[left][right] if right in self.up[left] else [(y, x) for x, y in self.up[right][left]]

    def _on(self, a: DataFrame, b: DataFrame, left: str, right: str):
        return reduce(lambda p, q: p & q, [a[x] == b[y] for x, y in self._pairs(left, right)])

    def _dealt(self, out: DataFrame, a: DataFrame, b: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
        """Both sides in a task for each 16 MB of files, where the session would make larger ones.

        Else the engine deals them out, and may split hot keys. Sides that can be broadcast are left alone.
        """
        parts = tasks_for(out, b)
        if not too_few(out.sparkSession, parts) or min(tasks_for(out, each=10 << 20), tasks_for(b, each=10 << 20)) <= 1:
            return out, b
        keys = self._pairs(left, right)
        return out.repartition(parts, *[a[x] for x, _ in keys]), b.repartition(parts, *[b[y] for _, y in keys])

    def join(self, wanted: list[str], frame: Callable[[str], DataFrame], via: Iterable[str] = (), how: str = "inner", policy=Ambiguity.FIRST) -> DataFrame:
        """The tables joined along foreign keys, each next one to the nearest that is already in.

        ``via`` names tables that the way to the second one has to pass, in order. The plan is a tree of
        equi-joins; the optimizer orders and executes it, in tasks whose size doesn't follow the tables'.
        """
        frames = {wanted[0]: frame(wanted[0])}
        out = frames[wanted[0]]

        def follow(way):
            nonlocal out
            for a, b in zip(way, way[1:], strict=False):
                if b not in frames:
                    frames[b] = frame(b)
                    some, other = self._dealt(out, frames[a], frames[b], a, b)
                    out = some.join(other, self._on(frames[a], frames[b], a, b), how)

        stops = [wanted[0], *via, *wanted[1:2]]
        for a, b in zip(stops, stops[1:], strict=False):
            follow(self.path(a, b, policy))
        pending = list(wanted[2:])
        while pending:
            ways = [self.path(have, want, policy) for want in pending for have in frames if self.paths(have, want)]
            if not ways:
                raise ValueError(f"no foreign keys lead to {', '.join(pending)}")
            way = min(ways, key=len)
            follow(way)
            pending.remove(way[-1])
        return out


_KEYS = {
    "nation": {"n_regionkey": ("region", "r_regionkey")}, "supplier": {"s_nationkey": ("nation", "n_nationkey")}, "customer": {"c_nationkey": ("nation", "n_nationkey")},
    "orders": {"o_custkey": ("customer", "c_custkey")}, "lineitem": {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")},
}


def driver_graph(t) -> RelationGraph:
    """The graph of the driver's tables."""
    out = []
    for name in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem"):
        keys = _KEYS.get(name, {})
        fields = getattr(t, name).schema
        out.append(TableDef(name, tuple(ColumnDef(f.name, f.dataType.simpleString(), True, references=(keys[f.name],) if f.name in keys else ()) for f in fields)))
    return RelationGraph(out)
