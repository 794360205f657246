"""A fluent way to query trees, checked as they are built."""

from __future__ import annotations

from typing import Any

from quarry import spec as S


def value(x: Any) -> S.Node:
    return x.node if isinstance(x, E) else x if isinstance(x, S.Node) else S.Literal(x)


class E:
    """A value with operators."""

    def __init__(self, node: S.Node):
        self.node = node

    def _bin(op, swap=False):  # noqa: N805
        def f(self, other):
            a, b = value(self), value(other)
            return E(S.Binary(op, b, a) if swap else S.Binary(op, a, b))

        return f

    __add__, __sub__, __mul__, __truediv__, __mod__ = map(_bin, "+-*/%")
    __lt__, __le__, __gt__, __ge__, __eq__, __ne__ = map(_bin, ("<", "<=", ">", ">=", "=", "<>"))
    __and__, __or__ = _bin("AND"), _bin("OR")
    __hash__ = None

    def __invert__(self):
        return E(S.Unary("NOT", self.node))

    def bit_and(self, other):
        return E(S.Binary("&", self.node, value(other)))

    def bit_or(self, other):
        return E(S.Binary("|", self.node, value(other)))

    def bit_xor(self, other):
        return E(S.Binary("^", self.node, value(other)))

    def in_(self, *items):
        if len(items) == 1 and isinstance(items[0], Query):
            return E(S.InQuery(self.node, items[0].node))
        if not items:
            raise ValueError("IN has no items")
        return E(S.In(self.node, tuple(map(value, items))))

    def like(self, pattern, escape=""):
        return E(S.Like(self.node, value(pattern), escape=escape))

    def between(self, low, high):
        return E(S.Between(self.node, value(low), value(high)))

    def is_null(self):
        return E(S.IsNull(self.node))

    def is_not_null(self):
        return E(S.IsNull(self.node, True))

    def cast(self, kind: str):
        return E(S.Cast(self.node, kind))

    def as_(self, alias: str):
        return S.Item(self.node, alias)

    def desc(self):
        return S.Sort(self.node, True)

    def over(self, partition=(), order=(), frame: S.Frame | None = None):
        return E(S.Over(self.node, tuple(map(value, partition)), tuple(x if isinstance(x, S.Sort) else S.Sort(value(x)) for x in order), frame))


def col(name: str, source: str = "") -> E:
    return E(S.Col(name, source))


def lit(x: Any, type: str = "") -> E:
    return E(S.Literal(x, type))


def param(name: str) -> E:
    return E(S.Param(name))


def raw(text: str) -> E:
    return E(S.Raw(text))


def call(name: str, *args, distinct: bool = False) -> E:
    return E(S.Call(name, tuple(map(value, args)), distinct))


def date_add(part: str, n: int, ts) -> E:
    return E(S.DatePart("DATEADD", part, (value(int(n)), value(ts))))


def date_diff(part: str, start, end) -> E:
    return E(S.DatePart("DATEDIFF", part, (value(start), value(end))))


def case(*whens, otherwise) -> E:
    return E(S.Case(tuple(S.When(value(a), value(b)) for a, b in whens), value(otherwise)))


def exists(q: Query) -> E:
    return E(S.Exists(q.node))


def table(name: str, alias: str = "", schema: str = "") -> S.Table:
    return S.Table(name, schema, alias)


class Source:
    """A table under an alias of its own, whose columns are named by it."""

    def __init__(self, node: S.Table):
        self.node = node

    def col(self, name: str) -> E:
        return col(name, self.node.alias)


class Aliases:
    """Numbers sources: the first call gives the alias A0, the next A1, and so on; ``taken`` ones are passed over."""

    def __init__(self, prefix: str = "A", taken: Iterable[str] = ()):
        self.prefix, self.next, self.taken = prefix, 0, {t.lower() for t in taken}

    def __call__(self, name: str, schema: str = "") -> Source:
        while (alias := f"{self.prefix}{self.next}").lower() in self.taken:
            self.next += 1
        self.next += 1
        return Source(S.Table(name, schema, alias))


def values(rows, alias: str, *columns: str) -> S.Values:
    made = tuple(tuple(map(value, r)) for r in rows)
    if not made or any(len(r) != len(columns) for r in made):
        raise ValueError("each row needs a value for each column, and there must be a row")
    return S.Values(made, alias, columns)


class Query:
    """A SELECT or set operation; each call gives a new one."""

    def __init__(self, node: S.Node):
        self.node = node

    def _with(self, **c) -> Query:
        return Query(self.node.with_(**c))

    def from_(self, source) -> Query:
        return self._with(source=getattr(source, "node", source))

    def _join(self, kind, source, on=None) -> Query:
        return self._with(source=S.Join(kind, self.node.source, getattr(source, "node", source), None if on is None else value(on)))

    def inner_join(self, source, on):
        return self._join("INNER", source, on)

    def left_join(self, source, on):
        return self._join("LEFT", source, on)

    def right_join(self, source, on):
        return self._join("RIGHT", source, on)

    def full_join(self, source, on):
        return self._join("FULL", source, on)

    def cross_join(self, source):
        return self._join("CROSS", source)

    def cross_apply(self, source):
        return self._join("CROSS APPLY", source)

    def outer_apply(self, source):
        return self._join("OUTER APPLY", source)

    def where(self, test) -> Query:
        return self if test is None else self._with(where=value(test) if self.node.where is None else S.Binary("AND", self.node.where, value(test)))

    def group_by(self, *by) -> Query:
        return self._with(group=tuple(map(value, by)))

    def order_by(self, *by) -> Query:
        return self._with(order=tuple(x if isinstance(x, S.Sort) else S.Sort(value(x)) for x in by))

    def offset(self, n: int) -> Query:
        return self._with(offset=value(n))

    def offset_fetch(self, offset: int, fetch: int) -> Query:
        return self._with(offset=value(offset), fetch=value(fetch))

    def _set(self, op, other) -> Query:
        return Query(S.SetOp(op, self.node, other.node))

    def union(self, other):
        return self._set("UNION", other)

    def union_all(self, other):
        return self._set("UNION ALL", other)

    def except_(self, other):
        return self._set("EXCEPT", other)

    def intersect(self, other):
        return self._set("INTERSECT", other)

    def as_(self, alias: str, *columns: str) -> S.Derived:
        if columns and isinstance(self.node, S.Select) and len(columns) != len(self.node.items):
            raise ValueError("as many names as columns are needed")
        return S.Derived(self.node, alias, columns)

    def scalar(self) -> E:
        return E(S.Scalar(self.node))

    def sql(self, dialect: str = "spark") -> str:
        from quarry.emit import to_sql

        return to_sql(self.node, dialect)


def _items(items) -> tuple:
    return tuple(x if isinstance(x, (S.Item, S.Star)) else S.Item(value(x)) for x in items)


def select(*items, distinct: bool = False, top: int | None = None) -> Query:
    return Query(S.Select(_items(items), distinct=distinct, top=None if top is None else value(top)))


def with_(query: Query, **ctes: Query) -> Query:
    return Query(S.With(tuple(S.Cte(n, q.node) for n, q in ctes.items()), query.node))
