"""Queries as immutable trees: built in Python or parsed from text, walked, rewritten, compared and stored."""

from __future__ import annotations

import dataclasses
import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Node:
    """A part of a query. Fields hold values, nodes or tuples of these."""

    def children(self) -> Iterator[Node]:
        for f in dataclasses.fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        """This node and all below it."""
        yield self
        for x in self.children():
            yield from x.walk()

    def walk_with_parent(self, parent: Node | None = None) -> Iterator[tuple[Node, Node | None]]:
        yield self, parent
        for x in self.children():
            yield from x.walk_with_parent(self)

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((x for x in self.walk() if test(x)), None)

    def transform(self, f: Callable[[Node], Node | None]) -> Node | None:
        """Rewritten from the leaves up; None removes a node from a list or an optional place."""
        changed = {}
        for x in dataclasses.fields(self):
            old = getattr(self, x.name)
            new = _mapped(old, f)
            if new is not old:
                changed[x.name] = new
        return f(dataclasses.replace(self, **changed) if changed else self)

    def with_(self, **changes: Any) -> Node:
        return dataclasses.replace(self, **changes)


class Visitor:
    """Hooks for kinds of nodes: enter_<kind> before a node's parts, leave_<kind> after them, names in lower case.

    An enter hook that gives False keeps the visit out of the node's parts; ``parents`` holds the way to a node.
    """

    parents: tuple[Node, ...] = ()

    def visit(self, node: Node) -> None:
        kind = type(node).__name__.lower()
        enter, leave = (getattr(self, f"{what}_{kind}", getattr(self, what, None)) for what in ("enter", "leave"))
        if enter is None or enter(node) is not False:
            around, self.parents = self.parents, (*self.parents, node)
            for x in node.children():
                self.visit(x)
            self.parents = around
        if leave is not None:
            leave(node)


def _nodes(v: Any) -> Iterator[Node]:
    if isinstance(v, Node):
        yield v
    elif isinstance(v, tuple):
        for x in v:
            yield from _nodes(x)


def _mapped(v: Any, f) -> Any:
    if isinstance(v, Node):
        return v.transform(f)
    if not isinstance(v, tuple) or not any(True for _ in _nodes(v)):
        return v
    new = []
    for x in v:
        y = _mapped(x, f)
        if y is not None or not isinstance(x, Node):
            new.append(y)
    return v if len(v) == len(new) and all(a is b for a, b in zip(v, new, strict=True)) else tuple(new)


# Values


@dataclass(frozen=True)
class Literal(Node):
    value: Any
    type: str = ""


@dataclass(frozen=True)
class Param(Node):
    name: str


@dataclass(frozen=True)
class Col(Node):
    name: str
    source: str = ""


@dataclass(frozen=True)
class Star(Node):
    source: str = ""


@dataclass(frozen=True)
class Unary(Node):
    op: str
    value: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple = ()
    distinct: bool = False


@dataclass(frozen=True)
class DatePart(Node):
    """DATEADD and DATEDIFF."""

    function: str
    part: str
    args: tuple = ()


@dataclass(frozen=True)
class Frame(Node):
    start: str
    end: str = "CURRENT ROW"


@dataclass(frozen=True)
class Over(Node):
    call: Call
    partition: tuple = ()
    order: tuple = ()
    frame: Frame | None = None


@dataclass(frozen=True)
class Case(Node):
    whens: tuple
    otherwise: Node | None = None


@dataclass(frozen=True)
class When(Node):
    test: Node
    value: Node


@dataclass(frozen=True)
class Cast(Node):
    value: Node
    type: str
    quiet: bool = False


@dataclass(frozen=True)
class In(Node):
    value: Node
    items: tuple
    negated: bool = False


@dataclass(frozen=True)
class InQuery(Node):
    value: Node
    query: Node
    negated: bool = False


@dataclass(frozen=True)
class Exists(Node):
    query: Node


@dataclass(frozen=True)
class Like(Node):
    value: Node
    pattern: Node
    negated: bool = False
    escape: str = ""


@dataclass(frozen=True)
class Between(Node):
    value: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Node):
    value: Node
    negated: bool = False


@dataclass(frozen=True)
class Scalar(Node):
    query: Node


@dataclass(frozen=True)
class Raw(Node):
    """SQL as it is; never made from data."""

    text: str


# Relations


@dataclass(frozen=True)
class Item(Node):
    value: Node
    alias: str = ""


@dataclass(frozen=True)
class Sort(Node):
    value: Node
    descending: bool = False


@dataclass(frozen=True)
class Table(Node):
    name: str
    schema: str = ""
    alias: str = ""


@dataclass(frozen=True)
class Derived(Node):
    query: Node
    alias: str
    columns: tuple = ()


@dataclass(frozen=True)
class Values(Node):
    rows: tuple
    alias: str
    columns: tuple = ()


@dataclass(frozen=True)
class TableCall(Node):
    call: Call
    alias: str
    columns: tuple = ()


@dataclass(frozen=True)
class Join(Node):
    kind: str
    left: Node
    right: Node
    on: Node | None = None


@dataclass(frozen=True)
class Select(Node):
    items: tuple
    source: Node | None = None
    where: Node | None = None
    group: tuple = ()
    order: tuple = ()
    top: Node | None = None
    offset: Node | None = None
    fetch: Node | None = None
    distinct: bool = False


@dataclass(frozen=True)
class SetOp(Node):
    op: str
    left: Node
    right: Node
    order: tuple = ()
    offset: Node | None = None
    fetch: Node | None = None


@dataclass(frozen=True)
class Cte(Node):
    name: str
    query: Node
    columns: tuple = ()


@dataclass(frozen=True)
class With(Node):
    ctes: tuple
    query: Node


# Changes


@dataclass(frozen=True)
class Assign(Node):
    column: str
    value: Node | None


@dataclass(frozen=True)
class Insert(Node):
    target: Table
    columns: tuple
    source: Node
    output: tuple = ()


@dataclass(frozen=True)
class Update(Node):
    target: Table
    assigns: tuple
    source: Node | None = None
    where: Node | None = None


@dataclass(frozen=True)
class Delete(Node):
    target: Table
    source: Node | None = None
    where: Node | None = None
    output: tuple = ()


@dataclass(frozen=True)
class MergeClause(Node):
    kind: str
    action: str
    when: Node | None = None
    assigns: tuple = ()


@dataclass(frozen=True)
class Merge(Node):
    target: Table
    source: Node
    on: Node
    clauses: tuple = ()


KINDS = {k.__name__: k for k in list(globals().values()) if isinstance(k, type) and issubclass(k, Node)}


# Storing


def to_plain(node: Node) -> list[tuple]:
    """Rows (id, parent, place, index, kind, value): a kind with its node's name, or a value as JSON."""
    out: list[tuple] = []

    def put(v: Any, parent: int | None, place: str, index: int | None) -> None:
        me = len(out)
        if isinstance(v, Node):
            out.append((me, parent, place, index, type(v).__name__, None))
            for f in dataclasses.fields(v):
                x = getattr(v, f.name)
                if isinstance(x, tuple):
                    for i, y in enumerate(x):
                        put(y, me, f.name, i)
                elif x is not None and x != f.default:
                    put(x, me, f.name, None)
        elif isinstance(v, tuple):
            out.append((me, parent, place, index, "()", None))
            for i, y in enumerate(v):
                put(y, me, "", i)
        else:
            out.append((me, parent, place, index, "", json.dumps(v)))

    put(node, None, "", None)
    return out


def from_plain(rows: list[tuple]) -> Node:
    below: dict = {}
    for r in sorted(rows):
        below.setdefault(r[1], []).append(r)

    def get(r: tuple) -> Any:
        me, _, _, _, kind, value = r
        kids = below.get(me, [])
        if kind == "":
            return json.loads(value)
        if kind == "()":
            return tuple(get(k) for k in kids)
        args: dict = {}
        for k in kids:
            if k[3] is None:
                args[k[2]] = get(k)
            else:
                args[k[2]] = (*args.get(k[2], ()), get(k))
        made = KINDS[kind]
        for f in dataclasses.fields(made):
            if f.name not in args and f.default is dataclasses.MISSING:
                args[f.name] = None if f.name in ("value", "source", "where") else ()
        return made(**args)

    return get(below[None][0])


def to_json(node: Node) -> str:
    return json.dumps(to_plain(node))


def from_json(text: str) -> Node:
    return from_plain([tuple(r) for r in json.loads(text)])


def to_xml(node: Node) -> str:
    root = ET.Element("spec")
    for me, parent, place, index, kind, value in to_plain(node):
        have = {"id": me, "parent": parent, "place": place, "index": index, "kind": kind, "value": value}
        ET.SubElement(root, "n", {k: str(v) for k, v in have.items() if v is not None})
    return ET.tostring(root, encoding="unicode")


def from_xml(text: str) -> Node:
    number = lambda x: None if x is None else int(x)
    return from_plain([(int(n.get("id")), number(n.get("parent")), n.get("place"), number(n.get("index")), n.get("kind"), n.get("value")) for n in ET.fromstring(text)])


def flatten(source: Node) -> tuple[list[Node], Node | None]:
    """The sources of a tree of inner and cross joins, and all their conditions as one; other joins are an error."""
    if not isinstance(source, Join):
        return [source], None
    if source.kind not in ("INNER", "CROSS"):
        raise ValueError(f"a {source.kind} join can't be flattened")
    left, p = flatten(source.left)
    right, q = flatten(source.right)
    parts = [x for x in (p, q, source.on) if x is not None]
    test = parts[0] if parts else None
    for x in parts[1:]:
        test = Binary("AND", test, x)
    return [*left, *right], test


def tables(node: Node) -> dict[str, set[str]]:
    """Physical tables that a tree names, each with the columns that are surely its own."""
    ctes = {x.name.lower() for x in node.walk() if isinstance(x, Cte)}
    found = [x for x in node.walk() if isinstance(x, Table) and x.name.lower() not in ctes]
    out: dict[str, set[str]] = {x.name: set() for x in found}
    owner = {(x.alias or x.name).lower(): x.name for x in found}
    for x in node.walk():
        if isinstance(x, Col) and (x.source.lower() in owner or not x.source and len(out) == 1):
            out[owner[x.source.lower()] if x.source else found[0].name].add(x.name)
    return out
