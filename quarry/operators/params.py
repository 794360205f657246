"""Named parameters: scalars are bound, lists expand inside IN only, and no value becomes SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PART = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/|@([A-Za-z_]\w*)", re.S)
_IN = re.compile(r"\bIN\s*\(\s*$", re.I)


def bind(sql: str, values: dict) -> tuple[str, dict]:
    """SQL with :markers, and the value of each; missing, unused and empty-list parameters are errors."""
    used, args, out, end = set(), {}, [], 0
    by_name = {k.lower(): v for k, v in values.items()}
    if len(by_name) < len(values):
        raise ValueError("parameter names differ in case only")
    for m in _PART.finditer(sql):
        out.append(sql[end : m.start()])
        end = m.end()
        if not m[1]:
            out.append(m[0])
            continue
        name = m[1].lower()
        if name not in by_name:
            raise ValueError(f"no value for the parameter @{m[1]}")
        used.add(name)
        value = by_name[name]
        if isinstance(value, (list, tuple, set, frozenset)):
            if not _IN.search(sql[: m.start()]):
                raise ValueError(f"@{m[1]} is a list, which stands in IN ( ) only")
            if not value:
                raise ValueError(f"@{m[1]} is an empty list")
            names = [f"{name}_{i}" for i in range(len(value))]
            args |= dict(zip(names, value, strict=True))
            out.append(", ".join(":" + n for n in names))
        else:
            args[name] = value
            out.append(":" + name)
    if spare := set(by_name) - used:
        raise ValueError(f"no such parameter: {', '.join(sorted(spare))}")
    return "".join([*out, sql[end:]]), args


def sql_with_params(spark: SparkSession, sql: str, values: dict, **frames: DataFrame) -> DataFrame:
    """Run SQL with @parameters; {name} stands for a DataFrame."""
    text, args = bind(sql, values)
    return spark.sql(text, args, **frames)
