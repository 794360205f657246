"""Portable scalar functions as Column expressions, with one meaning on every source.

Only built-in expressions are used, so that they stay within generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = {
    "year": "YEAR", "yy": "YEAR", "yyyy": "YEAR", "month": "MONTH", "mm": "MONTH", "m": "MONTH", "day": "DAY", "dd": "DAY", "d": "DAY",
    "week": "WEEK", "wk": "WEEK", "ww": "WEEK", "hour": "HOUR", "hh": "HOUR", "minute": "MINUTE", "mi": "MINUTE", "n": "MINUTE",
    "second": "SECOND", "ss": "SECOND", "s": "SECOND", "millisecond": "MILLISECOND", "ms": "MILLISECOND",
}


def part_name(part: str) -> str:
    """The full name of a date part or its alias."""
    try:
        return PARTS[part.lower()]
    except KeyError:
        raise ValueError(f"unknown date part {part!r}") from None


def int_div(a: Column, b: Column) -> Column:
    """Quotient of integers, cut towards zero; null where the divisor is 0."""
    return F.when(b != 0, (a - F.try_mod(a, b)) / b).cast("long")


def date_add(part: str, n: int, ts: Column) -> Column:
    """``ts`` and ``n`` parts more; a day beyond the month's end becomes its last."""
    name = part_name(part)
    return F.timestamp_add(name, F.lit(int(n)), ts)


def date_diff(part: str, start: Column, end: Column) -> Column:
    """How many boundaries of the part lie between the two (not how many whole units)."""
    name = part_name(part)
    if name == "WEEK":
        raise ValueError("weeks can be added but not counted")
    years = F.year(end) - F.year(start)
    if name == "YEAR":
        return years.cast("long")
    if name == "MONTH":
        return (years * 12 + F.month(end) - F.month(start)).cast("long")
    days = F.datediff(end, start).cast("long")
    if name == "DAY":
        return days
    hours = days * 24 + F.hour(end) - F.hour(start)
    if name == "HOUR":
        return hours
    minutes = hours * 60 + F.minute(end) - F.minute(start)
    if name == "MINUTE":
        return minutes
    seconds = minutes * 60 + F.second(end) - F.second(start)
    if name == "SECOND":
        return seconds
    milli = lambda c: F.floor((F.date_part(F.lit("second"), c) % 1) * 1000).cast("long")
    return seconds * 1000 + milli(end) - milli(start)


def _adds(part: str):
    def add(ts: Column, n: int) -> Column:
        return date_add(part, n, ts)

    return add


def _diffs(part: str):
    def diff(start: Column, end: Column) -> Column:
        return date_diff(part, start, end)

    return diff


add_years, add_months, add_days, add_hours, add_minutes, add_seconds = map(_adds, ("year", "month", "day", "hour", "minute", "second"))
diff_years, diff_months, diff_days, diff_hours, diff_minutes, diff_seconds = map(_diffs, ("year", "month", "day", "hour", "minute", "second"))


def typed(value, kind: str) -> Column:
    """A literal of a given type."""
    return F.lit(value).cast(kind)


def text_len(v: Column, trailing: bool = True) -> Column:
    """Characters; with ``trailing`` false, blanks at the end don't count."""
    return F.char_length(v if trailing else F.rtrim(v))


def data_length(v: Column) -> Column:
    """Bytes in UTF-8."""
    return F.octet_length(v)


def index_of(search: Column | str, value: Column) -> Column:
    """1-based place of ``search`` in ``value``; 0 if it isn't there."""
    return F.locate(search, value) if isinstance(search, str) else F.position(search, value)


def concat_text(*parts: Column) -> Column:
    """The parts one after the other; null counts as empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def like_classes(v: Column, pattern: str) -> Column:
    """LIKE with character classes: [a-c], [^x], and [%] for a plain percent sign."""
    return v.rlike(like_regex(pattern))


def like_regex(pattern: str, escape: str | None = None) -> str:
    """An anchored regular expression for a LIKE pattern with classes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(_quoted(pattern[i]))
        elif c == "%":
            out.append("(?s:.*)")
        elif c == "_":
            out.append("(?s:.)")
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i + 1 : end]
            negated = body.startswith("^")
            body = body[1:] if negated else body
            out.append("[" + "^" * negated + "".join("\\" + x if x in "\\[]^&" else x for x in body) + "]")
            i = end
        else:
            out.append(_quoted(c))
        i += 1
    return "^" + "".join(out) + "$"


def _quoted(c: str) -> str:
    return "\\" + c if c in r"\.^$|?*+()[]{}" else c


def left(v: Column, n: int) -> Column:
    return F.substring(v, 1, n) if n > 0 else F.when(v.isNotNull(), F.lit(""))


def right(v: Column, n: int) -> Column:
    return F.right(v, F.lit(n)) if n > 0 else F.when(v.isNotNull(), F.lit(""))


def utc_now() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def distinct_count_over(v: Column, window) -> Column:
    """COUNT(DISTINCT v) OVER (PARTITION BY ...), which has no direct form: ranks from both ends, less one, less the nulls'."""
    ranks = F.dense_rank().over(window.orderBy(v.asc())) + F.dense_rank().over(window.orderBy(v.desc()))
    return (ranks - 1 - F.max(F.when(v.isNull(), 1).otherwise(0)).over(window)).cast("long")


#: Portable functions by name: the number of arguments and how they are made.
PORTABLE = {
    "LOWER": (1, F.lower), "UPPER": (1, F.upper), "TRIM": (1, F.trim), "LTRIM": (1, F.ltrim), "RTRIM": (1, F.rtrim),
    "REPLACE": (3, F.replace), "SUBSTRING": (3, F.substring), "LEN": (1, text_len), "DATALENGTH": (1, data_length),
    "INDEXOF": (2, index_of), "LEFT": (2, lambda v, n: F.left(v, n)), "RIGHT": (2, lambda v, n: F.right(v, n)), "REPEAT": (2, F.repeat),
    "ABS": (1, F.abs), "ROUND": (2, F.round), "FLOOR": (1, F.floor), "CEILING": (1, F.ceil), "ISNULL": (2, F.coalesce), "NULLIF": (2, F.nullif),
    "YEAR": (1, F.year), "MONTH": (1, F.month), "DAY": (1, F.day), "HOUR": (1, F.hour), "MINUTE": (1, F.minute), "SECOND": (1, F.second),
}


def portable(name: str, *args) -> Column:
    """Call a portable function; the number of arguments is checked here, not when the query runs."""
    n, f = PORTABLE[name.upper()]
    if len(args) != n:
        raise ValueError(f"{name} takes {n} arguments, not {len(args)}")
    return f(*args)
