"""The 24 allowed scalar functions, the week rules and date-format translation."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from querywright.functions.casts import timestamp
from querywright.model.schema import DATE, FLOAT_LITERAL, INTEGER_LITERAL, NUMERIC, STRING, TEXT_LITERAL, TIME, YEAR

ANY = (NUMERIC, STRING, DATE, TIME, YEAR)
DATED = (DATE, STRING)
TIMED = (DATE, TIME, STRING)
PLAIN = ("column", "func", "value")
DATELIKE = ("column", "func", "math")


@dataclass(frozen=True)
class Function:
    """An allowed function: how many arguments of which kinds it takes, and what it gives.

    ``build`` gets (expression, category) pairs; ``literal`` None means that the
    result's reading follows the arguments.
    """

    build: Callable[[Sequence[tuple[Column, str]], datetime | None], Column]
    least: int
    most: int | None
    accepts: tuple[str, ...] = ANY
    literal: str | None = TEXT_LITERAL
    category: str = STRING
    kinds: tuple[tuple[str, ...], ...] = (PLAIN,)

    def kinds_at(self, position: int) -> tuple[str, ...]:
        return self.kinds[min(position, len(self.kinds) - 1)]


def week_sunday(ts: Column) -> Column:
    """Week of the year, weeks from Sunday, days before the first Sunday in week 0."""
    return F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7).cast("int")


def week_monday(ts: Column) -> Column:
    """Week of the year, weeks from Monday; week 1 is the first with four days or more."""
    first = F.weekday(F.trunc(ts, "year"))
    return (F.floor((F.dayofyear(ts) - 1 + first) / 7) + F.when(first <= 3, 1).otherwise(0)).cast("int")


def week(ts: Column, mode: int) -> Column:
    if mode not in (0, 1):
        raise ValueError(f"week mode {mode} is not supported")
    return week_monday(ts) if mode else week_sunday(ts)


def start_of_week(ts: Column, start: int) -> Column:
    """Week number where weeks begin on ``start`` (0 Sunday .. 6 Saturday)."""
    if start in (0, 1):
        return week(ts, start)
    return week_sunday(F.date_sub(ts.cast("date"), start))


#: Format letters that Java's date patterns have a counterpart for.
JAVA = {
    "Y": "yyyy",
    "y": "yy",
    "m": "MM",
    "c": "M",
    "d": "dd",
    "e": "d",
    "H": "HH",
    "k": "H",
    "h": "hh",
    "I": "hh",
    "l": "h",
    "i": "mm",
    "s": "ss",
    "S": "ss",
    "f": "SSSSSS",
    "p": "a",
    "M": "MMMM",
    "b": "MMM",
    "W": "EEEE",
    "a": "EEE",
    "j": "DDD",
    "T": "HH:mm:ss",
    "r": "hh:mm:ss a",
}


def format_date(ts: Column, pattern: str) -> Column:
    """A percent-letter format; letters without meaning stand for themselves."""
    parts: list[Column] = []
    i = 0
    while i < len(pattern):
        if pattern[i] != "%" or i + 1 == len(pattern):
            j = pattern.find("%", i + 1)
            j = len(pattern) if j < 0 else j
            parts.append(F.lit(pattern[i:j]))
            i = j
            continue
        letter = pattern[i + 1]
        i += 2
        if letter in JAVA:
            parts.append(F.date_format(ts, JAVA[letter]))
        elif letter == "w":
            parts.append((F.dayofweek(ts) - 1).cast("string"))
        elif letter in "Uu":
            parts.append(F.lpad(week(ts, int(letter == "u")).cast("string"), 2, "0"))
        elif letter == "D":
            day = F.dayofmonth(ts)
            end = F.when((day % 100).between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
            parts.append(F.concat(day.cast("string"), end))
        else:
            parts.append(F.lit(letter))
    return F.when(ts.isNull(), None).otherwise(F.concat(*parts) if parts else F.lit(""))


def unless_null(build: Callable[..., Column], args: Sequence[Column]) -> Column:
    """Null as soon as an argument is null, where Spark's own function skips nulls."""
    missing = functools.reduce(lambda a, b: a | b, [a.isNull() for a in args])
    return F.when(missing, None).otherwise(build(*args))


def _text(fn: Callable[[Column], Column]):
    return lambda args, now: fn(args[0][0].cast("string"))


def _dated(fn: Callable[[Column], Column]):
    return lambda args, now: fn(timestamp(*args[0]))


def _clocked(fn: Callable[[Column], Column]):
    def build(args, now):
        x, category = args[0]
        # A bare time of day is read on any date.
        return fn((F.concat(F.lit("1970-01-01 "), x)).try_cast("timestamp_ntz") if category == TIME else timestamp(x, category))

    return build


def _shifted(sign: int):
    def build(args, now):
        ts, span = timestamp(*args[0]), args[1][0]
        # Null where the sum is no date.
        return F.try_add(ts, span) if sign > 0 else F.try_subtract(ts, span)

    return build


def _number(fn: Callable[[Column], Column], accepts=DATED, build=_dated) -> Function:
    return Function(build(fn), 1, 1, accepts, INTEGER_LITERAL, NUMERIC)


def _same(args) -> list[Column]:
    """Arguments in one type: numbers and dates stay when all are, otherwise text."""
    categories = {c for _, c in args}
    return [x for x, _ in args] if len(categories) == 1 else [x.cast("string") for x, _ in args]


FUNCTIONS: dict[str, Function] = {
    "LOWER": Function(_text(F.lower), 1, 1),
    "UPPER": Function(_text(F.upper), 1, 1),
    "LENGTH": Function(_text(F.octet_length), 1, 1, ANY, INTEGER_LITERAL, NUMERIC),
    "ABS": Function(lambda a, n: F.abs(a[0][0]), 1, 1, (NUMERIC,), FLOAT_LITERAL, NUMERIC),
    "DATE": Function(lambda a, n: timestamp(*a[0]).cast("date"), 1, 1, DATED, TEXT_LITERAL, DATE),
    "YEAR": _number(F.year),
    "MONTH": _number(F.month),
    "DAYOFMONTH": _number(F.dayofmonth),
    "DAYOFYEAR": _number(F.dayofyear),
    "DAYOFWEEK": _number(F.dayofweek),
    "HOUR": _number(F.hour, TIMED, _clocked),
    "MINUTE": _number(F.minute, TIMED, _clocked),
    "SECOND": _number(F.second, TIMED, _clocked),
    "COALESCE": Function(lambda a, n: F.coalesce(*_same(a)), 2, None, literal=None),
    "WEEKDAY": _number(F.weekday),
    "WEEK": Function(lambda a, n: week_by_mode(timestamp(*a[0]), a[1][0]), 2, 2, DATED, INTEGER_LITERAL, NUMERIC, (PLAIN, ("value",))),
    "DATE_FORMAT": Function(lambda a, n: format_date(timestamp(*a[0]), a[1][0]), 2, 2, DATED, TEXT_LITERAL, STRING, (PLAIN, ("value",))),
    "NOW": Function(lambda a, n: F.lit(n).cast("timestamp_ntz") if n else F.localtimestamp(), 0, 0, category=DATE),
    "DATE_SUB": Function(_shifted(-1), 2, 2, DATED, TEXT_LITERAL, DATE, (DATELIKE, ("interval",))),
    "DATE_ADD": Function(_shifted(1), 2, 2, DATED, TEXT_LITERAL, DATE, (DATELIKE, ("interval",))),
    "GREATEST": Function(lambda a, n: unless_null(F.greatest, _same(a)), 2, None, literal=None),
    "LEAST": Function(lambda a, n: unless_null(F.least, _same(a)), 2, None, literal=None),
    "CONCAT": Function(lambda a, n: F.concat(*[x.cast("string") for x, _ in a]), 2, None),
    "CONCAT_WS": Function(lambda a, n: concat_ws([x.cast("string") for x, _ in a]), 2, None),
}


def week_by_mode(ts: Column, mode: int) -> Column:
    return week(ts, mode)


def concat_ws(args: list[Column]) -> Column:
    """Joined by the first argument; null arguments are skipped, a null separator gives null."""
    return F.call_function("concat_ws", *args)
