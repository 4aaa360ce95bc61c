"""Date queries: bounds, calendar parts and times of day."""

from __future__ import annotations

import calendar
import re
from collections.abc import Mapping
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from querywright.functions.casts import float_prefix, timestamp, whole_or
from querywright.functions.scalar import start_of_week
from querywright.operators.comparison import all_of
from querywright.operators.logic import connective
from querywright.plans.columns import compare_clause
from querywright.plans.context import Context, clauses_of, is_group
from querywright.plans.operands import is_operand
from querywright.plans.pred import Expr, Pred, group, never

PARTS = ("year", "month", "monthnum", "week", "w", "dayofyear", "day", "dayofweek", "dayofweek_iso", "hour", "minute", "second")
KEYS = {"after", "before", "value", *PARTS}
INHERITED = ("column", "compare", "inclusive", "start_of_week")
ISO = re.compile(r"(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[ T](\d{2}):(\d{2})(?::(\d{2}))?)?)?)?")
RELATIVE = re.compile(r"([+-]?\s*\d+)\s*(second|sec|minute|min|hour|day|week|fortnight|month|year)s?(\s+ago)?", re.I)


def shift_months(at: datetime, months: int) -> datetime:
    """Months later, days that overflow running on into the next month."""
    index = at.year * 12 + at.month - 1 + months
    return at.replace(year=index // 12, month=index % 12 + 1, day=1) + timedelta(days=at.day - 1)


def relative_date(text: str, now: datetime) -> datetime | None:
    """now, today, midnight, noon, yesterday, tomorrow, and offsets such as ``-30 days`` or ``2 weeks ago``."""
    words = text.strip().lower()
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    fixed = {"now": now, "today": midnight, "midnight": midnight, "noon": midnight + timedelta(hours=12), "yesterday": midnight - timedelta(days=1), "tomorrow": midnight + timedelta(days=1)}
    if words in fixed:
        return fixed[words]
    at, rest = now, words
    for name in fixed:
        if words.startswith(name + " "):
            at, rest = fixed[name], words[len(name) :].strip()
    if RELATIVE.sub("", rest).strip():
        return None
    found = list(RELATIVE.finditer(rest))
    if not found:
        return None
    for m in found:
        n, unit = int(m[1].replace(" ", "")) * (-1 if m[3] else 1), m[2].lower()
        if unit in ("month", "year"):
            at = shift_months(at, n * (12 if unit == "year" else 1))
        else:
            at += n * timedelta(seconds={"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 604800, "fortnight": 1209600}[unit])
    return at


def parse_date(value: Any, to_end: bool, now: datetime | None) -> datetime | None:
    """A date literal; a partial one is the first or the last second of its period.

    Taken are ISO text down to any unit, a dictionary of parts (the year defaults to
    the present one), seconds since 1970, and relative text.  Other text is None.
    """
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        value = value.isoformat()
    if isinstance(value, bool):
        return None
    if isinstance(value, int | float):
        return datetime(1970, 1, 1) + timedelta(seconds=int(value))
    now = now or datetime.now()
    if isinstance(value, str):
        m = ISO.fullmatch(value.strip())
        if not m:
            return relative_date(value, now)
        names = ("year", "month", "day", "hour", "minute", "second")
        value = {n: g for n, g in zip(names, m.groups(), strict=True) if g is not None}
    if not isinstance(value, Mapping):
        return None
    part = {k: int(float_prefix(v)) for k, v in value.items()}
    year = part.get("year", now.year)
    month = part.get("month", 12 if to_end else 1)
    try:
        day = part.get("day", calendar.monthrange(year, month)[1] if to_end else 1)
        return datetime(year, month, day, part.get("hour", 23 if to_end else 0), part.get("minute", 59 if to_end else 0), part.get("second", 59 if to_end else 0))
    except (ValueError, calendar.IllegalMonthError):
        return None


def numbers(value: Any, many: bool) -> list[int]:
    """The numeric values of a part: all for list and range operators, else the first."""
    values = value if isinstance(value, list | tuple) else [value]
    kept = [int(float(v)) for v in values if not isinstance(v, bool) and isinstance(v, int | float | str) and re.fullmatch(r"\s*[-+]?\d+(\.\d+)?\s*", str(v))]
    return kept if many else kept[:1]


#: The values that parts of a date can have.
RANGES = {"year": (0, 9999), "month": (1, 12), "monthnum": (1, 12), "week": (0, 53), "w": (0, 53), "dayofyear": (1, 366), "day": (1, 31), "dayofweek": (1, 7), "dayofweek_iso": (1, 7), "hour": (0, 23), "minute": (0, 59), "second": (0, 59)}


def part_errors(clause: Mapping[str, Any]) -> list[str]:
    """What no date can be: parts out of range or no numbers, and a day that its month (of its year) lacks.

    The week and day of a given year are held against that year's own.
    """
    found = []
    for side in ("after", "before"):
        if isinstance(clause.get(side), Mapping):
            found += [f"{side}: {e}" for e in part_errors(clause[side])]
    years = numbers(clause.get("year"), False)
    year = years[0] if years and 1 <= years[0] <= 9999 else None
    for part, (least, most) in RANGES.items():
        given = clause.get(part)
        if given is None:
            continue
        if year and part == "dayofyear":
            most = 366 if calendar.isleap(year) else 365
        if year and part in ("week", "w"):
            most = date(year, 12, 28).isocalendar().week
        values = list(given) if isinstance(given, list | tuple) else [given]
        told = numbers(values, True)
        if len(told) < len(values) or any(not least <= n <= most for n in told):
            found.append(f"{part}: {given!r}")
    day, month = numbers(clause.get("day"), False), numbers(clause.get("month", clause.get("monthnum")), False)
    if not found and day and month and day[0] > calendar.monthrange(year or 2012, month[0])[1]:
        found.append(f"day: {month[0]}-{day[0]}")
    return found


def part_columns(ts: Column, start: int) -> dict[str, Column]:
    weeks = start_of_week(ts, start)
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "monthnum": F.month(ts),
        "week": weeks,
        "w": weeks,
        "dayofyear": F.dayofyear(ts),
        "day": F.dayofmonth(ts),
        "dayofweek": F.dayofweek(ts),
        "dayofweek_iso": F.weekday(ts) + 1,
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "second": F.second(ts),
    }


def time_of_day(ctx: Context, ts: Column, clause: Mapping[str, Any], op: Any, start: int) -> list[Column]:
    """Hour, minute and second.

    Alone, or under a list or range operator, each unit is compared by itself.
    Together under a scalar operator they are compared as one text HH.MMSS; hour and
    second without a minute say nothing.
    """
    many = op.many or op.ranged
    parts = part_columns(ts, start)
    given = {u: numbers(clause[u], many) for u in ("hour", "minute", "second") if clause.get(u) is not None}
    given = {u: v for u, v in given.items() if v}
    if not given:
        return []
    if many or len(given) == 1:
        found = [op.apply(parts[u], v if many else v[0], F.lit, False) for u, v in given.items()]
        return [f for f in found if f is not None]
    if "minute" not in given:
        return []
    hour, minute = given.get("hour"), given["minute"][0]
    second = given.get("second")
    pattern = ("HH" if hour else "'0'") + ".mm" + ("ss" if second else "")
    text = f"{hour[0]:02d}" if hour else "0"
    text += f".{minute:02d}" + (f"{second[0]:02d}" if second else "")
    found = op.apply(F.date_format(ts, pattern.replace(".", "'.'", 1).replace("''", "")), text, F.lit, False)
    return [found] if found is not None else []


def date_clause(ctx: Context, clause: Mapping[str, Any], default: str | None) -> Pred | None:
    name = clause.get("column") or default
    if name is None:
        return None
    column = ctx.table.column(name)
    if column is None or (column.category != "date" and not column.date_query):
        ctx.warn("date", f"{name!r} cannot be date-queried")
        return never()
    ts = timestamp(ctx.expression(column), column.category)
    for error in part_errors(clause):
        ctx.warn("date", f"{error} is in no date")
    ops = ctx.options.comparisons
    now, found = ctx.options.now, []
    closed = bool(clause.get("inclusive"))
    for key, sign in (("after", ">"), ("before", "<")):
        if clause.get(key) in (None, ""):
            continue
        # The far end of a partial date lies after it exclusively, or before it inclusively.
        to_end = closed if key == "before" else not closed
        at = parse_date(clause[key], to_end, now)
        if at is None:
            return never()
        edge = F.lit(at).cast("timestamp_ntz")
        found.append({">": ts >= edge if closed else ts > edge, "<": ts <= edge if closed else ts < edge}[sign])
    if "value" in clause or ops.named_or_equal(clause.get("compare")).unary:
        whole = whole_column(ctx, column.name, clause)
        if whole is None:
            return never()
        found.append(whole)
    default_op = "IN" if any(isinstance(clause.get(p), list | tuple) for p in PARTS) else "="
    op = ops.named_or_equal(clause.get("compare") or default_op)
    if not op.unary and "value" not in clause:
        many = op.many or op.ranged
        start = whole_or(clause.get("start_of_week"), ctx.options.start_of_week) % 7
        columns = part_columns(ts, start)
        for part in PARTS:
            if part in ("hour", "minute", "second") or clause.get(part) is None or (part == "monthnum" and clause.get("month") is not None) or (part == "w" and clause.get("week") is not None):
                continue
            values = numbers(clause[part], many)
            if not values:
                continue
            here = op.apply(columns[part], values if many else values[0], F.lit, False)
            if here is None:
                return never()
            found.append(here)
        found += time_of_day(ctx, ts, clause, op, start)
    return Expr(all_of(found)) if found else None


def whole_column(ctx: Context, name: str, clause: Mapping[str, Any]) -> Column | None:
    """``value`` and ``compare`` over the column itself; None for a value that says nothing."""
    value = clause.get("value")
    if not is_operand(value) and isinstance(value, str):
        at = parse_date(value, False, ctx.options.now)
        value = at.strftime("%Y-%m-%d %H:%M:%S") if at else value
    told = compare_clause(ctx, {"key": name, "compare": clause.get("compare"), "value": value})
    return told.column if isinstance(told, Expr) else None


def date_tree(ctx: Context, node: Any, default: str | None, above: Mapping[str, Any]) -> Pred | None:
    if isinstance(node, Mapping):
        above = dict(above) | {k: node[k] for k in INHERITED if k in node}
        if not is_group(node):
            first_order = KEYS & node.keys() or ctx.options.comparisons.named_or_equal(node.get("compare")).unary
            return date_clause(ctx, dict(above) | dict(node), default) if first_order else None
    if not isinstance(node, Mapping | list | tuple):
        return None
    relation, members = clauses_of(node)
    return group(connective(relation), [date_tree(ctx, m, default, above) for _, m in members if isinstance(m, Mapping | list | tuple)])


def date_filters(ctx: Context, spec: Mapping[str, Any]) -> Pred | None:
    """``date_query`` over the first date column unless it names one, and ``{column}_query``."""
    able = [c.name for c in ctx.table.columns if c.date_query]
    found: list[Pred | None] = []
    if spec.get("date_query"):
        found.append(date_tree(ctx, spec["date_query"], able[0] if able else None, {}))
    for key, value in spec.items():
        if key.endswith("_query") and (c := ctx.table.column(key.removesuffix("_query"))) and c.date_query and value:
            found.append(date_tree(ctx, value, c.name, {}))
    return group("AND", found)
