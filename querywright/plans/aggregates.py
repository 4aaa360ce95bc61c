"""Aggregates: named results over the matched rows, by groups, filtered and ordered by group."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywright.functions.casts import float_prefix, text_of
from querywright.model.schema import NAME
from querywright.operators.comparison import is_scalar
from querywright.plans.context import Context
from querywright.plans.ordering import direction, entries

FUNCTIONS = ("SUM", "AVG", "MAX", "MIN", "COUNT")


@dataclass(frozen=True)
class Aggregate:
    alias: str
    function: str
    column: str
    distinct: bool = False

    def expression(self) -> Column:
        if self.function == "COUNT":
            return (F.countDistinct(self.column) if self.distinct else F.count(F.lit(1) if self.column == "*" else self.column)).alias(self.alias)
        return {"SUM": F.sum, "AVG": F.avg, "MAX": F.max, "MIN": F.min}[self.function](self.column).alias(self.alias)


def canonical(ctx: Context, container: Any) -> list[Aggregate]:
    """The usable entries of an aggregate container, in order; others are left out with a warning.

    Entries are ``{alias: [function, column]}``, ``{alias: {function, column, distinct}}``
    or ``{function: column}``.
    """
    found: dict[str, Aggregate] = {}
    if not isinstance(container, Mapping):
        return []
    for alias, entry in container.items():
        if isinstance(entry, Mapping):
            fn, column, distinct = entry.get("function"), entry.get("column"), bool(entry.get("distinct"))
        elif isinstance(entry, list | tuple):
            fn, column, distinct = (*entry, None, None)[0], (*entry, None, None)[1], bool(len(entry) > 2 and entry[2])
        else:
            fn, column, distinct = alias, entry, False
        fn = fn.upper() if isinstance(fn, str) else ""
        spec = ctx.table.column(column)
        star = fn == "COUNT" and column == "*"
        if fn not in FUNCTIONS:
            ctx.warn("aggregate", f"{alias}: no function {fn!r}")
        elif not isinstance(alias, str) or not NAME.fullmatch(alias) or alias in found:
            ctx.warn("aggregate", f"{alias}: not a usable name")
        elif spec is None and not star:
            ctx.warn("aggregate", f"{alias}: no column {column!r}")
        elif fn in ("SUM", "AVG") and not spec.is_numeric:
            ctx.warn("aggregate", f"{alias}: {fn} needs a numeric column")
        elif distinct and (fn != "COUNT" or star):
            ctx.warn("aggregate", f"{alias}: DISTINCT goes with COUNT of a column only")
        else:
            found[alias] = Aggregate(alias, fn, "*" if star else spec.name, distinct)
    return list(found.values())


def group_columns(ctx: Context, groupby: Any) -> list[str]:
    """Known group columns, once each; unknown ones are left out."""
    names = [groupby] if isinstance(groupby, str) else list(groupby or [])
    names = [n.strip() for part in names if isinstance(part, str) for n in part.split(",")]
    return list(dict.fromkeys(c.name for n in names if (c := ctx.table.column(n))))


def run(ctx: Context, df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """One row, or one for each group; without a usable aggregate, no row."""
    wanted = canonical(ctx, spec.get("aggregate"))
    groups = group_columns(ctx, spec.get("groupby"))
    for a in [a for a in wanted if a.alias in groups]:
        ctx.warn("aggregate", f"{a.alias}: is a group column")
        wanted.remove(a)
    if not wanted:
        return df.select(*groups).limit(0)
    measures = [a.expression() for a in wanted]
    if not groups:
        return df.agg(*measures)
    out = df.groupBy(*groups).agg(*measures)
    out = having(ctx, out, spec.get("having"), {a.alias: a for a in wanted})
    return ordered(ctx, out, spec, [*groups, *(a.alias for a in wanted)])


def having(ctx: Context, out: DataFrame, conditions: Any, aggregates: Mapping[str, Aggregate]) -> DataFrame:
    """Rows whose aggregates meet all conditions; only the six scalar comparisons count."""
    if not isinstance(conditions, Mapping):
        return out
    for alias, entry in conditions.items():
        if isinstance(entry, Mapping):
            name, value = entry.get("compare"), entry.get("value")
        elif isinstance(entry, list | tuple) and len(entry) > 1:
            name, value = entry[0], entry[1]
        else:
            name = value = None
        op = ctx.options.comparisons.get(name)
        if alias not in aggregates or op is None or not op.expression or not is_scalar(value):
            ctx.warn("having", f"{alias}: not a usable condition")
            continue
        a = aggregates[alias]
        column = ctx.table.column(a.column)
        numeric = a.function in ("SUM", "AVG", "COUNT") or column.is_numeric
        out = out.filter(op.pair(F.col(alias), F.lit(float_prefix(value) if numeric else text_of(value))))
    return out


def ordered(ctx: Context, out: DataFrame, spec: Mapping[str, Any], able: list[str]) -> DataFrame:
    """By group columns and results; there is no order unless one is asked for."""
    wanted = spec.get("orderby")
    if not wanted:
        return out
    keys = []
    for key, text in entries(wanted, spec.get("order", "DESC")):
        if key in able:
            keys.append(direction(text).of(F.col(key)))
        else:
            ctx.warn("aggregate", f"cannot order groups by {key!r}")
    return out.orderBy(*keys) if keys else out
