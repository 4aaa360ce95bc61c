"""Order of rows: sortable columns, expressions, positions in a list, metadata; and null placement."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywright.functions.casts import literal
from querywright.plans.columns import split_value
from querywright.plans.context import Context, Refused
from querywright.plans.meta import Meta, order_clause
from querywright.plans.operands import is_operand, resolve

DIRECTION = re.compile(r"\s*(\w+)?(?:\s+NULLS\s+(FIRST|LAST))?\s*", re.I)


@dataclass(frozen=True)
class Direction:
    ascending: bool
    nulls_first: bool

    def of(self, x: Column) -> Column:
        if self.ascending:
            return x.asc_nulls_first() if self.nulls_first else x.asc_nulls_last()
        return x.desc_nulls_first() if self.nulls_first else x.desc_nulls_last()


def direction(text: Any) -> Direction:
    """ASC, or else DESC; nulls come first ascending and last descending unless the text says."""
    m = DIRECTION.fullmatch(text) if isinstance(text, str) else None
    ascending = bool(m and (m[1] or "").upper() == "ASC")
    return Direction(ascending, m[2].upper() == "FIRST" if m and m[2] else ascending)


def field_position(x: Column, values: list[Column]) -> Column:
    """The place in a list, from 1; 0 for what is not in it."""
    found = F.lit(0)
    for k, v in reversed(list(enumerate(values, start=1))):
        found = F.when(x == v, k).otherwise(found)
    return found


def entries(orderby: Any, order: Any) -> list[tuple[Any, Any]]:
    """(key or operand, direction text) pairs; none for 'none', an empty list or false."""
    if orderby in ("none", False, [], (), {}):
        return []
    if is_operand(orderby):
        return [(orderby, orderby.get("order", order))]
    if isinstance(orderby, Mapping):
        return list(orderby.items())
    if isinstance(orderby, str):
        orderby = [o for o in re.split(r"[,\s]+", orderby.strip()) if o]
    return [(o, o.get("order", order) if isinstance(o, Mapping) else order) for o in orderby]


def order_rows(ctx: Context, df: DataFrame, spec: Mapping[str, Any]) -> tuple[DataFrame, list[Column], list[str]]:
    """(df with helper columns, sort columns, helper names).  What may not be sorted by is left out."""
    keys = ctx.table.primary
    wanted = spec.get("orderby")
    if wanted is None or wanted == "":
        wanted = list(keys)
    found: list[Column] = []
    helpers: list[str] = []
    for key, text in entries(wanted, spec.get("order", "DESC")):
        way = direction(text)
        try:
            if is_operand(key):
                if key["operand"] not in ("column", "func"):
                    raise Refused(f"cannot order by {key['operand']}")
                found.append(way.of(resolve(ctx, key).column))
                continue
            if not isinstance(key, str):
                raise Refused("an order needs names or operands")
            name = key.removesuffix("__in") if key.endswith("__in") else key.removesuffix("_query")
            column = ctx.table.column(key) or ctx.table.column(name)
            if key.endswith("__in") and column is not None and column.in_ and ctx.table.column(key) is None:
                values = split_value(spec.get(key))
                if values:
                    found.append(way.of(field_position(ctx.expression(column), [literal(v, column.literal, column.category) for v in values])))
                continue
            if key.endswith("_query") and column is not None and column.date_query and ctx.table.column(key) is None:
                found.append(way.of(ctx.expression(column)))
                continue
            meta = order_clause(spec, key) if ctx.table.meta else None
            if meta is not None:
                helper = f"_qw_order_{len(helpers)}"
                df = Meta(ctx).ordered(df, meta[0], meta[1], helper)
                helpers.append(helper)
                found.append(way.of(F.col(helper)))
                continue
            if column is None or not column.sortable:
                raise Refused(f"{key!r} is not sortable")
            found.append(way.of(ctx.folded(ctx.expression(column), column.category)))
        except Refused as reason:
            ctx.warn("orderby", str(reason))
    return df, found, helpers
