"""Filters that name columns: equality, membership, search and comparison trees."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from querywright.operators.comparison import is_scalar
from querywright.operators.logic import connective
from querywright.plans.context import Context, Refused, clauses_of, is_group, requested_cast, typed_column
from querywright.plans.operands import compare_operands, is_operand, resolve
from querywright.plans.pred import Expr, Pred, group, never

LONGEST_SPLIT, LAST_FIRST_COMMA = 200, 20


def split_value(value: Any) -> list[Any]:
    """The values that a query variable holds; empty if it says nothing.

    Text with commas is several values only if it is short, its first comma comes
    early and no space stands before it; so sentences stay whole.
    """
    if value is None or (isinstance(value, list | tuple | set) and not value):
        return []
    if isinstance(value, list | tuple | set):
        return [v for v in value if is_scalar(v)]
    if isinstance(value, str):
        first = value.find(",")
        if 0 <= first < LAST_FIRST_COMMA and len(value) <= LONGEST_SPLIT and " " not in value[:first]:
            return re.split(r",\s*", value)
        return [value]
    return [value] if is_scalar(value) else []


def _member(ctx: Context, name: str, value: Any, op: tuple[str, str]) -> Pred | None:
    values = split_value(value)
    if not values:
        return None
    column = ctx.table.column(name)
    one, many = op
    comparison = ctx.options.comparisons.named_or_equal(one if len(values) == 1 else many)
    found = ctx.compare(ctx.expression(column), column.category, column.literal, comparison, values[0] if len(values) == 1 else values)
    return None if found is None else Expr(found)


def by_filters(ctx: Context, spec: Mapping[str, Any]) -> Pred | None:
    """``{column: value}``: equal to a value, or in several."""
    return group("AND", [_member(ctx, n, spec[n], ("=", "IN")) for n in spec if ctx.table.column(n)])


def _suffixed(ctx: Context, spec: Mapping[str, Any], suffix: str, flag: str) -> list[tuple[str, Any]]:
    found = []
    for key, value in spec.items():
        if key.endswith(suffix) and (column := ctx.table.column(key.removesuffix(suffix))) and getattr(column, flag):
            found.append((column.name, value))
    return found


def in_filters(ctx: Context, spec: Mapping[str, Any]) -> Pred | None:
    """``{column}__in`` and ``in_query``."""
    pairs = _suffixed(ctx, spec, "__in", "in_") + [(k, v) for k, v in (spec.get("in_query") or {}).items() if (c := ctx.table.column(k)) and c.in_]
    return group("AND", [_member(ctx, n, v, ("=", "IN")) for n, v in pairs])


def not_in_filters(ctx: Context, spec: Mapping[str, Any]) -> Pred | None:
    """``{column}__not_in`` and ``not_in_query``; rows with a null there never pass."""
    pairs = _suffixed(ctx, spec, "__not_in", "not_in") + [(k, v) for k, v in (spec.get("not_in_query") or {}).items() if (c := ctx.table.column(k)) and c.not_in]
    return group("AND", [_member(ctx, n, v, ("!=", "NOT IN")) for n, v in pairs])


def escape_like(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def search_filter(ctx: Context, spec: Mapping[str, Any]) -> Pred | None:
    """``search`` over searchable columns, any of them; ``*`` inside the term is a wildcard."""
    term = spec.get("search")
    if not is_scalar(term) or not str(term).strip():
        return None
    able = [c.name for c in ctx.table.columns if c.searchable]
    wanted = spec.get("search_columns")
    if wanted:
        chosen = [wanted] if isinstance(wanted, str) else list(wanted)
        able = [n for n in able if n in chosen] or able
    if ctx.options.search_columns:
        able = [n for n in ctx.options.search_columns(able, str(term)) if ctx.table.column(n)]
    if not able:
        return None
    pattern = "%" + "%".join(escape_like(p) for p in str(term).strip().strip("*").split("*")) + "%"
    pattern = pattern.lower() if ctx.options.fold else pattern

    def like(name: str) -> Column:
        x = F.col(name).cast("string")
        return (F.lower(x) if ctx.options.fold else x).like(pattern)

    return group("OR", [Expr(like(n)) for n in able])


def compare_clause(ctx: Context, clause: Mapping[str, Any]) -> Pred | None:
    """One ``{key, value, compare, cast}``; what cannot be resolved matches nothing.

    A value that says nothing for its operator drops the clause.
    """
    if "key" not in clause:
        return None
    ops = ctx.options.comparisons
    value = clause.get("value")
    name = clause.get("compare") or ("IN" if isinstance(value, list | tuple) else "=")
    op = ops.named_or_equal(name)
    if "value" not in clause and not op.unary:
        return None
    try:
        if is_operand(clause["key"]):
            left = resolve(ctx, clause["key"])
            if op.unary:
                if left.width != 1 or not left.left:
                    raise Refused("a test for null needs one expression")
                return Expr(op.apply(left.column, None, F.lit, False))
            if is_operand(value):
                return Expr(compare_operands(ctx, left, op, resolve(ctx, value)))
            if left.width != 1 or not left.left:
                raise Refused("a plain value needs one expression on the left")
            found = ctx.compare(left.column, left.category, left.literal, op, value)
        else:
            column = ctx.column(clause["key"])
            cast = requested_cast(column, clause.get("cast"))
            x, category, reading = typed_column(ctx, column, cast)
            if is_operand(value):
                left = resolve(ctx, {"operand": "column", "name": column.name, "cast": cast})
                return Expr(compare_operands(ctx, left, op, resolve(ctx, value)))
            found = ctx.compare(x, category, reading, op, value, binary=cast == "BINARY")
    except Refused as reason:
        ctx.warn("compare", str(reason))
        return never()
    return None if found is None else Expr(found)


def compare_tree(ctx: Context, node: Any) -> Pred | None:
    """A clause, or a group of clauses and groups joined by AND, OR or XOR."""
    if isinstance(node, Mapping) and "key" in node:
        return compare_clause(ctx, node)
    if not is_group(node):
        return None
    relation, members = clauses_of(node)
    return group(connective(relation), [compare_tree(ctx, m) for _, m in members if isinstance(m, Mapping | list | tuple)])


def compare_filters(ctx: Context, spec: Mapping[str, Any]) -> Pred | None:
    """``compare_query`` and the ``{column}_compare`` shorthands, all of which apply."""
    found = [compare_tree(ctx, spec["compare_query"])] if spec.get("compare_query") else []
    for key, value in spec.items():
        if not key.endswith("_compare"):
            continue
        column = ctx.table.column(key.removesuffix("_compare"))
        if column is None or not column.compare or value is None:
            continue
        clause = dict(value) if isinstance(value, Mapping) and not is_operand(value) else {"value": value}
        found.append(compare_clause(ctx, clause | {"key": column.name}))
    return group("AND", found)
