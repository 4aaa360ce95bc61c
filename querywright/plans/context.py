"""What builders of predicates need to know: the table, the catalog and the options."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from querywright.functions.casts import cast_to, literal
from querywright.model.schema import STRING, ColumnSpec, TableSpec, cast_category, cast_literal, clean_cast
from querywright.operators.comparison import Comparison, Comparisons
from querywright.sources.catalog import Catalog

log = logging.getLogger("querywright")


class Refused(Exception):
    """A filter that cannot be honoured; its clause matches nothing."""


@dataclass(frozen=True)
class Options:
    """``collation``: 'binary' compares text as it is, 'ci' without regard to case.
    ``now``: the fixed time of NOW() and of relative dates; None takes the clock's."""

    collation: str = "binary"
    now: datetime | None = None
    start_of_week: int = 1
    comparisons: Comparisons = field(default_factory=Comparisons)
    search_columns: Callable[[list[str], str], list[str]] | None = None

    @property
    def fold(self) -> bool:
        return self.collation == "ci"


@dataclass(frozen=True)
class Context:
    catalog: Catalog
    table: TableSpec
    options: Options

    def of(self, table: TableSpec) -> Context:
        return Context(self.catalog, table, self.options)

    def column(self, name: Any) -> ColumnSpec:
        found = self.table.column(name)
        if found is None:
            raise Refused(f"{self.table.name} has no column {name!r}")
        return found

    def warn(self, topic: str, text: str) -> None:
        log.warning("%s: %s", topic, text)

    def expression(self, column: ColumnSpec) -> Column:
        return F.col(column.name)

    def folded(self, x: Column, category: str) -> Column:
        """Text without case where the collation asks for it."""
        return F.lower(x) if self.options.fold and category == STRING else x

    def compare(self, left: Column, category: str, kind: str, op: Comparison, value: Any, binary: bool = False) -> Column | None:
        """A left expression against bare values; None if the value says nothing."""
        fold = self.options.fold and category == STRING and not binary
        if op.pattern:
            check_pattern(value)
        x = F.lower(left) if fold and not op.pattern else left

        def lit(v: Any) -> Column:
            c = literal(v, kind, category)
            return F.lower(c) if fold else c

        return op.apply(x, value, lit, fold)


def check_pattern(value: Any) -> None:
    """Refuse a pattern that the JVM's regular expressions cannot read: it would fail in every task."""
    spark = SparkSession.getActiveSession()
    if spark is None or not isinstance(value, str | int | float):
        return
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(str(value).strip())
    except (IllegalArgumentException, Py4JJavaError) as error:
        raise Refused(f"not a pattern: {value!r}") from error


def requested_cast(column: ColumnSpec, request: Any) -> str | None:
    """The cast target a clause asks for, None for none; a bad one is refused."""
    if request in (None, False, ""):
        return None
    if request is True:
        return column.own_cast
    target = clean_cast(request) if isinstance(request, str) else None
    if target is None:
        raise Refused(f"cast {request!r} is not allowed")
    return target


def typed_column(ctx: Context, column: ColumnSpec, cast: str | None) -> tuple[Column, str, str]:
    """A column's expression, coarse type and literal reading, after an optional cast."""
    x = ctx.expression(column)
    if cast is None:
        return x, column.category, column.literal
    return cast_to(x, cast, column.category), cast_category(cast), cast_literal(cast)


def clauses_of(node: Any) -> tuple[str | None, list[tuple[str | None, Any]]]:
    """The relation and (name, member) pairs of a group.

    Groups are lists (joined by AND), lists that begin with the relation's name, or
    dictionaries with ``relation`` and ``clauses``; ``clauses`` may name its members.
    """
    if isinstance(node, Mapping):
        members = node.get("clauses", [])
        named = list(members.items()) if isinstance(members, Mapping) else [(None, m) for m in members]
        return node.get("relation"), named
    items = list(node)
    if items and isinstance(items[0], str) and items[0].strip().upper() in ("AND", "OR", "XOR"):
        return items[0], [(None, m) for m in items[1:]]
    return None, [(None, m) for m in items]


def is_group(node: Any) -> bool:
    return isinstance(node, list | tuple) or (isinstance(node, Mapping) and "clauses" in node)
