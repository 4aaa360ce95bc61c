"""The 19 comparison operators and their registry.

An operator turns a left expression and bare values into a boolean Column, or into
None when the value says nothing (an empty list, a range with one end): callers
decide whether such a clause is dropped or matches nothing.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Literal = Callable[[Any], Column]
_SCALAR = (str, int, float, bool)


def is_scalar(value: Any) -> bool:
    return isinstance(value, _SCALAR) or (value is not None and hasattr(value, "isoformat"))


def trimmed(value: Any) -> Any:
    return value.strip() if isinstance(value, str) else value


def as_list(value: Any) -> list[Any]:
    """A list as it is; text is split at commas and white space; other scalars alone."""
    if isinstance(value, str):
        return [v for v in re.split(r"[,\s]+", value.strip()) if v]
    if isinstance(value, list | tuple | set | frozenset):
        return [trimmed(v) for v in value if is_scalar(v)]
    return [value] if is_scalar(value) else []


@dataclass(frozen=True)
class Comparison:
    """One operator: its traits and how it compares a left expression with bare values."""

    name: str
    apply: Callable[[Column, Any, Literal, bool], Column | None]
    opposite: str = ""
    negative: bool = False
    expression: bool = False
    numeric: bool = False
    many: bool = False
    ranged: bool = False
    pattern: bool = False
    unary: bool = False
    pair: Callable[[Column, Column], Column] | None = None


def _binary(op: Callable[[Column, Column], Column]):
    def apply(left: Column, value: Any, lit: Literal, fold: bool) -> Column | None:
        value = trimmed(value[0] if isinstance(value, list | tuple) and value else value)
        return op(left, lit(value)) if is_scalar(value) else None

    return apply


def _listed(negate: bool):
    def apply(left: Column, value: Any, lit: Literal, fold: bool) -> Column | None:
        values = as_list(value)
        if not values:
            return None
        found = left == lit(values[0]) if len(values) == 1 else left.isin(*[lit(v) for v in values])
        return ~found if negate else found

    return apply


def _between(negate: bool):
    def apply(left: Column, value: Any, lit: Literal, fold: bool) -> Column | None:
        values = as_list(value)
        if len(values) < 2:
            return None
        found = left.between(lit(values[0]), lit(values[1]))
        return ~found if negate else found

    return apply


def _like(negate: bool):
    def apply(left: Column, value: Any, lit: Literal, fold: bool) -> Column | None:
        if not is_scalar(value):
            return None
        found = left.cast("string").contains(F.lit(str(trimmed(value)).lower() if fold else str(trimmed(value))))
        return ~found if negate else found

    return apply


def _regexp(negate: bool):
    def apply(left: Column, value: Any, lit: Literal, fold: bool) -> Column | None:
        if not is_scalar(value):
            return None
        found = left.cast("string").rlike(("(?i)" if fold else "") + str(trimmed(value)))
        return ~found if negate else found

    return apply


_EQ: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _expression(name: str, opposite: str, **traits) -> Comparison:
    return Comparison(name, _binary(_EQ[name]), opposite, expression=True, pair=_EQ[name], **traits)


STANDARD: tuple[Comparison, ...] = (
    _expression("=", "!="),
    _expression("!=", "=", negative=True),
    _expression("<", ">=", numeric=True),
    _expression("<=", ">", numeric=True),
    _expression(">", "<=", numeric=True),
    _expression(">=", "<", numeric=True),
    Comparison("IN", _listed(False), "NOT IN", many=True),
    Comparison("NOT IN", _listed(True), "IN", negative=True, many=True),
    Comparison("BETWEEN", _between(False), "NOT BETWEEN", numeric=True, ranged=True),
    Comparison("NOT BETWEEN", _between(True), "BETWEEN", negative=True, numeric=True, ranged=True),
    Comparison("LIKE", _like(False), "NOT LIKE"),
    Comparison("NOT LIKE", _like(True), "LIKE", negative=True),
    Comparison("REGEXP", _regexp(False), "NOT REGEXP", pattern=True),
    Comparison("NOT REGEXP", _regexp(True), "REGEXP", negative=True, pattern=True),
    Comparison("RLIKE", _regexp(False), pattern=True),
    Comparison("EXISTS", _binary(_EQ["="]), "NOT EXISTS"),
    Comparison("NOT EXISTS", lambda left, value, lit, fold: None, "EXISTS", negative=True),
    Comparison("IS NULL", lambda left, value, lit, fold: left.isNull(), "IS NOT NULL", unary=True),
    Comparison("IS NOT NULL", lambda left, value, lit, fold: left.isNotNull(), "IS NULL", unary=True),
)


@dataclass(frozen=True)
class Comparisons:
    """Operators by name; ``with_operator`` gives a registry with one more."""

    by_name: dict[str, Comparison] = field(default_factory=lambda: {c.name: c for c in STANDARD})

    def get(self, name: Any) -> Comparison | None:
        return self.by_name.get(re.sub(r"\s+", " ", name.strip()).upper()) if isinstance(name, str) else None

    def named_or_equal(self, name: Any) -> Comparison:
        return self.get(name) or self.by_name["="]

    def with_operator(self, operator: Comparison) -> Comparisons:
        return Comparisons(self.by_name | {operator.name.upper(): operator})

    def names(self, **traits: bool) -> list[str]:
        return [c.name for c in self.by_name.values() if all(getattr(c, k) == v for k, v in traits.items())]


def any_of(columns: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, columns)


def all_of(columns: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, columns)
