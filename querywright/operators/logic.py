"""Logical operators over boolean Columns, null-propagating as SQL has them."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column

CONNECTIVES: dict[str, Callable[[Column, Column], Column]] = {
    "AND": lambda a, b: a & b,
    "OR": lambda a, b: a | b,
    # Of several operands: true if an odd number of them is.
    "XOR": lambda a, b: a != b,
}


def connective(name: object) -> str:
    """AND, OR or XOR; anything else is AND."""
    upper = name.strip().upper() if isinstance(name, str) else ""
    return upper if upper in CONNECTIVES else "AND"


def combine(name: str, parts: Sequence[Column], negate: bool = False) -> Column | None:
    """The parts joined left to right; None for none."""
    if not parts:
        return None
    whole = functools.reduce(CONNECTIVES[name], parts)
    return ~whole if negate else whole
