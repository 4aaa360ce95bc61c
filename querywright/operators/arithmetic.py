"""Arithmetic over two or more operands; a division by zero is null."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
}


def compute(sign: str, parts: Sequence[Column]) -> Column:
    return functools.reduce(ARITHMETIC[sign], parts)
