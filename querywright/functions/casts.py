"""Casts and literals that never raise: text is read by its numeric prefix, bad dates are null."""

from __future__ import annotations

import math
import re
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from querywright.model.schema import DATE, FLOAT_LITERAL, INTEGER_LITERAL, NUMERIC, STRING, TIME

_INT_PREFIX = re.compile(r"\s*([-+]?\d+)")
_FLOAT_PREFIX = re.compile(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")


def signed(x: Column, category: str) -> Column:
    """A long: text by its leading digits (0 if it has none), numbers rounded, dates as digits."""
    if category == NUMERIC:
        # Through a decimal that holds every long exactly and 18 places of a fraction.
        return F.round(x.try_cast("decimal(38,18)"), 0).try_cast("bigint")
    if category == DATE:
        return F.date_format(x, "yyyyMMdd").try_cast("bigint")
    text = x.cast("string")
    digits = F.regexp_extract(text, r"^\s*([-+]?\d+)", 1)
    return F.when(text.isNull(), None).otherwise(F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint")))


def decimal(x: Column, category: str, precision: int = 10, scale: int = 0) -> Column:
    """A decimal: text by its numeric prefix, 0 if it has none."""
    kind = f"decimal({min(precision, 38)},{min(scale, 38)})"
    if category == NUMERIC:
        return x.try_cast(kind)
    text = x.cast("string")
    digits = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1)
    return F.when(text.isNull(), None).otherwise(F.coalesce(digits.try_cast(kind), F.lit(0).cast(kind)))


def timestamp(x: Column, category: str) -> Column:
    """A timestamp without zone; text that is no date is null."""
    return x.cast("timestamp_ntz") if category == DATE else x.cast("string").try_cast("timestamp_ntz")


def to_date(x: Column, category: str) -> Column:
    return x.cast("date") if category == DATE else x.cast("string").try_cast("date")


def clock(x: Column, category: str) -> Column:
    """The time of day as HH:MM:SS text."""
    text = x.cast("string")
    seen = F.date_format(timestamp(x, category), "HH:mm:ss")
    return seen if category == DATE else F.coalesce(F.when(text.rlike(r"^\d{1,3}:\d{2}(:\d{2})?$"), text), seen)


def cast_to(x: Column, target: str, category: str) -> Column:
    """An allowed cast (see ``model.schema.clean_cast``) of an expression of a coarse type."""
    name, _, rest = target.partition("(")
    sizes = [int(n) for n in re.findall(r"\d+", rest)]
    if name == "SIGNED":
        return signed(x, category)
    if name == "UNSIGNED":
        whole = signed(x, category).cast("decimal(20,0)")
        return F.when(whole < 0, whole + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(whole)
    if name == "DECIMAL":
        return decimal(x, category, *(sizes or [10, 0]))
    if name == "DATE":
        return to_date(x, category)
    if name == "DATETIME":
        return timestamp(x, category)
    if name == "TIME":
        return clock(x, category)
    text = x.cast("string")
    return F.substring(text, 1, sizes[0]) if sizes else text


def int_prefix(value: Any) -> int:
    """A literal read as an integer: '12abc' is 12, 'abc' is 0."""
    if isinstance(value, bool | int):
        return int(value)
    if isinstance(value, float):
        return int(value) if math.isfinite(value) else 0
    m = _INT_PREFIX.match(str(value))
    return int(m[1]) if m else 0


def float_prefix(value: Any) -> float:
    if isinstance(value, bool | int | float):
        try:
            return float(value)
        except OverflowError:
            return math.copysign(math.inf, value)
    m = _FLOAT_PREFIX.match(str(value))
    return float(m[1]) if m else 0.0


def whole_or(value: Any, default: int) -> int:
    """A setting read as a whole number; ``default`` for what is none."""
    if isinstance(value, bool) or value is None or not isinstance(value, int | float | str):
        return default
    return int_prefix(value) if isinstance(value, str) and _INT_PREFIX.match(value) or isinstance(value, int | float) else default


def whole(value: Any) -> Column:
    """A literal whole number of any size: a long, a decimal beyond 64 bits, a double beyond 38 digits."""
    n = int_prefix(value)
    if -(1 << 63) <= n < 1 << 63:
        return F.lit(n)
    if abs(n) < 10**38:
        return F.lit(str(n)).cast("decimal(38,0)")
    return F.lit(float_prefix(str(n)))


def text_of(value: Any) -> str:
    """A literal as text: true is '1', false is empty, whole floats lose their point."""
    if isinstance(value, bool):
        return "1" if value else ""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return str(value)


def literal(value: Any, kind: str, category: str = STRING) -> Column:
    """A bare value as the literal that a comparison with ``category`` needs.

    ``kind`` says how the dialect would read it; text beside a date is read as a date
    (null if it is none), text beside a number as a number.
    """
    if kind == INTEGER_LITERAL:
        return whole(value)
    if kind == FLOAT_LITERAL:
        return F.lit(float_prefix(value))
    if category == DATE:
        if isinstance(value, datetime | date):
            return F.lit(value).cast("timestamp_ntz")
        return F.lit(text_of(value)).try_cast("timestamp_ntz")
    if category == NUMERIC:
        return F.lit(float_prefix(value))
    if category == TIME:
        return F.lit(text_of(value))
    return F.lit(text_of(value))
