"""Checks and completions of written values, as Column expressions over the new rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querywright.functions.casts import decimal, signed, timestamp
from querywright.functions.json_values import checked
from querywright.model.schema import BINARY_TYPES, DATE_TYPES, INT_TYPES, NUMERIC, STRING, ColumnSpec

#: How a generated name begins; what follows is not checked.
UUID = "urn:uuid:"
PLACES = 9


def new_uuid() -> Column:
    return F.concat(F.lit(UUID), F.uuid())


def default_of(c: ColumnSpec) -> Column:
    """The declared default, or else null where allowed and the type's empty value where not."""
    if c.default is not None:
        return F.lit(c.default).cast(c.spark_type)
    if c.allow_null or c.category in ("date", "time", "year"):
        return F.lit(None).cast(c.spark_type)
    return (F.lit(0) if c.category == NUMERIC else F.lit("")).cast(c.spark_type)


def validated(c: ColumnSpec, x: Column, given: str = STRING) -> Column:
    """``x`` as the column may hold it.

    Numbers are read by their prefix, decimals kept to nine places, dates that are
    none become null, JSON that is none an empty object, names without the prefix of
    generated ones the default.  Nulls stay where allowed and become the default elsewhere.
    """
    if c.validate is not None:
        return c.validate(x)
    if c.type in INT_TYPES:
        out = signed(x, given)
        out = F.greatest(out, F.lit(0)) if c.unsigned else out
    elif c.type in ("float", "double", "decimal"):
        out = F.round(decimal(x, given, 38, PLACES), min(PLACES, c.scale if c.type == "decimal" and c.scale is not None else PLACES))
    elif c.uuid:
        out = F.when(x.cast("string").startswith(UUID), x.cast("string")).otherwise(default_of(c))
    elif c.type in DATE_TYPES:
        out = timestamp(x, given)
    elif c.type == "json":
        out = checked(x.cast("string"))
    elif c.type in BINARY_TYPES:
        out = x
    else:
        out = x.cast("string") if c.category == STRING else x
        out = F.substring(out, 1, c.length) if c.category == STRING and c.length and c.type in ("char", "varchar") else out
    out = out.try_cast(c.spark_type)
    return out if c.allow_null or c.primary else F.coalesce(out, default_of(c))
