"""JSON columns: decoded on read, checked on write."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(x: Column, kind: str = "map<string,string>") -> Column:
    """JSON text as a Spark type; text that is no such JSON gives its empty value."""
    empty = F.from_json(F.lit("{}"), kind)
    return F.coalesce(F.from_json(x, kind), empty)


def read_json(text: str | None) -> Any:
    """Collected JSON text as Python values: null stays, text that is no JSON is an empty list."""
    if text is None or not isinstance(text, str):
        return text
    try:
        return json.loads(text)
    except ValueError:
        return []


def checked(x: Column) -> Column:
    """JSON text as it is; anything else becomes an empty object."""
    return F.when(F.try_parse_json(x).isNotNull(), x).otherwise(F.when(x.isNull(), None).otherwise(F.lit("{}")))
