"""Typed, frozen descriptions of tables.

A column's flags are the query grammar: they decide which filters, orders and
writes a specification may name.  Types use the names of the SQL dialect that
tables are declared in; ``spark_type`` maps them to Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

INT_TYPES = ("tinyint", "smallint", "mediumint", "int", "bigint")
FLOAT_TYPES = ("float", "double", "decimal")
TEXT_TYPES = ("char", "varchar", "tinytext", "text", "mediumtext", "longtext")
BINARY_TYPES = ("binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob")
DATE_TYPES = ("date", "datetime", "timestamp")
SPATIAL_TYPES = ("geometry", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection")
TYPES = (*INT_TYPES, *FLOAT_TYPES, *TEXT_TYPES, *BINARY_TYPES, *DATE_TYPES, *SPATIAL_TYPES, "time", "year", "json", "bit", "bool")

NUMERIC, STRING, DATE, TIME, YEAR = "numeric", "string", "date", "time", "year"
INTEGER_LITERAL, FLOAT_LITERAL, TEXT_LITERAL = "integer", "float", "text"

CAST_TARGET = re.compile(r"(BINARY|DATE|DATETIME|TIME|SIGNED|UNSIGNED|CHAR(?:\(\d+\))?|DECIMAL(?:\(\d+(?:,\s*\d+)?\))?)", re.I)
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def clean_cast(target: str) -> str | None:
    """An allowed cast target in upper case without spaces, or None."""
    squeezed = re.sub(r"\s+", "", target).upper()
    return squeezed if CAST_TARGET.fullmatch(squeezed) else None


def cast_category(target: str) -> str:
    """The coarse type that a cast yields."""
    name = target.split("(")[0]
    if name in ("SIGNED", "UNSIGNED", "DECIMAL"):
        return NUMERIC
    return {"DATE": DATE, "DATETIME": DATE, "TIME": TIME}.get(name, STRING)


def cast_literal(target: str) -> str:
    """How a bare literal is read beside a cast: integers beside SIGNED, else text."""
    return INTEGER_LITERAL if target == "SIGNED" else TEXT_LITERAL


@dataclass(frozen=True)
class ColumnSpec:
    """One column: its type and what queries and writes may do with it."""

    name: str
    type: str = "varchar"
    length: int | None = None
    scale: int | None = None
    unsigned: bool = False
    allow_null: bool = False
    default: Any = None
    extra: str = ""
    primary: bool = False
    unique: bool = False
    index: bool = False
    sortable: bool = False
    searchable: bool = False
    date_query: bool = False
    in_: bool = True
    not_in: bool = True
    compare: bool = False
    cache_key: bool = False
    transition: bool = False
    created: bool = False
    modified: bool = False
    uuid: bool = False
    current_timestamp: bool = False
    aliases: tuple[str, ...] = ()
    caps: tuple[tuple[str, str], ...] = ()
    json: str = ""  # the Spark type that queries decode a json column to
    cast: Callable | None = None
    validate: Callable | None = None
    intercept: Callable | None = None

    @property
    def category(self) -> str:
        if self.type in INT_TYPES or self.type in FLOAT_TYPES or self.type in ("bit", "bool"):
            return NUMERIC
        return {"date": DATE, "datetime": DATE, "timestamp": DATE, "time": TIME, "year": YEAR}.get(self.type, STRING)

    @property
    def literal(self) -> str:
        """How a bare literal compared with the column is read."""
        return INTEGER_LITERAL if self.type in INT_TYPES else FLOAT_LITERAL if self.type in FLOAT_TYPES else TEXT_LITERAL

    @property
    def is_numeric(self) -> bool:
        return self.category == NUMERIC

    @property
    def own_cast(self) -> str:
        """The cast target that ``cast: True`` asks for."""
        if self.type in INT_TYPES:
            return "UNSIGNED" if self.unsigned else "SIGNED"
        if self.type == "decimal":
            return f"DECIMAL({self.length or 10},{self.scale or 0})"
        if self.type in FLOAT_TYPES:
            return "DECIMAL(30,10)"
        if self.type in BINARY_TYPES:
            return "BINARY"
        return {"date": "DATE", "datetime": "DATETIME", "timestamp": "DATETIME", "time": "TIME"}.get(self.type, "CHAR")

    @property
    def spark_type(self) -> T.DataType:
        plain = {
            "tinyint": T.ByteType(),
            "smallint": T.ShortType(),
            "mediumint": T.IntegerType(),
            "int": T.LongType() if self.unsigned else T.IntegerType(),
            "bigint": T.LongType(),
            "float": T.FloatType(),
            "double": T.DoubleType(),
            "date": T.DateType(),
            "datetime": T.TimestampNTZType(),
            "timestamp": T.TimestampNTZType(),
            "year": T.IntegerType(),
            "bool": T.BooleanType(),
            "bit": T.BooleanType() if (self.length or 1) == 1 else T.LongType(),
        }
        if self.type == "decimal":
            return T.DecimalType(min(self.length or 10, 38), self.scale or 0)
        if self.type in BINARY_TYPES or self.type in SPATIAL_TYPES:
            return T.BinaryType()
        return plain.get(self.type, T.StringType())


@dataclass(frozen=True)
class IndexSpec:
    """An index as declared: kept for validation, hints and diffs; Spark has none."""

    name: str
    columns: tuple[str, ...]
    kind: str = "key"
    method: str = "btree"
    lengths: tuple[tuple[str, int], ...] = ()
    descending: tuple[str, ...] = ()


@dataclass(frozen=True)
class RelationSpec:
    """An edge to another table of the catalog."""

    name: str
    table: str
    type: str = "belongs_to"
    columns: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    condition: tuple[tuple[str, Any], ...] = ()
    through: str = ""
    through_columns: tuple[str, ...] = ()
    through_references: tuple[str, ...] = ()
    enforce: bool = False
    on_delete: str = ""
    on_update: str = ""

    def errors(self) -> list[str]:
        found = []
        if self.type not in ("belongs_to", "has_many", "many_to_many"):
            found.append(f"relationship_invalid_type: {self.name}")
        if not self.table:
            found.append(f"relationship_missing_table: {self.name}")
        if not self.columns or not self.references:
            found.append(f"relationship_missing_columns: {self.name}")
        if self.type == "many_to_many":
            if not self.through or not self.through_columns or not self.through_references:
                found.append(f"relationship_missing_through: {self.name}")
            if len(self.columns) != len(self.through_columns) or len(self.references) != len(self.through_references):
                found.append(f"relationship_column_mismatch: {self.name}")
            if self.condition:
                found.append(f"relationship_condition_unsupported: {self.name}")
        elif len(self.columns) != len(self.references):
            found.append(f"relationship_column_mismatch: {self.name}")
        if self.condition and self.enforce:
            found.append(f"relationship_condition_enforced: {self.name}")
        return found


@dataclass(frozen=True)
class MetaSpec:
    """The key/value side table of a table."""

    table: str
    object_id: str
    key: str = "meta_key"
    value: str = "meta_value"
    id: str = "meta_id"


@dataclass(frozen=True)
class TableSpec:
    """A table: ordered columns, indexes, relationships and an optional metadata store."""

    name: str
    columns: tuple[ColumnSpec, ...]
    indexes: tuple[IndexSpec, ...] = ()
    relations: tuple[RelationSpec, ...] = ()
    meta: MetaSpec | None = None
    read_only: bool = False
    by_name: dict[str, ColumnSpec] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        table = {c.name: c for c in self.columns}
        for c in self.columns:
            for alias in c.aliases:
                table.setdefault(alias, c)
        object.__setattr__(self, "by_name", table)

    def column(self, name: Any) -> ColumnSpec | None:
        return self.by_name.get(name) if isinstance(name, str) else None

    def relation(self, name: Any) -> RelationSpec | None:
        return next((r for r in self.relations if r.name == name), None)

    @property
    def primary(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.primary)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, c.allow_null or not c.primary) for c in self.columns])

    def with_columns(self, *columns: ColumnSpec) -> TableSpec:
        """A copy in which ``columns`` replace those of the same name or are added."""
        new = {c.name: c for c in columns}
        kept = [new.pop(c.name, c) for c in self.columns]
        return replace(self, columns=(*kept, *new.values()), by_name={})

    def without_columns(self, *names: str) -> TableSpec:
        return replace(self, columns=tuple(c for c in self.columns if c.name not in names), by_name={})

    @classmethod
    def from_spark(cls, name: str, schema: T.StructType, primary: tuple[str, ...] = (), **flags: dict[str, Any]) -> TableSpec:
        """Infer a table from a Spark schema; ``flags`` adds column flags by column name.

        Temporal columns may be date-queried, as on inference from a live table.
        """
        def one(f: T.StructField) -> ColumnSpec:
            kind, length, scale = spark_to_declared(f.dataType)
            base = {"type": kind, "length": length, "scale": scale, "allow_null": f.nullable and f.name not in primary, "primary": f.name in primary}
            base["date_query"] = kind in DATE_TYPES
            return ColumnSpec(f.name, **(base | flags.get(f.name, {})))

        return cls(name, tuple(one(f) for f in schema.fields))


def spark_to_declared(kind: T.DataType) -> tuple[str, int | None, int | None]:
    """The declared type, length and scale that a Spark type is read as."""
    if isinstance(kind, T.DecimalType):
        return "decimal", kind.precision, kind.scale
    plain = {
        T.ByteType: "tinyint",
        T.ShortType: "smallint",
        T.IntegerType: "int",
        T.LongType: "bigint",
        T.FloatType: "float",
        T.DoubleType: "double",
        T.BooleanType: "bool",
        T.DateType: "date",
        T.TimestampType: "timestamp",
        T.TimestampNTZType: "datetime",
        T.BinaryType: "longblob",
    }
    return plain.get(type(kind), "longtext"), None, None


_DECLARED = re.compile(r"^\s*([a-z]+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*(unsigned)?", re.I)


def parse_declared(text: str) -> tuple[str, int | None, int | None, bool]:
    """``decimal(10,2) unsigned`` as (type, length, scale, unsigned)."""
    m = _DECLARED.match(text)
    if not m:
        raise ValueError(f"not a column type: {text!r}")
    return m[1].lower(), int(m[2]) if m[2] else None, int(m[3]) if m[3] else None, bool(m[4])
