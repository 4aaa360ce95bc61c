"""Columns that recur: keys, time stamps, identifiers, versions and metadata pairs."""

from __future__ import annotations

from querywright.model.schema import ColumnSpec, MetaSpec, RelationSpec, TableSpec


def identifier(name: str = "id", **more) -> ColumnSpec:
    """An unsigned key that new rows are numbered by."""
    return ColumnSpec(name, **({"type": "bigint", "length": 20, "unsigned": True, "extra": "auto_increment", "primary": True, "sortable": True} | more))


def primary(name: str = "id", **more) -> ColumnSpec:
    return ColumnSpec(name, **({"type": "bigint", "length": 20, "unsigned": True, "primary": True, "sortable": True} | more))


def serial(name: str = "id", **more) -> ColumnSpec:
    return identifier(name, **({"unique": True} | more))


def uuid(name: str = "uuid", **more) -> ColumnSpec:
    """A generated ``urn:uuid:`` name; a copy of a row gets a new one."""
    return ColumnSpec(name, **({"type": "varchar", "length": 100, "uuid": True, "in_": False, "not_in": False} | more))


def created(name: str = "date_created", **more) -> ColumnSpec:
    return ColumnSpec(name, **({"type": "datetime", "created": True, "date_query": True, "sortable": True} | more))


def modified(name: str = "date_modified", **more) -> ColumnSpec:
    return ColumnSpec(name, **({"type": "datetime", "modified": True, "date_query": True, "sortable": True} | more))


def current_timestamp(name: str, **more) -> ColumnSpec:
    """Takes an explicit time, or null where allowed; otherwise the time of the write."""
    return ColumnSpec(name, **({"type": "timestamp", "current_timestamp": True, "date_query": True} | more))


def version(name: str = "version", **more) -> ColumnSpec:
    return ColumnSpec(name, **({"type": "varchar", "length": 20, "default": ""} | more))


def meta_key(name: str = "meta_key", **more) -> ColumnSpec:
    return ColumnSpec(name, **({"type": "varchar", "length": 191, "allow_null": True, "index": True} | more))


def meta_value(name: str = "meta_value", **more) -> ColumnSpec:
    return ColumnSpec(name, **({"type": "longtext", "allow_null": True, "in_": False, "not_in": False} | more))


def meta_table(owner: TableSpec, name: str | None = None) -> tuple[TableSpec, MetaSpec]:
    """The key/value side table of ``owner``: its object id has the type of the owner's key."""
    if len(owner.primary) != 1:
        raise ValueError("metadata needs a primary key of one column")
    key, table = owner.column(owner.primary[0]), name or f"{owner.name}meta"
    object_id = ColumnSpec(f"{owner.name}_id", key.type, key.length, unsigned=key.unsigned, index=True)
    side = TableSpec(
        table,
        (identifier("meta_id"), object_id, meta_key(), meta_value()),
        relations=(RelationSpec(owner.name, owner.name, "belongs_to", (object_id.name,), (key.name,)),),
    )
    return side, MetaSpec(table, object_id.name)
