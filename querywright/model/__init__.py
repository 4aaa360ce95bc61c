"""Declared tables: columns with query capabilities, indexes, relationships."""

from querywright.model.schema import ColumnSpec, IndexSpec, MetaSpec, RelationSpec, TableSpec

__all__ = ["ColumnSpec", "IndexSpec", "MetaSpec", "RelationSpec", "TableSpec"]
