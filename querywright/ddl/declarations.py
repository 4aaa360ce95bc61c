"""Table declarations as JSON, to be kept beside the rows they declare."""

from __future__ import annotations

from dataclasses import asdict, fields
from typing import Any

from querywright.model.schema import ColumnSpec, IndexSpec, MetaSpec, RelationSpec, TableSpec

#: Functions cannot be written down; a declaration that is read back has none.
CALLABLES = ("cast", "validate", "intercept")


def spec_to_json(table: TableSpec) -> dict[str, Any]:
    out = {"name": table.name, "read_only": table.read_only, "meta": asdict(table.meta) if table.meta else None}
    out["columns"] = [{f.name: getattr(c, f.name) for f in fields(c) if f.name not in CALLABLES} for c in table.columns]
    out["indexes"] = [asdict(i) for i in table.indexes]
    out["relations"] = [asdict(r) for r in table.relations]
    return out


def spec_from_json(noted: dict[str, Any]) -> TableSpec:
    return TableSpec(
        noted["name"],
        tuple(ColumnSpec(**_tuples(c)) for c in noted["columns"]),
        tuple(IndexSpec(**_tuples(i)) for i in noted["indexes"]),
        tuple(RelationSpec(**_tuples(r)) for r in noted["relations"]),
        MetaSpec(**noted["meta"]) if noted["meta"] else None,
        noted["read_only"],
    )


def _tuples(value: Any) -> Any:
    """JSON has lists where declarations have tuples."""
    if isinstance(value, dict):
        return {k: _tuples(v) for k, v in value.items()}
    return tuple(_tuples(v) for v in value) if isinstance(value, list) else value
