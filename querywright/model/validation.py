"""Checks of a declared table; each finding is a code and what it is about."""

from __future__ import annotations

from querywright.model.schema import NAME, TYPES, TableSpec

MOST_NAME = 64


def schema_errors(table: TableSpec) -> list[tuple[str, str]]:
    """All that is wrong with a table's own declaration, in a fixed order."""
    found: list[tuple[str, str]] = []
    names = [c.name for c in table.columns]
    if not names:
        found.append(("schema_no_columns", table.name))
    for c in table.columns:
        if not NAME.fullmatch(c.name):
            found.append(("column_invalid_name", c.name))
        if len(c.name) > MOST_NAME:
            found.append(("column_name_too_long", c.name))
        if c.type not in TYPES:
            found.append(("column_invalid_type", c.name))
        if c.type == "varchar" and c.length is not None and not 0 < c.length <= 65535:
            found.append(("column_invalid_length", c.name))
        if c.type == "decimal" and (c.scale or 0) > (c.length or 10):
            found.append(("column_invalid_scale", c.name))
        if c.primary and c.allow_null:
            found.append(("primary_nullable", c.name))
        if c.extra == "auto_increment" and c.category != "numeric":
            found.append(("auto_increment_not_numeric", c.name))
    found += [("column_duplicate", n) for n in sorted({n for n in names if names.count(n) > 1})]
    increments = [c.name for c in table.columns if c.extra == "auto_increment"]
    if len(increments) > 1:
        found.append(("auto_increment_many", ", ".join(increments)))
    if len(table.primary) > 1 and increments and set(increments) & set(table.primary):
        found.append(("primary_composite_auto_increment", ", ".join(table.primary)))
    seen: set[str] = set()
    for i in table.indexes:
        if i.name in seen:
            found.append(("index_duplicate", i.name))
        seen.add(i.name)
        if not i.columns:
            found.append(("index_no_columns", i.name))
        found += [("index_unknown_column", f"{i.name}.{c}") for c in i.columns if c not in names]
        if i.kind == "primary" and table.primary and tuple(i.columns) != table.primary:
            found.append(("primary_conflict", i.name))
        if i.method == "fulltext" and any(c.category != "string" for c in table.columns if c.name in i.columns):
            found.append(("index_fulltext_not_text", i.name))
    accessors: set[str] = set()
    for r in table.relations:
        found += [tuple(e.split(": ", 1)) for e in r.errors()]
        found += [("relationship_unknown_column", f"{r.name}.{c}") for c in r.columns if c not in names]
        if r.name in accessors:
            found.append(("relationship_duplicate", r.name))
        accessors.add(r.name)
        if r.enforce and r.type != "belongs_to":
            found.append(("relationship_enforce_unsupported", r.name))
    return found


def catalog_errors(tables: dict[str, TableSpec]) -> list[tuple[str, str]]:
    """What relationships name on their far side but no table of the catalog has."""
    found: list[tuple[str, str]] = []
    for t in tables.values():
        for r in t.relations:
            far = tables.get(r.table)
            if far is None:
                found.append(("relationship_unknown_table", f"{t.name}.{r.name}"))
                continue
            found += [("relationship_unknown_reference", f"{t.name}.{r.name}.{c}") for c in r.references if far.column(c) is None]
            found += [("relationship_unknown_condition", f"{t.name}.{r.name}.{c}") for c, _ in r.condition if far.column(c) is None]
            if r.type == "many_to_many":
                pivot = tables.get(r.through)
                if pivot is None:
                    found.append(("relationship_unknown_through", f"{t.name}.{r.name}"))
                else:
                    found += [("relationship_unknown_pivot_column", f"{t.name}.{r.name}.{c}") for c in (*r.through_columns, *r.through_references) if pivot.column(c) is None]
    return found
