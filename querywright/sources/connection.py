"""Plain SQL over a catalog, and an inert stand-in: the narrow interface that callers may be given instead of a query."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row

from querywright.plans.columns import escape_like
from querywright.plans.context import Options
from querywright.plans.query import Query
from querywright.sources.catalog import Catalog
from querywright.writes.items import Writer

TABLE = re.compile(r"\{(\w+)\}")


class Connection:
    """Statements name tables as ``{table}`` and values as ``:name``; values are bound, never pasted into the text.

    ``frame`` is lazy; the reading methods run a job and bring what they say to the
    driver.  Writes go to stored tables only and give the number of rows they touched.
    """

    def __init__(self, catalog: Catalog, options: Options | None = None):
        self.catalog, self.options = catalog, options or Options()

    def frame(self, sql: str, **values: Any) -> DataFrame:
        tables = {name: self.catalog.frame(name) for name in TABLE.findall(sql)}
        return self.catalog.spark.sql(sql, args=values, **tables)

    def row(self, sql: str, at: int = 0, **values: Any) -> Row | None:
        """The row at a place of the statement's order, or None."""
        found = self.frame(sql, **values)
        rows = (found.offset(at) if at else found).limit(1).collect()
        return rows[0] if rows else None

    def value(self, sql: str, column: int = 0, at: int = 0, **values: Any) -> Any:
        found = self.row(sql, at, **values)
        return found[column] if found is not None and column < len(found) else None

    def rows(self, sql: str, **values: Any) -> list[Row]:
        """All rows; a statement that may give very many is better read as a ``frame``."""
        return self.frame(sql, **values).collect()

    def column(self, sql: str, column: int = 0, **values: Any) -> list[Any]:
        found = self.frame(sql, **values)
        return [r[0] for r in found.select(found.columns[column]).collect()] if column < len(found.columns) else []

    def like(self, text: str) -> str:
        """Text whose wildcards stand for themselves in a LIKE pattern."""
        return escape_like(text)

    def _writer(self, table: str) -> Writer:
        if table not in self.catalog.stores:
            raise PermissionError(f"{table} is not a stored table")
        return Writer(self.catalog, table, self.catalog.stores[table], self.options)

    def _filter(self, where: Mapping[str, Any]) -> dict[str, Any]:
        """Equality with every value; a null means the absence of one."""
        if not where:
            raise ValueError("a change needs a condition")
        clauses = [{"key": n, "compare": "IS NULL"} if v is None else {"key": n, "compare": "=", "value": v} for n, v in where.items()]
        return {"compare_query": {"relation": "AND", "clauses": clauses}}

    def insert(self, table: str, rows: Mapping[str, Any] | Sequence[Mapping[str, Any]]) -> int:
        return self._writer(table).insert([rows] if isinstance(rows, Mapping) else rows).count()

    def update(self, table: str, changes: Mapping[str, Any], where: Mapping[str, Any]) -> int:
        writer, spec = self._writer(table), self._filter(where)
        matched = Query(self.catalog, table, self.options).count_rows(spec)
        if matched:
            writer.commit(writer.updated(spec, changes))
        return matched

    def delete(self, table: str, where: Mapping[str, Any]) -> int:
        writer, spec = self._writer(table), self._filter(where)
        matched = Query(self.catalog, table, self.options).count_rows(spec)
        if matched:
            writer.commit(writer.remaining(spec))
        return matched


class NullConnection(Connection):
    """Finds nothing and changes nothing; for callers that have no tables."""

    def frame(self, sql: str, **values: Any) -> DataFrame:
        return self.catalog.spark.createDataFrame([], "nothing string")

    def insert(self, table: str, rows: Any) -> int:
        return 0

    def update(self, table: str, changes: Mapping[str, Any], where: Mapping[str, Any]) -> int:
        return 0

    def delete(self, table: str, where: Mapping[str, Any]) -> int:
        return 0
