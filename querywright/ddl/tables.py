"""Stored tables: created, altered, copied and emptied as Parquet tables of the session's catalog."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywright.ddl.declarations import spec_from_json, spec_to_json
from querywright.ddl.diff import APPLIED, Operation, Patch, Reconciled, Snapshot, compare, reconcile
from querywright.ddl.integrity import checksum
from querywright.model.schema import NAME, ColumnSpec, IndexSpec, TableSpec
from querywright.model.validation import schema_errors
from querywright.plans.context import Context, Options
from querywright.plans.relations import integrity
from querywright.sources.catalog import Catalog
from querywright.writes.store import FILE_BYTES, ParquetStore
from querywright.writes.values import default_of


@dataclass
class StoredTable:
    """A declared table kept as Parquet versions under a folder."""

    spark: SparkSession
    spec: TableSpec
    store: ParquetStore

    def exists(self) -> bool:
        return self.store.exists()

    def __post_init__(self):
        # What is stored knows its declaration; a table that is opened again takes it up.
        noted = self.store.note("declaration") if self.store.exists() else None
        self.stored_spec = spec_from_json(noted) if noted else None

    def _declare(self, spec: TableSpec) -> None:
        self.spec = self.stored_spec = spec
        self.store.put_note("declaration", spec_to_json(spec))

    def create(self) -> bool:
        """An empty table; refused for a faulty declaration, false if it is there already."""
        if errors := schema_errors(self.spec):
            raise ValueError(f"{self.spec.name}: " + "; ".join(": ".join(e) for e in errors))
        if self.exists():
            return False
        self.store.replace(self.spark.createDataFrame([], self.spec.struct()))
        self._declare(self.spec)
        return True

    def drop(self) -> bool:
        return self.store.drop()

    def rows(self) -> DataFrame:
        return self.store.read()

    def count(self) -> int:
        return self.rows().count()

    def truncate(self) -> None:
        self.store.replace(self.rows().limit(0))

    delete_all = truncate

    def duplicate(self, store: ParquetStore, with_rows: bool = False) -> StoredTable:
        """An empty table of the same columns, or one with the rows."""
        store.replace(self.rows() if with_rows else self.rows().limit(0))
        other = StoredTable(self.spark, self.spec, store)
        other._declare(self.stored_spec or self.spec)
        return other

    def copy_to(self, other: StoredTable) -> None:
        other.store.append(self.rows().select(*other.spec.names))

    def rename(self, path: str) -> None:
        self.store.move(path)

    def columns(self) -> list[tuple[str, str]]:
        return self.rows().dtypes

    def indexes(self) -> list[str]:
        return [i.name for i in self.spec.indexes]

    def status(self) -> dict[str, Any]:
        return {"name": self.spec.name, "rows": self.count(), "version": self.store.version()}

    def foreign_keys(self) -> list[str]:
        """The enforced relations as constraint clauses; Parquet tables don't check them, ``plans.relations.integrity`` does."""
        out = []
        for r in self.spec.relations:
            if r.enforce and r.type == "belongs_to":
                rules = "".join(f" ON {event} {rule.upper()}" for event, rule in (("DELETE", r.on_delete), ("UPDATE", r.on_update)) if rule)
                out.append(f"FOREIGN KEY ({', '.join(r.columns)}) REFERENCES {r.table} ({', '.join(r.references)}){rules}")
        return out

    def create_sql(self) -> str:
        body = ", ".join(f"{c.name} {c.spark_type.simpleString()}{'' if c.allow_null else ' NOT NULL'}" for c in self.spec.columns)
        return f"CREATE TABLE {self.spec.name} ({body}) USING parquet"

    def checksum(self) -> str:
        return checksum(self.rows()).first()["checksum"]

    def check(self) -> list[str]:
        """Names of declared columns that the stored rows lack."""
        there = set(self.rows().columns)
        return [n for n in self.spec.names if n not in there]

    def analyze(self) -> dict[str, int]:
        return {"rows": self.count()}

    def optimize(self, file_bytes: int = FILE_BYTES) -> int:
        """The same rows in files of about ``file_bytes``; the number of files."""
        return self.store.optimize(file_bytes)

    def repair(self) -> list[str]:
        """Give the rows the declared columns that they lack, with their defaults; their names."""
        lacking = self.check()
        if lacking:
            rows = self.rows()
            for n in lacking:
                rows = rows.withColumn(n, default_of(self.spec.column(n)))
            self.store.replace(rows.select(*self.spec.names, *[c for c in rows.columns if c not in self.spec.names]))
        return lacking

    def snapshot(self) -> Snapshot:
        """The table as it is stored.

        Columns come from the Parquet files; where their type is that of the stored
        declaration its finer traits (lengths, defaults) are taken from there, a column
        whose type has drifted from it is read from the files alone.  Indexes are known
        from the stored declaration only.  It is incomplete if the files cannot be read.
        """
        told = self.stored_spec or self.spec
        try:
            schema = self.rows().schema
        except Exception:
            return Snapshot(told, complete=False)
        found = TableSpec.from_spark(told.name, schema, told.primary)
        columns = []
        for c in found.columns:
            declared = told.column(c.name)
            same = declared is not None and declared.name == c.name and declared.spark_type == schema[c.name].dataType
            columns.append(declared if same else c)
        return Snapshot(replace(found, columns=tuple(columns), indexes=told.indexes, relations=told.relations, meta=told.meta, by_name={}))

    def diff(self, declared: TableSpec | None = None) -> Patch:
        """What turns the stored table into its declaration."""
        return compare(self.snapshot().table, declared or self.spec)

    def diverged(self) -> bool:
        return bool(self.diff())

    def apply(self, patch: Patch, to: TableSpec | None = None) -> None:
        """Rewrite the rows in the patched shape and take the patched declaration."""
        rows = [o for o in patch.operations if not o.kind.endswith("_index")]
        if rows:
            self.store.replace(Patch(tuple(rows)).apply_to_rows(self.rows()))
        self._declare(patch.apply_to_spec(to or self.snapshot().table))

    def reconcile(self, declared: TableSpec, drop: bool = False) -> Reconciled:
        """Bring what is stored to a declaration; see ``diff.reconcile``."""
        found = self.snapshot()
        outcome = reconcile(found, declared, drop)
        if outcome.patch:
            self.apply(outcome.patch, found.table)
            return Reconciled(APPLIED, outcome.patch, outcome.left)
        return outcome

    # Single changes; each is false if it cannot be made.

    def add_column(self, column: ColumnSpec) -> bool:
        if not NAME.fullmatch(column.name) or column.name in self.rows().columns:
            return False
        self.apply(Patch((Operation("add_column", column.name, None, column),)))
        return True

    def modify_column(self, column: ColumnSpec) -> bool:
        before = self.snapshot().table.column(column.name)
        if before is None or before.name != column.name:
            return False
        self.apply(Patch((Operation("modify_column", column.name, before, column),)))
        return True

    def drop_column(self, name: str) -> bool:
        before = self.snapshot().table.column(name)
        if before is None or before.name != name or before.primary:
            return False
        self.apply(Patch((Operation("drop_column", name, before, None),)))
        return True

    def add_index(self, index: IndexSpec) -> bool:
        """Indexes are declarations only: they serve hints and diffs."""
        if index.name in self.indexes() or any(self.spec.column(c) is None for c in index.columns):
            return False
        self.apply(Patch((Operation("add_index", index.name, None, index),)))
        return True

    def drop_index(self, name: str) -> bool:
        before = next((i for i in self.spec.indexes if i.name == name), None)
        if before is None:
            return False
        self.apply(Patch((Operation("drop_index", name, before, None),)))
        return True

    def replace_index(self, old: IndexSpec, new: IndexSpec) -> bool:
        """Both at once: the old one stays if the new one cannot stand."""
        if old.name not in self.indexes() or any(self.spec.column(c) is None for c in new.columns) or (new.name != old.name and new.name in self.indexes()):
            return False
        self.apply(Patch((Operation("drop_index", old.name, old, None), Operation("add_index", new.name, None, new))))
        return True

    def add_foreign_keys(self, catalog: Catalog) -> bool:
        """Check and note the enforced relations; false if a remote table is missing or a row refers to nothing.

        Parquet files enforce nothing by themselves: the keys that hold are noted beside
        the rows (``enforced``), and every key is looked at whatever the others give.
        """
        held, good = [], True
        ctx = Context(catalog, self.spec, Options())
        for r in self.spec.relations:
            if r.enforce and r.type == "belongs_to":
                if r.table in catalog.tables and integrity(ctx, r.name, self.rows()).isEmpty():
                    held.append(r.name)
                else:
                    good = False
        self.store.put_note("enforced", held)
        return good

    def enforced(self) -> list[str]:
        return self.store.note("enforced") or []

    def auto_increment(self, value: int) -> bool:
        """The least number that the next new row may get."""
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            return False
        self.store.put_note("auto_increment", value)
        return True

    def next_number(self) -> int:
        """The number of the next new row: above the largest one, and not below what was set."""
        name = next((c.name for c in self.spec.columns if c.extra == "auto_increment"), None)
        top = self.rows().agg(F.coalesce(F.max(name), F.lit(0)).alias("n")).first()["n"] if name else 0
        return max(top + 1, self.store.note("auto_increment") or 1)


@dataclass
class Migrations:
    """Versioned upgrades: those above the stored version run in order and stop at the first that fails.

    The version is noted beside the table's rows and the lock is a file there, so both
    hold for every process that sees the folder.
    """

    upgrades: Mapping[int, Callable[[StoredTable], bool | None]]
    lock_seconds: float = 900.0

    def version(self, table: StoredTable) -> int:
        return table.store.note("upgraded") or 0

    def pending(self, table: StoredTable) -> list[int]:
        return sorted(v for v in self.upgrades if v > self.version(table))

    def run(self, table: StoredTable, declared: TableSpec | None = None) -> list[int]:
        """The versions that ran; none under another's lock.

        With nothing pending, a declaration that is given is reconciled instead.
        """
        done: list[int] = []
        token = table.store.lock(self.lock_seconds)
        if token is None:
            return done
        try:
            pending = self.pending(table)
            for v in pending:
                if self.upgrades[v](table) is False:
                    break
                table.store.put_note("upgraded", v)
                done.append(v)
            if not pending and declared is not None:
                table.reconcile(declared)
        finally:
            table.store.unlock(token)
        return done

    def install(self, table: StoredTable) -> bool:
        """Create the table at the newest version."""
        made = table.create()
        if made:
            table.store.put_note("upgraded", max(self.upgrades, default=0))
        return made

    def uninstall(self, table: StoredTable) -> bool:
        return table.drop()
