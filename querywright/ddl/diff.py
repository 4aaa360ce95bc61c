"""The difference of two declarations as a patch: planned, reverted, rendered, applied."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywright.functions.casts import cast_to
from querywright.model.schema import INT_TYPES, ColumnSpec, IndexSpec, TableSpec

#: Other names of types.
SYNONYMS = {"integer": "int", "bool": "tinyint", "boolean": "tinyint", "dec": "decimal", "fixed": "decimal", "numeric": "decimal", "real": "double", "datetime": "datetime"}
APPLIED, PENDING, DEFERRED, UNCHANGED = "applied", "pending", "deferred", "unchanged"


def normal_column(c: ColumnSpec) -> tuple:
    """What two columns must share to be the same; display widths of integers don't count."""
    kind = SYNONYMS.get(c.type, c.type)
    length = None if kind in INT_TYPES else c.length
    if kind == "decimal":
        length = c.length or 10
    scale = (c.scale or 0) if kind == "decimal" else None
    return kind, length, scale, c.unsigned if kind in INT_TYPES or kind == "decimal" else False, c.allow_null, c.default, c.extra.lower()


def normal_index(i: IndexSpec) -> tuple:
    kind = "key" if i.kind in ("index", "key") else i.kind
    return kind, i.method.lower(), i.columns, tuple(sorted(i.lengths)), tuple(sorted(i.descending))


@dataclass(frozen=True)
class Operation:
    """One change.  ``before`` and ``after`` are columns or indexes."""

    kind: str
    subject: str
    before: ColumnSpec | IndexSpec | None = None
    after: ColumnSpec | IndexSpec | None = None

    @property
    def destructive(self) -> bool:
        return self.kind.startswith("drop_")

    def reverted(self) -> Operation:
        opposite = {"add": "drop", "drop": "add"}
        verb, _, what = self.kind.partition("_")
        return Operation(f"{opposite.get(verb, verb)}_{what}", self.subject, self.after, self.before)

    def to_sql(self, table: str) -> str:
        if self.kind == "add_column":
            return f"ALTER TABLE {table} ADD COLUMNS ({self.subject} {self.after.spark_type.simpleString()})"
        if self.kind == "drop_column":
            return f"ALTER TABLE {table} DROP COLUMN {self.subject}"
        if self.kind == "modify_column":
            return f"ALTER TABLE {table} ALTER COLUMN {self.subject} TYPE {self.after.spark_type.simpleString()}"
        return f"-- {self.kind} {self.subject}: Spark has no indexes"


@dataclass(frozen=True)
class Patch:
    operations: tuple[Operation, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.operations)

    def planned(self, drop: bool = False) -> Patch:
        """Without what would lose data, unless that is asked for."""
        return Patch(tuple(o for o in self.operations if drop or not o.destructive))

    def reverted(self) -> Patch:
        return Patch(tuple(o.reverted() for o in reversed(self.operations)))

    def to_sql(self, table: str) -> list[str]:
        return [o.to_sql(table) for o in self.operations]

    def apply_to_spec(self, table: TableSpec) -> TableSpec:
        for o in self.operations:
            if o.kind in ("add_column", "modify_column"):
                table = table.with_columns(o.after)
            elif o.kind == "drop_column":
                table = table.without_columns(o.subject)
            else:
                kept = tuple(i for i in table.indexes if i.name != o.subject)
                table = replace(table, indexes=kept if o.kind == "drop_index" else (*kept, o.after), by_name={})
        return table

    def apply_to_rows(self, df: DataFrame) -> DataFrame:
        """Rows in the new shape: new columns take their default, changed ones are cast without raising."""
        for o in self.operations:
            if o.kind == "add_column":
                df = df.withColumn(o.subject, F.lit(o.after.default).cast(o.after.spark_type))
            elif o.kind == "drop_column":
                df = df.drop(o.subject)
            elif o.kind == "modify_column":
                x = F.col(o.subject)
                x = cast_to(x, o.after.own_cast, o.before.category) if o.before.category != o.after.category else x
                df = df.withColumn(o.subject, x.try_cast(o.after.spark_type))
        return df


def compare(old: TableSpec, new: TableSpec) -> Patch:
    """What turns ``old`` into ``new``: columns in the new order, dropped ones last, then indexes."""
    found: list[Operation] = []
    before = {c.name: c for c in old.columns}
    after = {c.name: c for c in new.columns}
    for name, c in after.items():
        if name not in before:
            found.append(Operation("add_column", name, None, c))
        elif normal_column(before[name]) != normal_column(c):
            found.append(Operation("modify_column", name, before[name], c))
    found += [Operation("drop_column", n, c, None) for n, c in before.items() if n not in after]
    was, now = {i.name: i for i in old.indexes}, {i.name: i for i in new.indexes}
    for name, i in now.items():
        if name not in was:
            found.append(Operation("add_index", name, None, i))
        elif normal_index(was[name]) != normal_index(i):
            found.append(Operation("modify_index", name, was[name], i))
    found += [Operation("drop_index", n, i, None) for n, i in was.items() if n not in now]
    return Patch(tuple(found))


@dataclass(frozen=True)
class Snapshot:
    """A table as found; ``complete`` is false if some of it could not be read."""

    table: TableSpec
    complete: bool = True


@dataclass(frozen=True)
class Reconciled:
    state: str
    patch: Patch = field(default_factory=Patch)
    left: Patch = field(default_factory=Patch)


def reconcile(found: Snapshot, declared: TableSpec, drop: bool = False) -> Reconciled:
    """The patch that brings a found table to its declaration.

    Dropping must be asked for; what is left out so is reported.  An incomplete
    snapshot defers everything.
    """
    whole = compare(found.table, declared)
    if not found.complete:
        return Reconciled(DEFERRED, left=whole)
    plan = whole.planned(drop)
    left = Patch(tuple(o for o in whole.operations if o not in plan.operations))
    return Reconciled(PENDING if plan else UNCHANGED, plan, left)
