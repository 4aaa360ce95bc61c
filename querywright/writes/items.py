"""Adding, copying, changing and deleting rows, in sets.

The ``added``, ``copied``, ``updated`` and ``remaining`` methods give the table's new
rows as a lazy DataFrame; ``commit`` stores one and gives what changed, as rows that
are read from the two stored versions.  ``insert`` writes new rows only, beside the
stored ones.  New keys are numbered from the largest one on; of two writers at once
the second is refused by the store.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querywright.functions.casts import text_of
from querywright.model.schema import ColumnSpec
from querywright.plans.context import Options
from querywright.plans.query import Query
from querywright.sources.catalog import Catalog
from querywright.writes.metadata import MetaWriter
from querywright.writes.numbering import numbered
from querywright.writes.store import ParquetStore
from querywright.writes.values import default_of, new_uuid, validated


#: What a watched column of a row went from that was not there before.
NEW = "new"


@dataclass
class Writer:
    """Writes to one table of a catalog.  ``store`` is where ``commit`` puts new rows."""

    catalog: Catalog
    name: str
    store: ParquetStore | None = None
    options: Options = field(default_factory=Options)
    denied: frozenset[str] = frozenset()

    def __post_init__(self):
        if not self.catalog.can_write(self.name):
            raise PermissionError(f"{self.name} is read-only")
        self.spec = self.catalog.tables[self.name]
        self.reader = Query(self.catalog, self.name, self.options)

    @property
    def rows(self) -> DataFrame:
        return self.catalog.frame(self.name)

    @property
    def now(self) -> Column:
        return F.lit(self.options.now).cast("timestamp_ntz") if self.options.now else F.localtimestamp()

    def _guarded(self, spec: Mapping[str, Any]) -> Any:
        """The filter of a bulk change; one that filters nothing is refused."""
        pred = self.reader.predicate(self.reader.normalized(spec))
        if pred is None:
            raise ValueError("a bulk change needs a filter")
        return pred

    def _given(self, items: Sequence[Mapping[str, Any]]) -> DataFrame:
        names = [c.name for c in self.spec.columns if any(c.name in i for i in items)]
        spark = self.catalog.spark
        # Values travel as text and are read by the column's own rules; position keeps their order.
        rows = [(k, *[None if i.get(n) is None else text_of(i[n]) for n in names], *[n in i for n in names]) for k, i in enumerate(items)]
        fields = ["_qw_at long", *[f"`{n}` string" for n in names], *[f"`_qw_has_{n}` boolean" for n in names]]
        return spark.createDataFrame(rows, ", ".join(fields))

    def _stamped(self, c: ColumnSpec, given: Column | None, has: Column) -> Column | None:
        """Values that the table fills in itself: times of writing and generated names."""
        if c.created or c.modified:
            return F.coalesce(validated(c, given), self.now) if given is not None and c.created else self.now
        if c.current_timestamp:
            if given is None:
                return self.now
            told = validated(c, given)
            return F.when(has & (told.isNotNull() | (given.isNull() & F.lit(c.allow_null))), told).otherwise(self.now)
        if c.uuid:
            return F.when(given.isNotNull(), validated(c, given)).otherwise(new_uuid()) if given is not None else new_uuid()
        return None

    def _largest(self, name: str) -> Column:
        """The largest value of a column so far, 0 without any, and not below what the store asks for: a scalar subquery of the plan."""
        asked = (self.store.note("auto_increment") or 1) - 1 if self.store is not None else 0
        return F.greatest(self.rows.agg(F.coalesce(F.max(name), F.lit(0))).scalar(), F.lit(asked))

    def new_rows(self, items: Sequence[Mapping[str, Any]]) -> DataFrame:
        """Complete rows from partial ones: defaults, stamps, checks, numbers."""
        given = self._given([{k: v for k, v in i.items() if k not in self.denied} for i in items])
        out = []
        for c in self.spec.columns:
            x = F.col(c.name) if c.name in given.columns else None
            has = F.col(f"_qw_has_{c.name}") if x is not None else F.lit(False)
            value = self._stamped(c, x, has)
            if value is None:
                value = default_of(c) if x is None else F.when(has, validated(c, x)).otherwise(default_of(c))
                if c.extra == "auto_increment":
                    missing = F.lit(True) if x is None else F.coalesce(value, F.lit(0)) == 0
                    n = F.sum(F.when(missing, 1).otherwise(0)).over(Window.orderBy("_qw_at"))
                    value = F.when(missing, self._largest(c.name) + n).otherwise(F.lit(None) if x is None else value)
            if c.intercept is not None:
                value = c.intercept(value, "insert")
            out.append(value.cast(c.spark_type).alias(c.name))
        return given.select(*out)

    def added(self, items: Sequence[Mapping[str, Any]]) -> DataFrame:
        """All rows with the new ones.  A new row whose key exists is left out."""
        return self.rows.unionByName(self._fresh(items))

    def _fresh(self, items: Sequence[Mapping[str, Any]]) -> DataFrame:
        new = self._shaped(self.new_rows(items))
        keys = list(self.spec.primary)
        return new.join(self.rows.select(*keys), keys, "left_anti").select(*new.columns) if keys else new

    def insert(self, items: Sequence[Mapping[str, Any]]) -> DataFrame:
        """Store new rows beside the others, which are not written again; the rows as stored."""
        store = self._writable()
        before = set(store.parts())
        store.append(self._fresh(items))
        self._changed()
        added = [p for p in store.parts() if p not in before]
        return self.catalog.spark.read.parquet(*[f"{store.path}/{p}" for p in added])

    def _shaped(self, new: DataFrame) -> DataFrame:
        """New rows in the stored columns and types."""
        there = dict(self.rows.dtypes)
        return new.select(*[F.col(n).cast(t).alias(n) for n, t in there.items()])

    def copied(self, spec: Mapping[str, Any], changes: Mapping[str, Any]) -> DataFrame:
        """All rows with copies of the matching ones: changed as asked, with new numbers, names and times of their own."""
        self._guarded(spec)
        kept = self.reader.matched(self.reader.normalized(spec))
        top = None
        for c in self.spec.columns:
            if c.name in changes and c.extra != "auto_increment":
                kept = kept.withColumn(c.name, validated(c, F.lit(None if changes[c.name] is None else text_of(changes[c.name]))).cast(dict(self.rows.dtypes)[c.name]))
            elif c.uuid:
                kept = kept.withColumn(c.name, new_uuid())
            elif c.created or c.modified:
                kept = kept.withColumn(c.name, self.now)
            elif c.extra == "auto_increment":
                top = c.name
        if top:
            kept = numbered(kept, [top], "_qw_n").withColumn(top, self._largest(top) + F.col("_qw_n")).drop("_qw_n")
        return self.rows.unionByName(kept.select(*self.rows.columns))

    def updated(self, spec: Mapping[str, Any], changes: Mapping[str, Any]) -> DataFrame:
        """All rows, the matching ones changed; keys, and columns that may not be written, stay.

        Matching rows that already have the values stay as they are, their time of
        change too.
        """
        self._guarded(spec)
        names = [n for n in self.rows.columns if n not in self.spec.primary and n not in self.denied]
        fixed = {c.name: c for c in self.spec.columns if c.name in changes and c.name in names}
        hit = self._flagged(spec)
        values = {n: validated(c, F.lit(None if changes[n] is None else text_of(changes[n]))) for n, c in fixed.items()}
        differs = F.lit(False)
        for n, v in values.items():
            differs = differs | ~F.col(n).eqNullSafe(v)
        touched = F.col("_qw_hit") & differs
        out = []
        for n, t in self.rows.dtypes:
            c = self.spec.column(n)
            new = values.get(n)
            if c is not None and c.modified:
                new = self.now
            if new is not None and c.intercept is not None:
                new = c.intercept(new, "update")
            out.append(F.col(n) if new is None else F.when(touched, new.cast(t)).otherwise(F.col(n)).alias(n))
        return hit.select(*out)

    def remaining(self, spec: Mapping[str, Any]) -> DataFrame:
        """All rows without the matching ones."""
        self._guarded(spec)
        return self._flagged(spec).where(~F.col("_qw_hit")).drop("_qw_hit")

    def _flagged(self, spec: Mapping[str, Any]) -> DataFrame:
        """All rows with a flag for the matching ones, found by key."""
        keys = list(self.spec.primary)
        if not keys:
            raise ValueError(f"{self.name} has no primary key to change rows by")
        found = self.reader.select_primary_keys(spec).withColumn("_qw_hit", F.lit(True))
        names = {k: f"_qw_{k}" for k in keys}
        found = found.select(*[F.col(k).alias(names[k]) for k in keys], "_qw_hit")
        rows = self.rows
        joined = rows.join(found, [rows[k].eqNullSafe(found[names[k]]) for k in keys], "left").drop(*names.values())
        return joined.withColumn("_qw_hit", F.coalesce("_qw_hit", F.lit(False)))

    def extras(self, item: Mapping[str, Any]) -> dict[str, Any]:
        """Those values of an item that no column takes; they are metadata where the table has a store."""
        return {k: v for k, v in item.items() if self.spec.column(k) is None}

    def with_extras(self, key: Any, item: Mapping[str, Any]) -> DataFrame:
        """All metadata rows with the extra values of an item saved under its key; falsy ones delete theirs."""
        return MetaWriter(self.catalog, self.spec.meta).save(key, self.extras(item))

    def purged_metadata(self, spec: Mapping[str, Any]) -> DataFrame:
        """All metadata rows without those of the matching rows, for when these are deleted."""
        self._guarded(spec)
        return MetaWriter(self.catalog, self.spec.meta).purge(self.reader.select_primary_keys(spec), self.spec.primary[0])

    def transitions(self, after: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """(keys, column, before, after) of watched columns that differ between ``before`` (now) and ``after``.

        Of a row that was not there all watched columns were ``new``; one that went has no transitions.
        """
        keys = list(self.spec.primary)
        before = self.rows if before is None else before
        watched = [c.name for c in self.spec.columns if c.transition]
        a = before.select(*keys, F.lit(True).alias("_a_there"), *[F.col(c).cast("string").alias(f"_a_{c}") for c in watched])
        b = after.select(*keys, *[F.col(c).cast("string").alias(f"_b_{c}") for c in watched])
        both = b.join(a, keys, "left")
        old = {c: F.when(F.col("_a_there").isNull(), F.lit(NEW)).otherwise(F.col(f"_a_{c}")) for c in watched}
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), old[c].alias("before"), F.col(f"_b_{c}").alias("after")) for c in watched])
        if not watched:
            return both.select(*keys, F.lit("").alias("column"), F.lit("").alias("before"), F.lit("").alias("after")).limit(0)
        told = both.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.column", "p.before", "p.after")
        return told.where(~F.col("before").eqNullSafe(F.col("after")))

    def deleted(self, after: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """The keys of rows that ``before`` (now) has and ``after`` has not."""
        keys = list(self.spec.primary)
        return (self.rows if before is None else before).select(*keys).join(after.select(*keys), keys, "left_anti")

    def _writable(self) -> ParquetStore:
        if self.store is None:
            raise ValueError("commit needs a store")
        return self.store

    def _changed(self) -> None:
        self.catalog.add_stored(self.spec, self.store)
        self.catalog.changed()

    def commit(self, after: DataFrame) -> DataFrame:
        """Store ``after`` as the table's rows.  Returns the events: (kind, keys, column, before, after).

        ``after`` is evaluated once, by the write.  Events, of kind 'transition' or
        'deleted', are the difference of the two stored versions, so what they say is
        what was stored, and nothing of it is brought to the driver.
        """
        store, keys = self._writable(), list(self.spec.primary)
        was = store.version()
        now = store.replace(after)
        self._changed()
        new = store.read(now)
        old = store.read(was) if was else new.limit(0)
        if not keys:
            # Rows without a key cannot be followed from one version to the next.
            return self.catalog.spark.createDataFrame([], "kind string, column string, before string, after string")
        moved = self.transitions(new, old).select(F.lit("transition").alias("kind"), *keys, "column", "before", "after")
        none = F.lit(None).cast("string")
        gone = self.deleted(new, old).select(F.lit("deleted").alias("kind"), *keys, F.lit("").alias("column"), none.alias("before"), none.alias("after"))
        return moved.unionByName(gone)
