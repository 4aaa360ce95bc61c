"""A catalog binds declared tables to DataFrames; nothing in it runs a job."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from querywright.model.schema import TableSpec

Loader = Callable[[], DataFrame]


@dataclass
class ResultCache:
    """Collected results by key, the least recently used going first.  ``most`` 0 keeps none."""

    most: int = 0
    held: OrderedDict[str, list[Any]] = field(default_factory=OrderedDict)
    hits: int = 0

    def get(self, key: str | None, find: Callable[[], list[Any]]) -> list[Any]:
        """What is kept under the key, or else what ``find`` gives; a null key is never kept."""
        if key is None or not self.most:
            return find()
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
        else:
            self.held[key] = find()
            while len(self.held) > self.most:
                self.held.popitem(last=False)
        return list(self.held[key])


@dataclass
class Catalog:
    """Table name -> declaration and loader.  ``version`` rises with each write, for result caches."""

    spark: SparkSession
    tables: dict[str, TableSpec] = field(default_factory=dict)
    loaders: dict[str, Loader] = field(default_factory=dict)
    views: dict[str, tuple[str, ...]] = field(default_factory=dict)
    temporary: set[str] = field(default_factory=set)
    version: int = 0
    stores: dict[str, Any] = field(default_factory=dict)
    view_versions: dict[str, str] = field(default_factory=dict)
    cache: ResultCache = field(default_factory=ResultCache)

    def generation(self) -> list[Any]:
        """What rises with each write: this catalog's version and those of the stored tables.

        Results are cached under it, so a write by any process makes them unreachable.
        """
        return [self.version, sorted((name, store.version()) for name, store in self.stores.items())]

    def add_stored(self, table: TableSpec, store: Any) -> Catalog:
        """A table kept in a store of versions (see ``writes.store``)."""
        self.stores[table.name] = store
        return self.add(table, store.read)

    def add(self, table: TableSpec, source: DataFrame | Loader) -> Catalog:
        self.tables[table.name] = table
        self.loaders[table.name] = source if callable(source) and not isinstance(source, DataFrame) else lambda: source
        return self

    def add_parquet(self, table: TableSpec, path: str) -> Catalog:
        """A table kept as Parquet; columns are read only as queries need them."""
        return self.add(table, lambda: self.spark.read.parquet(path))

    def add_view(self, table: TableSpec, build: Loader, depends_on: tuple[str, ...] = (), version: str = "") -> Catalog:
        """A stored query: read-only, and refused while a table it depends on is missing."""
        missing = [d for d in depends_on if d not in self.tables]
        if missing:
            raise KeyError(f"view {table.name} depends on missing tables: {', '.join(missing)}")
        self.views[table.name] = depends_on
        self.add(table, build)
        self.frame(table.name).createOrReplaceTempView(table.name)
        self.view_versions[table.name] = version
        return self

    def upgrade_view(self, table: TableSpec, build: Loader, depends_on: tuple[str, ...] = (), version: str = "") -> bool:
        """Make a view anew if it is missing or of another version; whether that was so.

        Nothing changes while a table it depends on is missing.
        """
        if self.view_versions.get(table.name) == version or any(d not in self.tables for d in depends_on):
            return False
        self.add_view(table, build, depends_on, version)
        self.changed()
        return True

    def drop_view(self, name: str) -> bool:
        if name not in self.views:
            return False
        del self.views[name], self.tables[name], self.loaders[name]
        self.view_versions.pop(name, None)
        return self.spark.catalog.dropTempView(name)

    def add_temporary(self, table: TableSpec, rows: DataFrame, store: Any) -> Catalog:
        """A table of this session with rows of its own, written now; also visible to SQL.

        ``store`` holds them and takes writes; ``drop`` deletes it.
        """
        store.replace(rows)
        self.add_stored(table, store)
        self.temporary.add(table.name)
        self.frame(table.name).createOrReplaceTempView(table.name)
        return self

    def drop(self, name: str) -> bool:
        self.loaders.pop(name, None)
        store = self.stores.pop(name, None)
        if name in self.temporary:
            self.temporary.discard(name)
            self.spark.catalog.dropTempView(name)
            store.drop()
        return self.tables.pop(name, None) is not None

    def frame(self, name: str) -> DataFrame:
        return self.loaders[name]()

    def can_write(self, name: str) -> bool:
        return name in self.tables and name not in self.views and not self.tables[name].read_only

    def changed(self) -> None:
        self.version += 1
