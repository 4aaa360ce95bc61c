"""Metadata rows: added, read, changed and deleted by object and key; values are kept as JSON text."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querywright.model.schema import MetaSpec
from querywright.sources.catalog import Catalog


def encode(value: Any) -> str:
    """Text as it is, anything else as JSON."""
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True)


@dataclass
class MetaWriter:
    """Lazy changes of a metadata table; each method gives all rows after the change."""

    catalog: Catalog
    spec: MetaSpec

    @property
    def rows(self) -> DataFrame:
        return self.catalog.frame(self.spec.table)

    def _is(self, object_id: Any, key: str | None = None, value: Any = None):
        hit = F.col(self.spec.object_id) == F.lit(object_id)
        if key is not None:
            hit = hit & (F.col(self.spec.key) == F.lit(key))
        if value is not None:
            hit = hit & (F.col(self.spec.value) == F.lit(encode(value)))
        return hit

    def get(self, object_id: Any, key: str | None = None, single: bool = False) -> DataFrame:
        """Rows of an object (and key) by id; ``single`` gives the oldest only."""
        found = self.rows.where(self._is(object_id, key)).orderBy(self.spec.id)
        return found.limit(1) if single else found

    def add(self, object_id: Any, key: str, value: Any, unique: bool = False) -> DataFrame:
        """With one more row; ``unique`` adds none where the object has the key."""
        s, rows = self.spec, self.rows
        last = rows.agg(F.coalesce(F.max(s.id), F.lit(0)).alias("top"), F.coalesce(F.max(self._is(object_id, key)), F.lit(False)).alias("there"))
        row = last.where(~F.col("there")) if unique else last
        new = row.select((F.col("top") + 1).alias(s.id), F.lit(object_id).alias(s.object_id), F.lit(key).alias(s.key), F.lit(encode(value)).alias(s.value))
        return rows.unionByName(new.select(*[F.col(n).cast(t).alias(n) for n, t in rows.dtypes]))

    def update(self, object_id: Any, key: str, value: Any, previous: Any = None) -> DataFrame:
        """The key's rows (those of the previous value, if given) take the value; without any, one is added."""
        hit = self._is(object_id, key, previous)
        changed = self.rows.withColumn(self.spec.value, F.when(hit, F.lit(encode(value))).otherwise(F.col(self.spec.value)))
        if previous is not None:
            return changed
        added = self.add(object_id, key, value, unique=True)
        return changed.unionByName(added.join(self.rows.select(self.spec.id), self.spec.id, "left_anti").select(*changed.columns))

    def delete(self, object_id: Any, key: str, value: Any = None, everywhere: bool = False) -> DataFrame:
        """Without the key's rows (of a value, if given), of one object or of all."""
        hit = (F.col(self.spec.key) == F.lit(key)) & ((F.col(self.spec.value) == F.lit(encode(value))) if value is not None else F.lit(True)) if everywhere else self._is(object_id, key, value)
        return self.rows.where(~F.coalesce(hit, F.lit(False)))

    def delete_object(self, object_id: Any) -> DataFrame:
        return self.rows.where(~F.coalesce(self._is(object_id), F.lit(False)))

    def purge(self, gone: DataFrame, key: str) -> DataFrame:
        """Without the rows of all objects whose key stands in ``gone``."""
        dead = gone.select(F.col(key).alias("_qw_gone"))
        return self.rows.join(dead, F.col(self.spec.object_id) == dead["_qw_gone"], "left_anti")

    def save(self, object_id: Any, extra: Mapping[str, Any]) -> DataFrame:
        """Several keys of one object at once; a falsy value deletes its key."""
        keys = list(extra)
        kept = self.rows.where(~F.coalesce(self._is(object_id) & F.col(self.spec.key).isin(keys), F.lit(False)))
        items = [(k, encode(v)) for k, v in extra.items() if v]
        if not items:
            return kept
        s, spark = self.spec, self.catalog.spark
        top = self.rows.agg(F.coalesce(F.max(s.id), F.lit(0))).scalar()
        # The new pairs are a short list from the caller.
        ranked = spark.createDataFrame(items, "k string, v string").withColumn("n", F.row_number().over(Window.orderBy("k")))
        rows = ranked.select((top + F.col("n")).alias(s.id), F.lit(object_id).alias(s.object_id), F.col("k").alias(s.key), F.col("v").alias(s.value))
        return kept.unionByName(rows.select(*[F.col(n).cast(t).alias(n) for n, t in kept.dtypes]))
