"""The query entry point: a specification becomes a lazy DataFrame.

Nothing here runs a job except the methods that say so (``count_rows``, ``page``,
``total`` and its kin).
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from querywright.functions.casts import whole_or
from querywright.functions.json_values import decoded, read_json
from querywright.model.schema import TableSpec
from querywright.plans import aggregates, columns, dates, meta, relations
from querywright.plans.context import Context, Options
from querywright.plans.criteria import BUCKETS, Bucket, combine_buckets
from querywright.plans.ordering import order_rows
from querywright.plans.pred import Pred, apply, group, never
from querywright.sources.catalog import Catalog

PAGE = 100
#: Variables that do not change which rows a query finds.
NOT_IN_KEY = ("fields", "cache_results", "with", "index_hints")

Parser = Callable[[Context, Mapping[str, Any]], Pred | None]


@dataclass
class Hooks:
    """Where callers can step in: before parsing, around each filter, on the plan, on collected rows.

    ``before_filter`` and ``after_filter`` go by bucket name ('by', 'in', 'not_in', 'search',
    'date', 'meta', 'compare', 'relation', or a parser's own): the first get and give the
    specification that this filter is built from, the others the filter itself.
    ``found`` changes the rows that a page counts as found.
    """

    before: list[Callable[[dict[str, Any]], dict[str, Any]]] = field(default_factory=list)
    transform: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    item: list[Callable[[Any], Any]] = field(default_factory=list)
    items: list[Callable[[list[Any]], list[Any]]] = field(default_factory=list)
    parsers: dict[str, Parser] = field(default_factory=dict)
    before_filter: dict[str, list[Callable[[Mapping[str, Any]], Mapping[str, Any]]]] = field(default_factory=dict)
    after_filter: dict[str, list[Callable[[Pred | None], Pred | None]]] = field(default_factory=dict)
    found: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)


@dataclass(frozen=True)
class Page:
    rows: list[Any]
    found: int
    pages: int


class Query:
    """Queries one table of a catalog.

    Variables: ``{column}``, ``{column}__in``, ``{column}__not_in``, ``{column}_compare``,
    ``{column}_query``, ``by``, ``search``, ``search_columns``, ``compare_query``,
    ``date_query``, ``meta_query`` and the simple meta variables, ``relation``,
    ``relation_query``, ``criteria``, ``aggregate``, ``groupby``, ``having``, ``count``,
    ``distinct``, ``fields``, ``orderby``, ``order``, ``number`` (100 by default, 0 for all),
    ``offset``, ``with`` (names, or ``{name: most}``), ``index_hints``.

    Filters that cannot be honoured match nothing; orders, aggregates and hints that
    cannot be honoured are left out with a warning.

    ``denied`` names columns that no result shows, whatever way it is asked for: rows,
    keys, single rows, groups, aggregates and orders do without them; ``table.column``
    denies one of a related table.  Filters may still name them.  Columns of type json
    with a declared shape are decoded to it, and collected rows decode the others too.
    """

    def __init__(self, catalog: Catalog, table: str, options: Options | None = None, hooks: Hooks | None = None, denied: frozenset[str] = frozenset(), cache_size: int = 0):
        self.catalog, self.table = catalog, catalog.tables[table]
        self.options, self.hooks, self.denied = options or Options(), hooks or Hooks(), denied
        self.cache_size = cache_size
        catalog.cache.most = max(catalog.cache.most, cache_size)

    @property
    def context(self) -> Context:
        return Context(self.catalog, self.table, self.options)

    @property
    def readable(self) -> Context:
        """As ``context``, but the table has no columns that may not be read."""
        hidden = [c.name for c in self.table.columns if c.name in self.denied]
        if not hidden:
            return self.context
        shown = self.table.without_columns(*hidden)
        return self.context.of(replace(shown, meta=None, by_name={}) if len(shown.primary) < len(self.table.primary) else shown)

    def _shown(self, df: DataFrame, table: str | None = None) -> DataFrame:
        """Without the columns that may not be read, of this or of a related table."""
        hidden = self.denied if table in (None, self.table.name) else {n.partition(".")[2] for n in self.denied if n.startswith(f"{table}.")}
        return df.drop(*[c for c in df.columns if c in hidden])

    def _decoded(self, df: DataFrame) -> DataFrame:
        """JSON columns of a declared shape in that shape."""
        for c in self.table.columns:
            if c.type == "json" and c.json and dict(df.dtypes).get(c.name) == "string":
                df = df.withColumn(c.name, decoded(F.col(c.name), c.json))
        return df

    def normalized(self, spec: Mapping[str, Any]) -> dict[str, Any]:
        """Hooks applied, ``by`` folded into ``{column}__in``, count mode reset."""
        out = dict(spec)
        for hook in self.hooks.before:
            out = hook(out)
        by = out.pop("by", None)
        if isinstance(by, Mapping):
            for name, value in by.items():
                column = self.table.column(name)
                if column is None or not column.in_:
                    self.context.warn("by", f"{name!r} cannot be looked up")
                elif value not in ("", None, []) and f"{column.name}__in" not in out:
                    out[f"{column.name}__in"] = value if isinstance(value, list | tuple) else [value]
        if out.get("count"):
            out |= {"number": 0, "offset": 0, "orderby": "none", "fields": ""}
        return out

    def _remote(self, table: TableSpec, spec: Mapping[str, Any]) -> DataFrame:
        return Query(self.catalog, table.name, self.options).rows(spec)

    def predicate(self, spec: Mapping[str, Any]) -> Pred | None:
        """All filters of a normalized specification; None if it has none."""
        ctx = self.context

        def asked(name: str) -> Mapping[str, Any]:
            out = spec
            for hook in self.hooks.before_filter.get(name, ()):
                out = hook(out)
            return out

        def told(name: str, pred: Pred | None) -> Pred | None:
            for hook in self.hooks.after_filter.get(name, ()):
                pred = hook(pred)
            return pred

        relation, members, joins, refused = relations.relation_filters(ctx, asked("relation"), self._remote)
        metadata, bad_meta = meta.meta_filters(ctx, asked("meta"))
        if refused or bad_meta:
            return never()
        found: dict[str, Pred | None] = {
            "by": columns.by_filters(ctx, asked("by")),
            "in": columns.in_filters(ctx, asked("in")),
            "not_in": columns.not_in_filters(ctx, asked("not_in")),
            "search": columns.search_filter(ctx, asked("search")),
            "date": dates.date_filters(ctx, asked("date")),
            "meta": metadata,
            "compare": columns.compare_filters(ctx, asked("compare")),
            "relation": relation,
        }
        if members is not None:
            found["in"] = group("AND", [found["in"], members])
        buckets = {n: Bucket(told(n, found[n]), joins and n == "relation") for n in BUCKETS}
        buckets |= {n: Bucket(told(n, parse(ctx, asked(n)))) for n, parse in self.hooks.parsers.items()}
        return combine_buckets(ctx, buckets, spec.get("criteria"))

    def matched(self, spec: Mapping[str, Any]) -> DataFrame:
        """The rows that pass all filters, without order, paging or projection."""
        df = apply(self.catalog.frame(self.table.name), self.predicate(spec))
        for hook in self.hooks.transform:
            df = hook(df)
        return df

    def query(self, spec: Mapping[str, Any] | None = None) -> DataFrame:
        """Aggregate mode, count mode or rows, as the specification asks."""
        out = self.normalized(spec or {})
        self._check_hints(out.get("index_hints"))
        if out.get("aggregate"):
            return aggregates.run(self.readable, self.matched(out), out)
        if out.get("count"):
            return self._count(out)
        return self._rows(out)

    def rows(self, spec: Mapping[str, Any] | None = None) -> DataFrame:
        return self._rows(self.normalized(spec or {}))

    def _count(self, spec: Mapping[str, Any]) -> DataFrame:
        df, groups = self.matched(spec), aggregates.group_columns(self.readable, spec.get("groupby"))
        if spec.get("distinct") and self.table.primary:
            one = F.countDistinct(*self.table.primary)
        else:
            one = F.count(F.lit(1))
        return (df.groupBy(*groups) if groups else df).agg(one.alias("count"))

    def _rows(self, spec: Mapping[str, Any]) -> DataFrame:
        ctx, df = self.readable, self.matched(spec)
        keys = self.table.primary
        groups = aggregates.group_columns(ctx, spec.get("groupby"))
        wanted = spec.get("with") or {}
        wanted = dict(wanted) if isinstance(wanted, Mapping) else dict.fromkeys(_names(wanted))
        wanted = {n: most for n, most in wanted.items() if self.table.relation(n)}
        if groups:
            # One row stands for each group: that with the smallest key, or, without a key, the smallest one.
            first = F.struct(*(keys or [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]))
            df = df.groupBy(*groups).agg(F.min_by(F.struct(*df.columns), first).alias("_qw_row")).select("_qw_row.*")
        if spec.get("distinct") and keys:
            df = df.dropDuplicates(list(keys))
        df, order, helpers = order_rows(ctx, df, spec)
        if wanted and self._number(spec):
            # The page is read once for its rows and once for their relations: its rows must be settled.
            order = [*order, *[F.col(k).asc() for k in keys or df.columns]]
        if order:
            df = df.orderBy(*order)
        df = self._paged(df, spec).drop(*helpers)
        for c in self.table.columns:
            if c.cast is not None and c.name in df.columns:
                df = df.withColumn(c.name, c.cast(F.col(c.name)))
        df = self._decoded(df)
        for name, most in wanted.items():
            df = relations.prefetch(self.context, df, name, most if isinstance(most, int) and most > 0 else None, self._shown)
        return self._projected(df, spec.get("fields"))

    def _number(self, spec: Mapping[str, Any]) -> int:
        """How many rows a page has, 0 for all; what is no number is read as 0."""
        number = spec.get("number", PAGE)
        told = whole_or(number, 0)
        if not isinstance(number, bool) and isinstance(number, str) and not told and number.strip() not in ("0", ""):
            self.context.warn("number", f"{number!r} is no number")
        return abs(told)

    def _paged(self, df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
        number = self._number(spec)
        if not number:
            return df
        offset = abs(whole_or(spec.get("offset"), 0))
        most = (1 << 31) - 1
        return (df.offset(min(offset, most)) if offset else df).limit(min(number, most))

    def _projected(self, df: DataFrame, fields: Any) -> DataFrame:
        able = [c for c in df.columns if c not in self.denied]
        if fields == "ids":
            return df.select(*[k for k in self.table.primary if k in able])
        wanted = [n for n in _names(fields) if n in able]
        if fields and not wanted:
            # Names that no column has are cut away, all of them: rows by key remain.
            wanted = [k for k in self.table.primary if k in able]
        return df.select(*(wanted or able)) if fields or len(able) < len(df.columns) else df

    def _check_hints(self, hints: Any) -> None:
        """Index hints change no result; those that could not be honoured are warned of."""
        if not hints:
            return
        known = {i.name for i in self.table.indexes} | {"primary", "PRIMARY"}
        kinds = set()
        for h in [hints] if isinstance(hints, Mapping) else hints:
            kind = str(h.get("type", "")).lower() if isinstance(h, Mapping) else ""
            names = _names(h.get("indexes")) if isinstance(h, Mapping) else []
            scope = str(h.get("for", "")).lower() if isinstance(h, Mapping) else ""
            if kind not in ("use", "force", "ignore") or not names or set(names) - known or scope not in ("", "join", "order by", "group by"):
                self.context.warn("index_hints", f"{h!r} is left out")
            kinds.add(kind)
        if {"use", "force"} <= kinds:
            self.context.warn("index_hints", "USE and FORCE do not go together")

    def get_results(self, fields: Any = None, where: Mapping[str, Any] | None = None, limit: int = 25, offset: int = 0) -> DataFrame:
        return self.query({**(where or {}), "fields": fields or "", "number": limit, "offset": offset})

    def select_primary_keys(self, spec: Mapping[str, Any]) -> DataFrame:
        """Distinct full keys of all matching rows."""
        return self._shown(self._keys(spec))

    def _keys(self, spec: Mapping[str, Any]) -> DataFrame:
        return self.matched(self.normalized(spec)).select(*self.table.primary).distinct()

    def related(self, name: str, spec: Mapping[str, Any] | None = None) -> DataFrame:
        """The remote rows related to the matching rows."""
        found = relations.related(self.context, self.matched(self.normalized(spec or {})), name)
        base = [c for c in found.columns if c.startswith("_base_") and c.removeprefix("_base_") in self.denied]
        far = [c for c in found.columns if not c.startswith("_base_")]
        shown = self._shown(found.select(*far), self.table.relation(name).table).columns
        return found.select(*[c for c in found.columns if c not in base and (c in shown or c not in far)])

    def get_item(self, key: Any) -> DataFrame:
        """The row of a primary key (a tuple for a composite one), or no row."""
        parts = key if isinstance(key, tuple) else (key,)
        df = self.catalog.frame(self.table.name)
        for name, value in zip(self.table.primary, parts, strict=True):
            df = df.filter(F.col(name) == F.lit(value))
        return self._shown(self._decoded(df.limit(1)))

    def get_item_by(self, column: str, value: Any) -> DataFrame:
        """The row with the smallest key of those that have a value, or no row."""
        spec = self.table.column(column)
        df = self.catalog.frame(self.table.name)
        df = df.filter(F.col(spec.name) == F.lit(value)) if spec else df.filter(F.lit(False))
        return self._shown(self._decoded((df.orderBy(*self.table.primary) if self.table.primary else df).limit(1)))

    def explain(self, spec: Mapping[str, Any], mode: str = "formatted") -> str:
        df = self.query(spec)
        return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    # The methods below run jobs.

    def collect(self, spec: Mapping[str, Any] | None = None) -> list[Any]:
        """Rows on the driver, shaped by the item hooks; bounded by ``number`` unless that is 0."""
        key = self.cache_key(spec or {}) if self.cache_size and (spec or {}).get("cache_results", True) else None
        rows = self.catalog.cache.get(key, lambda: self._python(self.query(spec).collect()))
        for hook in self.hooks.item:
            rows = [hook(r) for r in rows]
        for hook in self.hooks.items:
            rows = hook(rows)
        return rows

    def cache_key(self, spec: Mapping[str, Any]) -> str:
        """Equal for specifications that find the same rows of the same version of the catalog."""
        # Whole rows are kept here, not keys, so what shapes a row counts too.
        kept = {k: v for k, v in self.normalized(spec).items() if k not in NOT_IN_KEY or k in ("fields", "with")}
        return self._cache_key("rows", kept)

    def _cache_key(self, kind: str, about: Any) -> str:
        """Of a result of this query class; another generation of the catalog gives another key."""
        text = json.dumps([kind, self.table.name, self.catalog.generation(), sorted(self.denied), repr(self.options), about], sort_keys=True, default=str)
        return hashlib.md5(text.encode()).hexdigest()

    def _python(self, rows: Sequence[Any]) -> list[Any]:
        """Collected rows, with the JSON columns that are still text decoded."""
        texts = [c.name for c in self.table.columns if c.type == "json" and rows and isinstance(rows[0].asDict().get(c.name), str | None)]
        texts = [c for c in texts if c in rows[0]] if rows else []
        return [Row(**(r.asDict() | {c: read_json(r[c]) for c in texts})) if texts else r for r in rows]

    def item(self, key: Any) -> Any:
        """The row of a primary key on the driver, or None; looked up in the cache by id first."""
        cached = self._cache_key("item", key) if self.cache_size else None
        rows = self.catalog.cache.get(cached, lambda: self._python(self.get_item(key).collect()))
        for hook in self.hooks.item:
            rows = [hook(r) for r in rows]
        return rows[0] if rows else None

    def item_by(self, column: str, value: Any) -> Any:
        """The row that a value names, or None.

        For ``cache_key`` columns the cache holds the primary key that a value stands for;
        the row itself is cached by its key only.
        """
        spec = self.table.column(column)
        if spec is None or not spec.cache_key or len(self.table.primary) != 1 or not self.cache_size:
            rows = self._python(self.get_item_by(column, value).collect())
            return rows[0] if rows else None
        if (spec.name,) == self.table.primary:
            return self.item(value)
        key = self.table.primary[0]
        found = self.catalog.frame(self.table.name).filter(F.col(spec.name) == F.lit(value)).orderBy(key).select(key).limit(1)
        ids = self.catalog.cache.get(self._cache_key(f"by-{spec.name}", value), lambda: [r[0] for r in found.collect()])
        return self.item(ids[0]) if ids else None

    def count_rows(self, spec: Mapping[str, Any] | None = None) -> int:
        return self._count({**self.normalized(spec or {}), "groupby": None}).first()["count"]

    def page(self, spec: Mapping[str, Any]) -> Page:
        """One page with the number of all matching rows (of groups, with ``groupby``) and of pages."""
        out = self.normalized(spec)
        groups = aggregates.group_columns(self.readable, out.get("groupby"))
        matched = self.matched(out)
        for hook in self.hooks.found:
            matched = hook(matched)
        found = matched.select(*groups).distinct().count() if groups else matched.count()
        number = self._number(out)
        return Page(self.collect(spec), found, math.ceil(found / number) if number else 1)

    def _scalar(self, function: str, column: str, spec: Mapping[str, Any] | None) -> Any:
        asked = {**(spec or {}), "aggregate": {"value": [function, column]}, "groupby": None, "count": False}
        df = self.query(asked)
        return df.first()["value"] if "value" in df.columns else None

    def total(self, column: str, spec: Mapping[str, Any] | None = None) -> float | None:
        value = self._scalar("SUM", column, spec)
        return None if value is None else float(value)

    def average(self, column: str, spec: Mapping[str, Any] | None = None) -> float | None:
        value = self._scalar("AVG", column, spec)
        return None if value is None else float(value)

    def greatest(self, column: str, spec: Mapping[str, Any] | None = None) -> Any:
        return self._scalar("MAX", column, spec)

    def least(self, column: str, spec: Mapping[str, Any] | None = None) -> Any:
        return self._scalar("MIN", column, spec)

    def with_options(self, **changes: Any) -> Query:
        return Query(self.catalog, self.table.name, replace(self.options, **changes), self.hooks, self.denied, self.cache_size)


def _names(value: Any) -> list[str]:
    if not value:
        return []
    return [value] if isinstance(value, str) else [v for v in value if isinstance(v, str)]


