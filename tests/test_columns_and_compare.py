"""Filters by column, comparison trees and operands over a small table."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from querywright.model.presets import created, identifier, modified, uuid
from querywright.model.schema import ColumnSpec, TableSpec
from querywright.operators.comparison import STANDARD, Comparison, Comparisons
from querywright.plans.columns import split_value
from querywright.plans.context import Options
from querywright.plans.query import Query
from querywright.sources.catalog import Catalog
from tests.conftest import NOW, names

C = ColumnSpec

WIDGETS = TableSpec(
    "widget",
    (
        identifier("id", compare=True),
        ColumnSpec("name", "varchar", 200, searchable=True, sortable=True),
        ColumnSpec("status", "varchar", 20, sortable=True, transition=True),
        ColumnSpec("priority", "bigint", 20, sortable=True, compare=True, allow_null=True),
        created(),
        modified(),
        uuid(),
    ),
)
ROWS = [
    (1, "Alpha Widget", "active", 10, datetime(2024, 1, 1, 8, 0), datetime(2024, 2, 1), "u1"),
    (2, "Beta Widget", "active", 20, datetime(2024, 6, 15, 12, 30), datetime(2024, 6, 15), "u2"),
    (3, "Gamma Gadget", "inactive", 30, datetime(2024, 12, 31, 23, 59, 59), datetime(2025, 1, 1), "u3"),
    (4, "Delta Gadget", "pending", 40, datetime(2025, 3, 9), datetime(2025, 3, 9), "u4"),
    (5, "100% Epsilon", "pending", None, datetime(2025, 3, 10, 9, 30, 15), datetime(2025, 3, 10), "u5"),
]


@pytest.fixture(scope="module")
def widgets(spark):
    schema = "id long, name string, status string, priority long, date_created timestamp_ntz, date_modified timestamp_ntz, uuid string"
    return Query(Catalog(spark).add(WIDGETS, spark.createDataFrame(ROWS, schema)), "widget", Options(now=NOW))


def ids(query, spec):
    return sorted(r["id"] for r in query.query({"number": 0, **spec}).collect())


def col(name, **more):
    return {"operand": "column", "name": name, **more}


def func(name, *args, **more):
    return {"operand": "func", "name": name, "args": list(args), **more}


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (None, []),
        ([], []),
        ("a", ["a"]),
        ("a,b", ["a", "b"]),
        ("a, b", ["a", "b"]),
        ("a sentence, with a comma", ["a sentence, with a comma"]),
        ("a" * 20 + ",b", ["a" * 20 + ",b"]),
        ("a," + "b" * 200, ["a," + "b" * 200]),
        ([1, 2], [1, 2]),
        (0, [0]),
    ],
)
def test_split_value(value, expected):
    assert split_value(value) == expected


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        ({"status": "active"}, [1, 2]),
        ({"status": "active,pending"}, [1, 2, 4, 5]),
        ({"status__in": ["active", "inactive"]}, [1, 2, 3]),
        ({"status__in": []}, [1, 2, 3, 4, 5]),
        ({"priority__not_in": [10, 20]}, [3, 4]),
        ({"uuid__in": ["u1"]}, [1, 2, 3, 4, 5]),
        ({"by": {"status": "inactive"}}, [3]),
        ({"by": {"status": "inactive"}, "status__in": ["active"]}, [1, 2]),
        ({"by": {"uuid": "u1", "nothing": 3}}, [1, 2, 3, 4, 5]),
        ({"search": "Widget"}, [1, 2]),
        ({"search": "a*Gadget"}, [3, 4]),
        ({"search": "100%"}, [5]),
        ({"search": "0_"}, []),
        ({"priority_compare": {"compare": ">=", "value": 30}}, [3, 4]),
        ({"priority_compare": [10, 30]}, [1, 3]),
        ({"priority_compare": 40}, [4]),
        ({"status_compare": {"compare": "!=", "value": "active"}}, [1, 2, 3, 4, 5]),
    ],
)
def test_column_filters(widgets, spec, expected):
    assert ids(widgets, spec) == expected


@pytest.mark.parametrize(
    ("clause", "expected"),
    [
        ({"key": "priority", "value": 20}, [2]),
        ({"key": "priority", "value": [10, 20]}, [1, 2]),
        ({"key": "priority", "value": "20abc"}, [2]),
        ({"key": "priority", "value": 20, "compare": "nonsense"}, [2]),
        ({"key": "nothing", "value": 20}, []),
        ({"key": "priority", "value": 20, "cast": "NONSENSE"}, []),
        ({"key": "priority", "value": [], "compare": "IN"}, [1, 2, 3, 4, 5]),
        ({"key": "priority", "value": [5], "compare": "BETWEEN"}, [1, 2, 3, 4, 5]),
        ({"key": "priority", "compare": "NOT EXISTS", "value": 1}, [1, 2, 3, 4, 5]),
        ({"key": "priority", "compare": "="}, [1, 2, 3, 4, 5]),
        ({"key": "priority", "compare": "IS NULL"}, [5]),
        ({"key": "priority", "compare": "is  not null"}, [1, 2, 3, 4]),
        ({"key": "status", "value": "  active "}, [1, 2]),
        ({"key": "status", "value": "ACTIVE"}, []),
        ({"key": "name", "value": "Wid", "compare": "LIKE"}, [1, 2]),
        ({"key": "name", "value": "%", "compare": "LIKE"}, [5]),
        ({"key": "name", "value": "^[AB]", "compare": "REGEXP"}, [1, 2]),
        ({"relation": "XOR", "clauses": [{"key": "status", "value": "active"}, {"key": "priority", "value": 20, "compare": ">="}]}, [1, 3, 4]),
        ({"relation": "nonsense", "clauses": [{"key": "status", "value": "active"}, {"key": "priority", "value": 20}]}, [2]),
        (["OR", {"key": "id", "value": 1}, ["AND", {"key": "id", "value": 2}, {"key": "status", "value": "active"}]], [1, 2]),
    ],
)
def test_compare_clauses(widgets, clause, expected):
    assert ids(widgets, {"compare_query": clause}) == expected


@pytest.mark.parametrize(
    ("key", "compare", "value", "expected"),
    [
        (col("date_modified"), ">", col("date_created"), [1, 3]),
        (func("LOWER", col("name")), "=", "beta widget", [2]),
        (func("nope", col("name")), "=", "x", []),
        (func("LOWER", col("name"), col("name")), "=", "x", []),
        (func("ABS", col("name")), "=", 1, []),
        (func("YEAR", col("priority")), "=", 1, []),
        (func("GREATEST", col("id"), col("priority")), ">", 15, [2, 3, 4]),
        (func("COALESCE", col("priority"), 99), ">", 35, [4, 5]),
        ({"operand": "math", "operator": "*", "values": [col("priority"), {"operand": "value", "value": 2, "pattern": "%d"}]}, ">", 50, [3, 4]),
        ({"operand": "math", "operator": "/", "values": [col("priority"), {"operand": "math", "operator": "-", "values": [col("id"), col("id")]}]}, ">", 0, []),
        ({"operand": "math", "operator": "%", "values": [col("priority"), col("id")]}, ">", 0, []),
        ({"operand": "value", "value": 3}, "=", 3, []),
        (col("id"), "IN", {"operand": "list", "values": [1, col("id"), "9"]}, [1, 2, 3, 4, 5]),
        (col("id"), "BETWEEN", {"operand": "range", "bounds": [2, 3]}, [2, 3]),
        (col("id"), "=", {"operand": "range", "bounds": [2, 3]}, []),
        ({"operand": "tuple", "values": [col("status"), col("priority")]}, "=", {"operand": "tuple", "values": ["active", {"operand": "value", "value": 10, "pattern": "%d"}]}, [1]),
        ({"operand": "tuple", "values": [col("status"), col("priority")]}, "=", {"operand": "tuple", "values": ["active"]}, []),
        ({"operand": "tuple", "values": [col("status"), col("id")]}, "<", {"operand": "tuple", "values": ["inactive", {"operand": "value", "value": 1, "pattern": "%d"}]}, [1, 2]),
        (func("LOWER", col("name"), cast="CHAR(5)"), "=", "alpha", [1]),
        (func("DATE_ADD", col("date_created"), {"operand": "interval", "unit": "MONTH", "amount": 1}), ">", "2025-04-01", [4, 5]),
        (func("DATE_ADD", col("date_created"), {"operand": "interval", "unit": "EON", "amount": 1}), ">", "2025-04-01", []),
        (func("DATE_FORMAT", col("date_created"), "%Y-%m-%d %H:%i:%s"), "=", "2025-03-10 09:30:15", [5]),
        (func("CONCAT", col("status"), "!", col("id")), "=", "pending!4", [4]),
    ],
)
def test_operands(widgets, key, compare, value, expected):
    assert ids(widgets, {"compare_query": {"key": key, "compare": compare, "value": value}}) == expected


def test_folded_text(widgets):
    folded = widgets.with_options(collation="ci")
    assert ids(folded, {"status": "ACTIVE"}) == [1, 2]
    assert ids(folded, {"search": "wIDGET"}) == [1, 2]
    assert ids(folded, {"compare_query": {"key": "name", "compare": "REGEXP", "value": "^alpha"}}) == [1]
    assert ids(folded, {"compare_query": {"key": "status", "value": "ACTIVE", "cast": "BINARY"}}) == []


def test_operator_registry():
    ops = Comparisons()
    assert len(STANDARD) == 19
    assert ops.names(unary=True) == ["IS NULL", "IS NOT NULL"]
    for op in STANDARD:
        if op.opposite:
            assert ops.get(op.opposite).opposite == op.name
            assert ops.get(op.opposite).negative != op.negative or op.numeric or op.unary


def test_custom_operator_and_parser(spark, widgets):
    starts = Comparison("STARTS", lambda left, value, lit, fold: left.startswith(str(value)))
    own = widgets.with_options(comparisons=Comparisons().with_operator(starts))
    assert ids(own, {"compare_query": {"key": "name", "compare": "starts", "value": "Ga"}}) == [3]


@pytest.mark.parametrize(
    ("tree", "expected"),
    [
        ({"relation": "OR", "items": ["columns", "compare"]}, [1, 2, 4]),
        ({"relation": "AND", "items": ["columns", "compare"]}, []),
        ({"relation": "OR", "not": True, "items": ["columns", "compare"]}, [3]),
        (["columns", {"not": True, "items": ["compare"]}], [1, 2]),
        ({"relation": "NAND", "items": ["columns"]}, []),
        ({"items": []}, []),
        ({"items": ["bogus"]}, []),
        ("OR", []),
        ({"relation": "OR", "items": ["columns", "search"]}, []),
    ],
)
def test_criteria(widgets, tree, expected):
    spec = {"status": "active", "compare_query": {"key": "priority", "compare": ">=", "value": 40}, "criteria": tree}
    assert ids(widgets, spec) == expected


@pytest.mark.parametrize(
    ("node", "expected"),
    [
        ({"after": "2024-06"}, [3, 4, 5]),
        ({"after": "2024-06", "inclusive": True}, [2, 3, 4, 5]),
        ({"before": "2024-06-15"}, [1]),
        ({"before": "2024", "inclusive": True}, [1, 2, 3]),
        ({"year": 2025}, [4, 5]),
        ({"month": [1, 12]}, [1, 3]),
        ({"year": "x"}, [1, 2, 3, 4, 5]),
        ({"dayofweek": 1}, [4]),
        ({"dayofweek_iso": 7}, [4]),
        ({"hour": 9, "minute": 30, "compare": ">="}, [2, 3, 5]),
        ({"hour": 9, "second": 15}, [1, 2, 3, 4, 5]),
        ({"hour": [8, 12], "minute": [0, 30], "compare": "IN"}, [1, 2]),
        ({"month": 13}, []),
        ({"column": "nothing", "year": 2024}, []),
        ({"after": "gibberish"}, []),
        ({"value": "2025-03-09", "compare": ">="}, [4, 5]),
        ({"value": [], "compare": "IN"}, []),
        ({"after": "-400 days"}, [4, 5]),
        ({"relation": "OR", "clauses": [{"year": 2024, "month": 1}, {"year": 2025, "day": 10}]}, [1, 5]),
    ],
)
def test_dates(widgets, node, expected):
    assert ids(widgets, {"date_query": node}) == expected


def test_date_column_variable(widgets):
    assert ids(widgets, {"date_modified_query": {"year": 2025, "month": 1}}) == [3]


def test_weeks_follow_the_calendar(spark):
    from datetime import date, timedelta

    from pyspark.sql import functions as F

    from querywright.functions.scalar import start_of_week, week

    days = [date(2015, 1, 1) + timedelta(days=k) for k in range(365 * 6)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for r in df.select("d", week(F.col("d"), 0).alias("a"), week(F.col("d"), 1).alias("b"), start_of_week(F.col("d"), 3).alias("c")).collect():
        first = r["d"].replace(month=1, day=1)
        monday = int(r["d"].strftime("%W"))
        assert r["a"] == int(r["d"].strftime("%U"))
        assert r["b"] == monday + (1 if 1 <= first.weekday() <= 3 else 0)
        assert r["c"] == int((r["d"] - timedelta(days=3)).strftime("%U"))


def test_order_paging_and_projection(widgets):
    def order(spec):
        return [r["id"] for r in widgets.query(spec).collect()]

    assert order({"number": 2}) == [5, 4]
    assert order({"orderby": "id", "order": "ASC", "number": 2, "offset": 1}) == [2, 3]
    assert order({"orderby": {"priority": "ASC"}}) == [5, 1, 2, 3, 4]
    assert order({"orderby": {"priority": "ASC NULLS LAST"}}) == [1, 2, 3, 4, 5]
    assert order({"orderby": {"priority": "DESC NULLS FIRST"}}) == [5, 4, 3, 2, 1]
    assert order({"id__in": [3, 1, 2], "orderby": "id__in", "order": "ASC"}) == [3, 1, 2]
    assert order({"id__in": [3, 1, 2], "orderby": "id__in"}) == [2, 1, 3]
    assert order({"orderby": [func("LENGTH", col("status")), "id"], "order": "ASC"}) == [1, 2, 4, 5, 3]
    assert order({"id": 1, "number": -1}) == [1]
    page = widgets.page({"number": 2, "orderby": "id", "order": "ASC"})
    assert (len(page.rows), page.found, page.pages) == (2, 5, 3)
    assert widgets.query({"fields": ["name", "nothing"]}).columns == ["name"]
    assert widgets.query({"fields": "ids"}).columns == ["id"]
    assert widgets.query({"fields": ["nothing"]}).columns == ["id"]
    assert "uuid" not in Query(widgets.catalog, "widget", denied=frozenset({"uuid"})).query({}).columns


def test_aggregates(widgets):
    def one(spec):
        return [r.asDict() for r in widgets.query(spec).collect()]

    assert one({"aggregate": {"total": ["sum", "priority"], "peak": ["max", "priority"]}}) == [{"total": 100, "peak": 40}]
    assert one({"aggregate": {"n": ["count", "*"], "t": ["sum", "priority"]}, "status": "none"}) == [{"n": 0, "t": None}]
    assert one({"aggregate": {"kinds": {"function": "count", "column": "status", "distinct": True}}}) == [{"kinds": 3}]
    assert one({"aggregate": {"n": {"function": "count", "column": "*", "distinct": True}}}) == []
    assert one({"aggregate": {"n": {"function": "sum", "column": "priority", "distinct": True}, "m": ["count", "id"]}}) == [{"m": 5}]
    assert one({"aggregate": {"n": ["count", "*"]}, "groupby": "status", "having": {"n": [">", 1]}, "orderby": {"status": "ASC"}}) == [{"status": "active", "n": 2}, {"status": "pending", "n": 2}]
    assert one({"aggregate": {"sum": "priority"}, "groupby": "nothing"}) == [{"sum": 100}]
    assert one({"aggregate": {"status": ["count", "*"], "n": ["count", "*"]}, "groupby": "status", "orderby": {"n": "DESC", "status": "ASC"}})[0] == {"status": "active", "n": 2}
    assert widgets.total("priority") == 100.0
    assert widgets.average("priority", {"status": "active"}) == 15.0
    assert widgets.greatest("name") == "Gamma Gadget"
    assert widgets.least("priority", {"status": "none"}) is None
    assert widgets.count_rows({"status": "active"}) == 2
    assert one({"count": True, "groupby": "status", "number": 1})[0].keys() == {"status", "count"}
    assert sorted(r["id"] for r in widgets.query({"groupby": "status", "number": 0}).collect()) == [1, 3, 4]


def test_hooks_and_cache(spark, widgets):
    from querywright.plans.pred import Expr
    from querywright.plans.query import Hooks

    hooks = Hooks()
    hooks.before.append(lambda s: s | {"status": "active"})
    hooks.item.append(lambda r: r["name"])
    hooks.parsers["even"] = lambda ctx, spec: Expr(ctx.expression(ctx.table.column("id")) % 2 == 0) if spec.get("even") else None
    q = Query(widgets.catalog, "widget", Options(now=NOW), hooks, cache_size=2)
    assert sorted(q.collect({})) == ["Alpha Widget", "Beta Widget"]
    assert q.collect({"even": True}) == ["Beta Widget"]
    assert q.cache_key({"orderby": "id"}) == q.cache_key({"orderby": "id", "index_hints": {"type": "use", "indexes": ["primary"]}})
    before = q.cache_key({})
    widgets.catalog.changed()
    assert q.cache_key({}) != before
    assert "Filter" in widgets.explain({"status": "active"})


def test_hooks_around_filters_and_found_rows(spark, widgets):
    from querywright.plans.pred import Expr
    from querywright.plans.query import Hooks

    hooks = Hooks(before_filter={"by": [lambda s: {**s, "status": "active"}]}, after_filter={"search": [lambda p: Expr(F.col("id") > 1)]})
    hooks.found.append(lambda df: df.where("id = 0"))
    q = Query(widgets.catalog, "widget", Options(now=NOW), hooks)
    assert [r["id"] for r in q.query({"status": "nothing", "orderby": "id", "order": "ASC"}).collect()] == [2]
    page = q.page({"number": 10})
    assert len(page.rows) == 1 and page.found == 0


def test_caches_by_query_by_id_and_by_value(spark, widgets):
    from dataclasses import replace

    spec = widgets.catalog.tables["widget"]
    catalog = Catalog(spark).add(spec.with_columns(replace(spec.column("name"), cache_key=True)), widgets.catalog.frame("widget"))
    q = Query(catalog, "widget", Options(now=NOW), cache_size=8)
    first = q.item(2)
    assert q.item(2) == first and catalog.cache.hits == 1 and q.item(99) is None
    assert q.item_by("name", first["name"]) == first and catalog.cache.hits == 2
    assert q.item_by("name", first["name"]) == first and catalog.cache.hits == 4
    # Another query object shares the cache, one that may not read a column does not.
    assert Query(catalog, "widget", Options(now=NOW), cache_size=8).item(2) == first and catalog.cache.hits == 5
    assert "name" not in Query(catalog, "widget", Options(now=NOW), denied=frozenset({"name"}), cache_size=8).item(2)
    rows, hits = q.collect({"status": "active"}), catalog.cache.hits
    assert q.collect({"status": "active"}) == rows and catalog.cache.hits == hits + 1
    assert q.collect({"status": "active", "cache_results": False}) == rows and catalog.cache.hits == hits + 1
    catalog.changed()
    assert q.collect({"status": "active"}) == rows and catalog.cache.hits == hits + 1
    assert len(catalog.cache.held) <= 8


def test_writes_anywhere_make_cached_results_unreachable(spark, tmp_path):
    from querywright.writes.store import ParquetStore

    spec = TableSpec("kept", (C("id", "bigint", primary=True), C("v", "varchar", 10)))
    store = ParquetStore(spark, str(tmp_path / "kept"))
    store.replace(spark.createDataFrame([(1, "a")], spec.struct()))
    q = Query(Catalog(spark).add_stored(spec, store), "kept", cache_size=4)
    assert [tuple(r) for r in q.collect({})] == [(1, "a")]
    # Another process has a store of its own over the same folder.
    ParquetStore(spark, str(tmp_path / "kept")).append(spark.createDataFrame([(2, "b")], spec.struct()))
    assert sorted(tuple(r) for r in q.collect({})) == [(1, "a"), (2, "b")] and q.item(2)["v"] == "b"


@pytest.mark.parametrize("denied", ["name", "id", "priority"])
def test_denied_columns_are_shown_in_no_way(widgets, denied):
    q = Query(widgets.catalog, "widget", Options(now=NOW), denied=frozenset({denied}))
    shown = [
        q.query({"number": 0}), q.query({"fields": [denied, "status"]}), q.query({"fields": "ids"}), q.get_item(1), q.get_item_by("status", "active"),
        q.query({"aggregate": {"top": ["max", denied], "n": ["count", "*"]}}), q.query({"aggregate": {"n": ["count", "*"]}, "groupby": denied}),
        q.query({"count": True, "groupby": denied}), q.query({"orderby": denied}), q.query({"distinct": True}), q.select_primary_keys({"status": "active"}),
    ]
    for df in shown:
        assert denied not in df.columns and "top" not in df.columns
    assert shown[0].count() == 5 and shown[6].columns == ["n"] and shown[6].first()["n"] == 5
    # Filters may name it still.
    assert q.query({denied: q.catalog.frame("widget").first()[denied], "number": 0}).count() >= 1


def test_what_cannot_be_read_never_fails_a_job(widgets):
    def ids(spec):
        return sorted(r["id"] for r in widgets.query({"number": 0, **spec}).collect())

    everything = ids({})
    for op in ("REGEXP", "RLIKE", "NOT REGEXP"):
        assert ids({"compare_query": {"key": "name", "compare": op, "value": "["}}) == []
    big = str(10**30)
    assert ids({"id": big}) == [] and ids({"id__in": [big, 1]}) == [1] and ids({"id__not_in": [int(big), 10**50]}) == everything
    assert ids({"compare_query": {"key": "priority", "compare": "<", "value": 10**400}}) == [1, 2, 3, 4]
    assert len(ids({"number": "abc"})) == len(everything) and len(widgets.query({"number": "2x"}).collect()) == 2
    assert widgets.query({"number": 1, "offset": "z"}).count() == 1 and widgets.query({"number": 10**12}).count() == len(everything)
    assert ids({"date_query": {"week": 99, "start_of_week": "x"}}) == []
    far = {"operand": "func", "name": "DATE_ADD", "args": [{"operand": "column", "name": "date_created"}, {"operand": "interval", "amount": 10**9, "unit": "YEAR"}]}
    assert ids({"compare_query": {"key": far, "compare": ">", "value": "2000-01-01"}}) == []
    far["args"][1]["amount"] = 10**12
    assert ids({"compare_query": {"key": far, "compare": ">", "value": "2000-01-01"}}) == []


def test_parts_that_no_date_has_are_told():
    from querywright.plans.dates import part_errors

    assert part_errors({"month": 13, "hour": [1, 24], "minute": "x", "year": 2024, "dayofyear": 366, "day": 3}) == ["month: 13", "hour: [1, 24]", "minute: 'x'"]
    assert part_errors({"year": 2023, "dayofyear": 366, "week": 53}) == ["week: 53", "dayofyear: 366"] and part_errors({"year": 2020, "week": 53}) == []
    assert part_errors({"month": 2, "day": 30}) == ["day: 2-30"] and part_errors({"month": 2, "day": 29}) == [] and part_errors({"year": 2023, "month": 2, "day": 29}) == ["day: 2-29"]
    assert part_errors({"after": {"month": 0}, "before": "1996"}) == ["after: month: 0"]


def test_json_columns_are_decoded(spark):
    spec = TableSpec("j", (C("id", "bigint", primary=True), C("a", "json", json="struct<k: bigint>"), C("b", "json")))
    rows = spark.createDataFrame([(1, '{"k": 3}', '{"x": [1, 2]}'), (2, "nonsense", "nonsense"), (3, None, None)], "id long, a string, b string")
    q = Query(Catalog(spark).add(spec, rows), "j")
    assert [r["a"]["k"] for r in q.query({"orderby": "none"}).collect()] == [3, None, None]
    assert [r["b"] for r in q.collect({"orderby": "none"})] == [{"x": [1, 2]}, [], None]
    assert q.item(1)["b"] == {"x": [1, 2]} and q.get_item(1).first()["a"]["k"] == 3


def test_names_helper(widgets):
    assert names(widgets.query({"status": "inactive"})) == ["Gamma Gadget"]
