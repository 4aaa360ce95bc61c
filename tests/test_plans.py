"""What the plans look like: filters and columns reach the scan, existence tests are semi-joins."""

import re

import pytest

from querywright.model.schema import ColumnSpec as C
from querywright.model.schema import RelationSpec as R
from querywright.model.schema import TableSpec as T
from querywright.plans.query import Query
from querywright.sources.catalog import Catalog


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    spark.range(100).selectExpr("id", "id % 7 AS kind", "id % 10 AS owner_id", "'x' AS note").write.parquet(f"{root}/item")
    spark.range(10).selectExpr("id", "id % 3 AS grade").write.parquet(f"{root}/owner")
    item = T("item", (C("id", "bigint", primary=True, sortable=True), C("kind", "bigint"), C("owner_id", "bigint"), C("note")), relations=(R("owner", "owner", "belongs_to", ("owner_id",), ("id",)),))
    owner = T("owner", (C("id", "bigint", primary=True), C("grade", "bigint")), relations=(R("items", "item", "has_many", ("id",), ("owner_id",)),))
    return Catalog(spark).add_parquet(item, f"{root}/item").add_parquet(owner, f"{root}/owner")


def test_filters_and_columns_reach_the_scan(catalog):
    plan = Query(catalog, "item").explain({"kind": 3, "relation": {"name": "owner", "where": {"grade": 1}}, "fields": "ids", "number": 0, "orderby": "none"})
    assert re.search(r"PushedFilters: \[.*EqualTo\(kind,3\)", plan) and re.search(r"PushedFilters: \[.*EqualTo\(grade,1\)", plan)
    assert "note" not in plan and "LeftSemi" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_absence_is_an_anti_join(catalog):
    assert "LeftAnti" in Query(catalog, "owner").explain({"relation": {"name": "items", "exists": False}, "number": 0})


def test_alternatives_keep_rows_single(catalog):
    q = Query(catalog, "owner")
    spec = {"relation_query": {"relation": "OR", "clauses": [{"name": "items", "where": {"kind": 1}}, {"name": "items", "where": {"kind": 2}}]}, "number": 0}
    plan = q.explain(spec)
    assert "LeftOuter" in plan and "NestedLoop" not in plan
    assert q.query(spec).count() == len({r["id"] for r in q.query(spec).collect()})


def test_refused_filters_read_nothing(catalog):
    plan = Query(catalog, "item").explain({"compare_query": {"key": "nothing", "value": 1}, "number": 0})
    assert "Scan parquet" not in plan


def test_pages_take_the_first_rows_only(catalog):
    assert "TakeOrdered" in Query(catalog, "item").explain({"orderby": "id", "number": 5})
