"""Relations over several hops, through pivots and under conditions; metadata queries."""

import pytest

from querywright.model.presets import meta_table
from querywright.model.schema import ColumnSpec as C
from querywright.model.schema import RelationSpec as R
from querywright.model.schema import TableSpec as T
from querywright.model.validation import catalog_errors, schema_errors
from querywright.plans.query import Query
from querywright.plans.relations import integrity
from querywright.sources.catalog import Catalog
from querywright.writes.metadata import MetaWriter


def key(name="id"):
    return C(name, "bigint", primary=True, sortable=True)


def ref(name, **more):
    return C(name, "bigint", allow_null=True, **more)


@pytest.fixture(scope="module")
def shop(spark):
    c = Catalog(spark)
    c.add(T("country", (key(), C("code"))), spark.createDataFrame([(1, "EUR"), (2, "USA")], "id long, code string"))
    c.add(T("tier", (key(), C("code"))), spark.createDataFrame([(1, "gold"), (2, "silver")], "id long, code string"))
    c.add(T("region", (key(), C("code"), ref("country_id")), relations=(R("country", "country", "belongs_to", ("country_id",), ("id",)),)), spark.createDataFrame([(1, "EU", 1), (2, "US", 2)], "id long, code string, country_id long"))
    customer = T(
        "customer",
        (key(), ref("region_id"), ref("tier_id"), C("status")),
        relations=(
            R("region", "region", "belongs_to", ("region_id",), ("id",)),
            R("tier", "tier", "belongs_to", ("tier_id",), ("id",)),
            R("orders", "order", "has_many", ("id",), ("customer_id",)),
            R("notes", "note", "has_many", ("id",), ("object_id",), (("object_type", "customer"),)),
        ),
    )
    c.add(customer, spark.createDataFrame([(1, 1, 1, "active"), (2, 2, 1, "active"), (3, 1, 2, "inactive")], "id long, region_id long, tier_id long, status string"))
    order = T(
        "order",
        (key(), ref("customer_id"), ref("parent_id")),
        relations=(
            R("customer", "customer", "belongs_to", ("customer_id",), ("id",)),
            R("parent", "order", "belongs_to", ("parent_id",), ("id",)),
            R("children", "order", "has_many", ("id",), ("parent_id",)),
            R("tags", "tag", "many_to_many", ("id",), ("id",), (), "order_tag", ("order_id",), ("tag_id",)),
        ),
    )
    c.add(order, spark.createDataFrame([(11, 1, None), (12, 2, 11), (13, 3, 11), (14, None, 99)], "id long, customer_id long, parent_id long"))
    c.add(T("tag", (key(), C("name"))), spark.createDataFrame([(1, "red"), (2, "blue")], "id long, name string"))
    c.add(T("order_tag", (key(), ref("order_id"), ref("tag_id"))), spark.createDataFrame([(1, 11, 1), (2, 11, 1), (3, 11, 2), (4, 12, 2)], "id long, order_id long, tag_id long"))
    c.add(T("note", (key(), ref("object_id"), C("object_type"), C("body"))), spark.createDataFrame([(1, 1, "customer", "a"), (2, 2, "order", "b")], "id long, object_id long, object_type string, body string"))
    return c


def ids(catalog, table, spec):
    return sorted(r["id"] for r in Query(catalog, table).query({"number": 0, **spec}).collect())


@pytest.mark.parametrize(
    ("table", "relation", "expected"),
    [
        ("order", {"name": "customer", "where": {"status": "active"}}, [11, 12]),
        ("order", {"name": "customer", "where": {"status": "active"}, "strategy": "join"}, [11, 12]),
        ("order", {"name": "customer", "exists": False}, [14]),
        ("order", {"name": "customer", "strategy": "join", "join": "left"}, [11, 12, 13, 14]),
        ("order", {"name": "customer", "relation": {"name": "region", "where": {"code": "EU"}}}, [11, 13]),
        ("order", {"name": "customer", "where": {"status": "active"}, "relation": {"name": "region", "where": {"code": "EU"}}}, [11]),
        ("order", {"name": "customer", "relation": {"name": "region", "exists": False, "where": {"code": "EU"}}}, [12]),
        ("order", {"name": "customer", "relation": {"name": "nothing"}}, []),
        ("order", {"name": "customer", "where": {"status": "active"}, "relation": {"name": "region", "relation": {"name": "country", "where": {"code": "EUR"}}}}, [11]),
        ("order", {"name": "customer", "relation": []}, []),
        ("order", {"name": "customer", "relation": [{"name": "region", "where": {"code": "EU"}}, {"name": "tier", "where": {"code": "gold"}}]}, [11]),
        ("order", {"name": "customer", "strategy": "in", "relation": {"name": "region"}}, []),
        ("order", {"name": "customer", "strategy": "join", "where": {"nothing": 1}}, []),
        ("order", {"name": "customer", "strategy": "join", "where": {"status": {"compare": "!=", "value": "active"}}}, [13]),
        ("order", "customer", []),
        ("order", {"name": "tags", "where": {"name": "blue"}}, [11, 12]),
        ("order", {"name": "tags", "exists": False}, [13, 14]),
        ("order", {"name": "tags"}, [11, 12]),
        ("order", {"name": "children", "strategy": "join"}, [11]),
        ("order", {"name": "parent"}, [12, 13]),
        ("customer", {"name": "notes"}, [1]),
        ("customer", {"name": "notes", "strategy": "in"}, []),
        ("customer", {"name": "orders", "strategy": "join", "exists": False}, []),
    ],
)
def test_relation_filters(shop, table, relation, expected):
    assert ids(shop, table, {"relation": relation}) == expected


def test_relation_groups(shop):
    either = {"relation": "OR", "clauses": [{"name": "tags", "where": {"name": "red"}}, {"name": "children"}]}
    assert ids(shop, "order", {"relation_query": either}) == [11]
    neither = {"relation_query": either, "criteria": {"not": True, "items": ["relation"]}}
    assert ids(shop, "order", neither) == [12, 13, 14]
    assert ids(shop, "order", {"relation_query": {"relation": "OR", "clauses": [{"name": "customer"}, {"name": "tags"}]}}) == []
    assert ids(shop, "order", {"relation_query": {"name": "customer"}, "criteria": {"relation": "OR", "items": ["relation", "by"]}}) == []


def test_pages_with_relations_are_settled_and_guarded(shop):
    rows = {r["id"]: r["children"] for r in Query(shop, "order").query({"with": {"children": 1, "nothing": 2}, "number": 2, "orderby": "none"}).collect()}
    assert {k: [c["id"] for c in v] for k, v in rows.items()} == {11: [12], 12: []}
    q = Query(shop, "customer", denied=frozenset({"status", "order.parent_id"}))
    kept = q.query({"with": ["orders"], "number": 0})
    assert "status" not in kept.columns and kept.schema["orders"].dataType.elementType.fieldNames() == ["id", "customer_id"]
    assert q.related("orders").columns == ["_base_id", "id", "customer_id"]
    no_key = Query(shop, "customer", denied=frozenset({"id"}))
    assert [len(r["orders"]) for r in no_key.query({"with": ["orders"], "number": 0}).collect()] == [1, 1, 1]
    assert no_key.query({"fields": "ids", "number": 0}).columns == [] and no_key.related("orders").columns == ["id", "customer_id", "parent_id"]


def test_related_and_prefetch(shop):
    q = Query(shop, "order")
    assert sorted((r["_base_id"], r["name"]) for r in q.related("tags").collect()) == [(11, "blue"), (11, "red"), (12, "blue")]
    assert sorted(r["id"] for r in Query(shop, "customer").related("notes").collect()) == [1]
    rows = {r["id"]: r["children"] for r in q.query({"with": ["children"], "number": 0}).collect()}
    assert [c["id"] for c in rows[11]] == [12, 13] and rows[12] == [] and rows[14] == []
    assert [r["id"] for r in integrity(q.context, "parent").collect()] == [14]


def test_composite_relation(spark):
    c = Catalog(spark)
    spec = T("cell", (C("region", "bigint"), C("account", "bigint"), C("kind")), relations=(R("mirror", "cell", "has_many", ("region", "account"), ("region", "account")),))
    c.add(spec, spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (None, 1, "b")], "region long, account long, kind string"))
    found = Query(c, "cell").query({"relation": {"name": "mirror", "where": {"kind": "b"}}, "number": 0, "orderby": "none"})
    assert sorted((r["region"], r["account"], r["kind"]) for r in found.collect()) == [(1, 1, "a"), (1, 1, "b")]


@pytest.fixture(scope="module")
def things(spark):
    thing = T("thing", (key(), C("label", sortable=True)))
    side, meta = meta_table(thing, "thing_meta")
    thing = T("thing", thing.columns, meta=meta)
    rows = [(1, 1, "color", "blue"), (2, 1, "size", "large"), (3, 1, "score", "10"), (4, 2, "color", "red"), (5, 2, "size", "large"), (6, 2, "score", "100"), (7, 3, "size", "small"), (8, 3, "score", "9"), (9, 1, "score", "999")]
    c = Catalog(spark).add(thing, spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, label string"))
    return c.add(side, spark.createDataFrame(rows[:8], "meta_id long, thing_id long, meta_key string, meta_value string"))


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        ({"meta_query": [{"key": "color", "value": "blue"}]}, "A"),
        ({"meta_key": "color", "meta_value": "blue"}, "A"),
        ({"meta_query": {"relation": "OR", "clauses": [{"key": "color", "value": "blue"}, {"key": "size", "value": "small"}]}}, "AC"),
        ({"meta_query": [{"key": "color", "compare": "EXISTS"}]}, "AB"),
        ({"meta_query": [{"key": "color", "compare": "NOT EXISTS"}]}, "C"),
        ({"meta_query": [{"key": "score", "value": "10", "compare": ">=", "type": "NUMERIC"}]}, "AB"),
        ({"meta_query": [{"key": "color", "value": "lu", "compare": "LIKE"}]}, "A"),
        ({"meta_query": [{"key": "color", "value": ["blue", "red"]}]}, "AB"),
        ({"meta_query": [{"key": "score", "value": [10, 100], "compare": "BETWEEN", "type": "NUMERIC"}]}, "AB"),
        ({"meta_query": [{"key": "color", "value": "^b", "compare": "REGEXP"}]}, "A"),
        ({"meta_query": [{"key": "color", "value": "x", "compare": "IS NULL"}]}, ""),
        ({"meta_query": [{"key": "color", "compare": "IS NOT NULL"}]}, "AB"),
        ({"meta_query": [{"key": "color", "value": "blue", "compare": "!="}]}, "B"),
        ({"meta_query": [{"key": "color", "value": ["blue", "green"], "compare": "NOT IN"}]}, "B"),
        ({"meta_query": [{"key": "color", "value": "blue"}, "nonsense"]}, ""),
        ({"meta_query": [{"key": "color", "compare_key": "!="}]}, "C"),
        ({"meta_query": [{"key": "color", "compare_key": "!=", "value": "red"}]}, ""),
        ({"meta_query": [{"key": "s", "compare_key": "LIKE", "value": "small"}]}, "C"),
    ],
)
def test_meta_filters(things, spec, expected):
    rows = Query(things, "thing").query({"number": 0, **spec}).collect()
    assert "".join(sorted(r["label"] for r in rows)) == expected


def test_meta_order(things):
    def order(by, clause=None):
        spec = {"meta_query": clause or [{"key": "score"}], "orderby": {by: "ASC"}}
        return "".join(r["label"] for r in Query(things, "thing").query(spec).collect())

    assert order("meta_value") == "ABC"
    assert order("meta_value_num") == "CAB"
    assert order("points", {"clauses": {"points": {"key": "score", "type": "NUMERIC"}}}) == "CAB"


def test_meta_writes(things):
    w = MetaWriter(things, things.tables["thing"].meta)

    def values(df, thing=1):
        return sorted((r["meta_key"], r["meta_value"]) for r in df.collect() if r["thing_id"] == thing)

    assert ("new", "[1, 2]") in values(w.add(1, "new", [1, 2]))
    assert values(w.add(1, "color", "green", unique=True)) == values(w.rows)
    assert ("color", "green") in values(w.update(1, "color", "green"))
    assert values(w.update(1, "color", "green", previous="red")) == values(w.rows)
    assert ("fresh", "x") in values(w.update(1, "fresh", "x"))
    assert ("color", "blue") not in values(w.delete(1, "color"))
    assert w.delete(None, "size", everywhere=True).count() == 5
    assert values(w.delete_object(1)) == []
    assert w.get(1, "score", single=True).first()["meta_value"] == "10"
    assert values(w.save(1, {"color": "", "size": "tiny"})) == [("score", "10"), ("size", "tiny")]


def test_declaration_errors(shop):
    assert [e for t in shop.tables.values() for e in schema_errors(t)] == []
    assert catalog_errors(shop.tables) == []
    bad = T("bad", (C("a", "bigint", primary=True, extra="auto_increment"), C("b", primary=True), C("a", "nonsense")), relations=(R("x", "nowhere", "belongs_to", ("zz",), ("id",)),))
    codes = {c for c, _ in schema_errors(bad)}
    assert {"column_duplicate", "column_invalid_type", "primary_composite_auto_increment", "relationship_unknown_column"} <= codes
    assert catalog_errors({"bad": bad}) == [("relationship_unknown_table", "bad.x")]
