"""The registered queries: a specification and, beside it, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywright.ddl.diff import compare
from querywright.model.schema import ColumnSpec, IndexSpec
from querywright.plans.context import Options
from querywright.plans.query import Query
from querywright.tables import TABLES, sample_catalog
from querywright.writes.items import Writer
from querywright.writes.metadata import MetaWriter

Spec = dict[str, Any]
Runner = Callable[[SparkSession, str], DataFrame]

NOW = datetime(1998, 6, 15, 12, 30, 0)
OPTIONS = Options(now=NOW)
QUERIES: dict[str, Runner] = {}
SQL: dict[str, str] = {}


def register(name: str, table: str, spec: Spec, sql: str, options: Options = OPTIONS) -> None:
    """A query that is one specification over one table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Query(sample_catalog(spark, sf_dir), table, options).query({"number": 0, "orderby": "none"} | spec)

    QUERIES[name], SQL[name] = run, " ".join(sql.split())


def col(name: str, **more: Any) -> Spec:
    return {"operand": "column", "name": name, **more}


def func(name: str, *args: Any, **more: Any) -> Spec:
    return {"operand": "func", "name": name, "args": list(args), **more}


def math(sign: str, *values: Any) -> Spec:
    return {"operand": "math", "operator": sign, "values": list(values)}


def number(value: Any) -> Spec:
    return {"operand": "value", "value": value, "pattern": "%f" if isinstance(value, float) else "%d"}


def interval(amount: int, unit: str) -> Spec:
    return {"operand": "interval", "amount": amount, "unit": unit}


def where(key: Any, compare: str, value: Any = None, **more: Any) -> Spec:
    clause = {"key": key, "compare": compare, **more}
    return {"compare_query": clause if value is None else clause | {"value": value}}


# The flagship: a grouped aggregate over lines whose order, customer, nation and region qualify.
register(
    "flagship",
    "lineitem",
    {
        "relation": {"name": "order", "relation": {"name": "customer", "relation": {"name": "nation", "relation": {"name": "region", "where": {"r_name": "ASIA"}}}}},
        "aggregate": {"n": ["count", "*"], "quantity": ["sum", "l_quantity"], "peak": ["max", "l_extendedprice"]},
        "groupby": ["l_returnflag", "l_linestatus"],
        "having": {"n": [">", 1]},
        "orderby": {"l_returnflag": "ASC", "l_linestatus": "ASC"},
    },
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, max(l_extendedprice) AS peak
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') GROUP BY ALL HAVING count(*) > 1""",
)

# Scan, projection, distinct.
register("scan", "orders", {}, "SELECT * FROM orders")
register("fields_ids", "orders", {"fields": "ids", "o_orderstatus": "F"}, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
register("fields_list", "orders", {"fields": ["o_orderkey", "o_totalprice", "nothing"]}, "SELECT o_orderkey, o_totalprice FROM orders")
register("distinct_ids", "orders", {"distinct": True, "fields": "ids"}, "SELECT DISTINCT o_orderkey FROM orders")
register("index_hints", "orders", {"o_orderstatus": "O", "index_hints": {"type": "force", "indexes": ["idx_status"]}}, "SELECT * FROM orders WHERE o_orderstatus = 'O'")

# Filters by column.
register("by_value", "orders", {"o_orderstatus": "F"}, "SELECT * FROM orders WHERE o_orderstatus = 'F'")
register("by_several", "orders", {"o_orderstatus": "F,P"}, "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P')")
register("by_container", "orders", {"by": {"o_orderstatus": ["F", "P"], "nothing": 1, "o_custkey": ""}}, "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P')")
register("by_in_not_in", "orders", {"o_orderstatus__in": ["F", "P"], "o_orderpriority__not_in": ["5-LOW"]}, "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> '5-LOW'")
register("in_query", "orders", {"in_query": {"o_custkey": [1, 2, 3]}}, "SELECT * FROM orders WHERE o_custkey IN (1, 2, 3)")
register("not_in_several", "part", {"p_size__not_in": [1, 2, 3, 4]}, "SELECT * FROM part WHERE p_size NOT IN (1, 2, 3, 4)")
register("search", "part", {"search": "a*e", "search_columns": ["p_name"]}, "SELECT * FROM part WHERE p_name LIKE '%a%e%'")
register("search_any_column", "part", {"search": "Brand#1"}, "SELECT * FROM part WHERE p_name LIKE '%Brand#1%' OR p_brand LIKE '%Brand#1%'")
register("search_folded", "part", {"search": "BRAND#1"}, "SELECT * FROM part WHERE p_name ILIKE '%BRAND#1%' OR p_brand ILIKE '%BRAND#1%'", Options(collation="ci"))
register("column_compare", "orders", {"o_totalprice_compare": {"compare": ">", "value": 200000}}, "SELECT * FROM orders WHERE o_totalprice > 200000")
register(
    "compare_tree",
    "lineitem",
    {
        "compare_query": {
            "relation": "OR",
            "clauses": [
                {"relation": "AND", "clauses": [{"key": "l_quantity", "compare": ">=", "value": 45}, {"key": "l_discount", "compare": "BETWEEN", "value": [0.05, 0.07]}]},
                {"relation": "XOR", "clauses": [{"key": "l_returnflag", "value": "R"}, {"key": "l_linenumber", "compare": "<", "value": 3}, {"key": "l_tax", "compare": "<=", "value": 0.01}]},
            ],
        }
    },
    "SELECT * FROM lineitem WHERE (l_quantity >= 45 AND l_discount BETWEEN 0.05 AND 0.07) OR (((l_returnflag = 'R') <> (l_linenumber < 3)) <> (l_tax <= 0.01))",
)
register("compare_unknown_column", "orders", where("nothing", "=", 1), "SELECT * FROM orders WHERE false")
register("compare_empty_in", "region", where("r_regionkey", "IN", []), "SELECT * FROM region")

# Comparison operators.
_OPS = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
for _name, _op in _OPS.items():
    register(f"op_{_name}", "part", where("p_size", _op, 25), f"SELECT * FROM part WHERE p_size {_op.replace('!=', '<>')} 25")
register("op_in", "part", where("p_size", "IN", [1, 5, 9]), "SELECT * FROM part WHERE p_size IN (1, 5, 9)")
register("op_not_in", "part", where("p_size", "NOT IN", "1, 5 9"), "SELECT * FROM part WHERE p_size NOT IN (1, 5, 9)")
register("op_between", "part", where("p_size", "BETWEEN", [10, 20]), "SELECT * FROM part WHERE p_size BETWEEN 10 AND 20")
register("op_not_between", "part", where("p_size", "NOT BETWEEN", [10, 20, 99]), "SELECT * FROM part WHERE p_size NOT BETWEEN 10 AND 20")
register("op_like", "part", where("p_brand", "LIKE", "#1"), "SELECT * FROM part WHERE contains(p_brand, '#1')")
register("op_not_like", "part", where("p_brand", "NOT LIKE", "#1"), "SELECT * FROM part WHERE NOT contains(p_brand, '#1')")
register("op_regexp", "part", where("p_brand", "REGEXP", "^Brand#[12]"), "SELECT * FROM part WHERE regexp_matches(p_brand, '^Brand#[12]')")
register("op_not_regexp", "part", where("p_brand", "NOT REGEXP", "^Brand#[12]"), "SELECT * FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[12]')")
register("op_rlike", "part", where("p_brand", "RLIKE", "3$"), "SELECT * FROM part WHERE regexp_matches(p_brand, '3$')")
register("op_exists", "part", where("p_size", "EXISTS", 7), "SELECT * FROM part WHERE p_size = 7")
register("op_not_exists", "part", where("p_size", "NOT EXISTS", 7), "SELECT * FROM part")

# Operands and arithmetic.
register("column_to_column", "lineitem", where("l_discount", ">", col("l_tax")), "SELECT * FROM lineitem WHERE l_discount > l_tax")
register("math_product", "lineitem", where(math("*", col("l_extendedprice"), col("l_discount")), ">", 3000), "SELECT * FROM lineitem WHERE l_extendedprice * l_discount > 3000")
register("math_sum", "lineitem", where(math("+", col("l_quantity"), col("l_linenumber"), number(1)), "<=", 10), "SELECT * FROM lineitem WHERE l_quantity + l_linenumber + 1 <= 10")
register("math_difference", "lineitem", where(math("-", col("l_quantity"), number(40)), ">", 5), "SELECT * FROM lineitem WHERE l_quantity - 40 > 5")
register("math_quotient", "lineitem", where(math("/", col("l_extendedprice"), math("-", col("l_linenumber"), number(1))), ">", 20000), "SELECT * FROM lineitem WHERE l_extendedprice / nullif(l_linenumber - 1, 0) > 20000")
register(
    "list_operand",
    "nation",
    where("n_nationkey", "IN", {"operand": "list", "values": [col("n_regionkey"), number(7)]}),
    "SELECT * FROM nation WHERE n_nationkey IN (n_regionkey, 7)",
)
register("range_operand", "part", where("p_size", "BETWEEN", {"operand": "range", "bounds": [number(5), func("ABS", number(-12))]}), "SELECT * FROM part WHERE p_size BETWEEN 5 AND 12")
register(
    "tuple_in",
    "nation",
    where({"operand": "tuple", "values": [col("n_regionkey"), col("n_nationkey")]}, "IN", {"operand": "list", "values": [{"operand": "tuple", "values": [number(0), number(0)]}, {"operand": "tuple", "values": [number(1), number(1)]}]}),
    "SELECT * FROM nation WHERE (n_regionkey = 0 AND n_nationkey = 0) OR (n_regionkey = 1 AND n_nationkey = 1)",
)
register(
    "tuple_order",
    "nation",
    where({"operand": "tuple", "values": [col("n_regionkey"), col("n_nationkey")]}, "<=", {"operand": "tuple", "values": [number(2), number(7)]}),
    "SELECT * FROM nation WHERE n_regionkey < 2 OR (n_regionkey = 2 AND n_nationkey <= 7)",
)
register("cast_column", "lineitem", where("l_shipdate", "=", "1996-03-13", cast="DATE"), "SELECT * FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '1996-03-13'")
register("cast_signed", "orders", where("o_orderpriority", "<=", 2, cast="SIGNED"), "SELECT * FROM orders WHERE CAST(regexp_extract(o_orderpriority, '^\\s*(-?\\d+)', 1) AS BIGINT) <= 2")
register("cast_char", "orders", where("o_orderpriority", "=", "1-", cast="CHAR(2)"), "SELECT * FROM orders WHERE substr(o_orderpriority, 1, 2) = '1-'")
register("cast_decimal", "part", where("p_retailprice", ">", 950, cast="DECIMAL(10,2)"), "SELECT * FROM part WHERE CAST(p_retailprice AS DECIMAL(10,2)) > 950")
register("operand_refused", "part", where(func("SLEEP", number(1)), "=", 1), "SELECT * FROM part WHERE false")

# Functions, one query each.
_FUNCS: dict[str, tuple[str, Any, str, Any, str]] = {
    "lower": ("part", func("LOWER", col("p_brand")), "=", "brand#11", "lower(p_brand) = 'brand#11'"),
    "upper": ("part", func("upper", col("p_brand")), "=", "BRAND#11", "upper(p_brand) = 'BRAND#11'"),
    "length": ("part", func("LENGTH", col("p_name")), ">", 10, "strlen(p_name) > 10"),
    "abs": ("customer", func("ABS", col("c_acctbal")), "<", 500, "abs(c_acctbal) < 500"),
    "date": ("events", func("DATE", col("ts")), "=", "2024-01-02", "CAST(ts AS DATE) = DATE '2024-01-02'"),
    "year": ("orders", func("YEAR", col("o_orderdate")), "=", 1996, "year(o_orderdate) = 1996"),
    "month": ("orders", func("MONTH", col("o_orderdate")), "IN", [1, 2], "month(o_orderdate) IN (1, 2)"),
    "dayofmonth": ("orders", func("DAYOFMONTH", col("o_orderdate")), "=", 31, "dayofmonth(o_orderdate) = 31"),
    "dayofyear": ("orders", func("DAYOFYEAR", col("o_orderdate")), ">=", 360, "dayofyear(o_orderdate) >= 360"),
    "dayofweek": ("orders", func("DAYOFWEEK", col("o_orderdate")), "=", 1, "dayofweek(o_orderdate) + 1 = 1"),
    "hour": ("events", func("HOUR", col("ts")), "=", 13, "hour(ts) = 13"),
    "minute": ("events", func("MINUTE", col("ts")), "<", 5, "minute(ts) < 5"),
    "second": ("events", func("SECOND", col("ts")), "=", 30, "second(ts) = 30"),
    "coalesce": ("orders", func("COALESCE", col("o_custkey"), number(0)), "<", 10, "coalesce(o_custkey, 0) < 10"),
    "weekday": ("orders", func("WEEKDAY", col("o_orderdate")), "=", 0, "isodow(o_orderdate) - 1 = 0"),
    "week": ("orders", func("WEEK", col("o_orderdate"), 0), "=", 1, "CAST(strftime(o_orderdate, '%U') AS INT) = 1"),
    "date_format": ("orders", func("DATE_FORMAT", col("o_orderdate"), "%Y/%m"), "=", "1996/03", "strftime(o_orderdate, '%Y/%m') = '1996/03'"),
    "now": ("orders", col("o_orderdate"), ">", func("NOW"), f"o_orderdate > TIMESTAMP '{NOW}'"),
    "date_sub": ("orders", col("o_orderdate"), ">", func("DATE_SUB", func("NOW"), interval(30, "DAY")), f"o_orderdate > TIMESTAMP '{NOW}' - INTERVAL 30 DAY"),
    "date_add": ("orders", func("DATE_ADD", col("o_orderdate"), interval(1, "MONTH")), "<", "1996-01-01", "o_orderdate + INTERVAL 1 MONTH < TIMESTAMP '1996-01-01'"),
    "greatest": ("lineitem", func("GREATEST", col("l_discount"), col("l_tax")), "<=", 0.02, "greatest(l_discount, l_tax) <= 0.02"),
    "least": ("lineitem", func("LEAST", col("l_discount"), col("l_tax")), ">=", 0.07, "least(l_discount, l_tax) >= 0.07"),
    "concat": ("part", func("CONCAT", col("p_brand"), "-", col("p_type")), "LIKE", "#1", "contains(p_brand || '-' || p_type, '#1')"),
    "concat_ws": ("part", func("CONCAT_WS", "/", col("p_brand"), col("p_type")), "REGEXP", "^Brand#2./", "regexp_matches(concat_ws('/', p_brand, p_type), '^Brand#2./')"),
}
for _name, (_table, _key, _op, _value, _sql) in _FUNCS.items():
    register(f"func_{_name}", _table, where(_key, _op, _value), f"SELECT * FROM {_table} WHERE {_sql}")

# Dates.
_DATES: dict[str, tuple[str, Any, str]] = {
    "after_before": ("orders", {"after": "1996", "before": "1997-06", "inclusive": True}, "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30 23:59:59'"),
    "after_exclusive": ("orders", {"after": "1996-02"}, "o_orderdate > TIMESTAMP '1996-02-29 23:59:59'"),
    "relative": ("orders", {"after": "-30 days", "before": "tomorrow"}, "o_orderdate > TIMESTAMP '1998-05-16 12:30:00' AND o_orderdate < TIMESTAMP '1998-06-16'"),
    "dict": ("orders", {"before": {"year": 1995, "month": 3}}, "o_orderdate < TIMESTAMP '1995-03-01'"),
    "year": ("orders", {"year": [1996, 1998]}, "year(o_orderdate) IN (1996, 1998)"),
    "month": ("orders", {"month": 2}, "month(o_orderdate) = 2"),
    "monthnum": ("orders", {"monthnum": 12, "day": 25}, "month(o_orderdate) = 12 AND dayofmonth(o_orderdate) = 25"),
    "week_monday": (
        "orders",
        {"week": 53, "start_of_week": 1},
        "CAST(floor((dayofyear(o_orderdate) - 1 + isodow(date_trunc('year', o_orderdate)) - 1) / 7) AS INT) + CASE WHEN isodow(date_trunc('year', o_orderdate)) <= 4 THEN 1 ELSE 0 END = 53",
    ),
    "week_sunday": ("orders", {"w": 0, "start_of_week": 0}, "CAST(strftime(o_orderdate, '%U') AS INT) = 0"),
    "week_other_start": ("orders", {"week": 10, "start_of_week": 3}, "CAST(strftime(o_orderdate - INTERVAL 3 DAY, '%U') AS INT) = 10"),
    "dayofyear": ("orders", {"dayofyear": [1, 2], "compare": "BETWEEN"}, "dayofyear(o_orderdate) BETWEEN 1 AND 2"),
    "dayofweek": ("orders", {"dayofweek": 7}, "dayofweek(o_orderdate) + 1 = 7"),
    "dayofweek_iso": ("orders", {"dayofweek_iso": 7}, "isodow(o_orderdate) = 7"),
    "hour": ("events", {"hour": [8, 17], "compare": "BETWEEN"}, "hour(ts) BETWEEN 8 AND 17"),
    "minute": ("events", {"minute": 30}, "minute(ts) = 30"),
    "second": ("events", {"second": 59, "compare": ">="}, "second(ts) >= 59"),
    "time_of_day": ("events", {"hour": 9, "minute": 30, "compare": "<="}, "strftime(ts, '%H.%M') <= '09.30'"),
    "time_with_seconds": ("events", {"hour": 9, "minute": 30, "second": 15, "compare": ">"}, "strftime(ts, '%H.%M%S') > '09.3015'"),
    "whole_column": ("orders", {"value": "1996-03", "compare": "<"}, "o_orderdate < TIMESTAMP '1996-03-01'"),
    "unknown_column": ("orders", {"column": "nothing", "year": 1996}, "false"),
    "group": ("orders", {"relation": "OR", "clauses": [{"year": 1995, "month": 1}, {"year": 1997, "month": 12}]}, "(year(o_orderdate) = 1995 AND month(o_orderdate) = 1) OR (year(o_orderdate) = 1997 AND month(o_orderdate) = 12)"),
}
for _name, (_table, _node, _sql) in _DATES.items():
    register(f"date_{_name}", _table, {"date_query": _node}, f"SELECT * FROM {_table} WHERE {_sql}")
register("date_column_query", "lineitem", {"l_shipdate_query": {"year": 1997, "quarter": 1}}, "SELECT * FROM lineitem WHERE year(l_shipdate) = 1997")

# Relations.
_RELATIONS: dict[str, tuple[str, Spec, str]] = {
    "belongs_to_in": ("orders", {"relation": {"name": "customer", "where": {"c_mktsegment": "BUILDING"}}}, "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "belongs_to_join": (
        "orders",
        {"relation": {"name": "customer", "strategy": "join", "where": {"c_acctbal": {"compare": ">", "value": 5000}}}},
        "EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)",
    ),
    "left_join": ("orders", {"relation": {"name": "customer", "strategy": "join", "join": "left"}}, "true"),
    "has_many": ("customer", {"relation": {"name": "orders", "strategy": "join", "where": {"o_orderstatus": "P"}}}, "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "anti": ("customer", {"relation": {"name": "orders", "strategy": "join", "exists": False, "where": {"o_orderpriority": "1-URGENT"}}}, "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "composite": (
        "lineitem",
        {"relation": {"name": "same_offer", "where": {"l_returnflag": "R", "l_linenumber": 1}}},
        "EXISTS (SELECT 1 FROM lineitem o WHERE o.l_partkey = t.l_partkey AND o.l_suppkey = t.l_suppkey AND o.l_returnflag = 'R' AND o.l_linenumber = 1)",
    ),
    "conditioned": ("orders", {"relation": {"name": "returned"}}, "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"),
    "many_to_many": ("part", {"relation": {"name": "suppliers", "where": {"s_nationkey": [1, 2, 3]}}}, "EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_nationkey IN (1, 2, 3))"),
    "many_to_many_anti": ("part", {"relation": {"name": "suppliers", "exists": False, "where": {"s_nationkey": 1}}}, "NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_nationkey = 1)"),
    "nested": (
        "orders",
        {"relation": {"name": "customer", "where": {"c_mktsegment": "MACHINERY"}, "relation": {"name": "nation", "relation": {"name": "region", "where": {"r_name": "EUROPE"}}}}},
        "o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'MACHINERY' AND r_name = 'EUROPE')",
    ),
    "nested_anti": (
        "orders",
        {"relation": {"name": "customer", "relation": {"name": "nation", "exists": False, "where": {"n_regionkey": 1}}}},
        "EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1))",
    ),
    "or_group": (
        "customer",
        {"relation_query": {"relation": "OR", "clauses": [{"name": "orders", "where": {"o_orderstatus": "P"}}, {"name": "orders", "exists": False}]}},
        "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    ),
    "xor_group": (
        "customer",
        {"relation_query": {"relation": "XOR", "clauses": [{"name": "orders", "where": {"o_orderstatus": "P"}}, {"name": "orders", "where": {"o_orderpriority": "1-URGENT"}}]}},
        "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') <> EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    ),
    "or_of_joins_refused": ("orders", {"relation_query": {"relation": "OR", "clauses": [{"name": "customer"}, {"name": "items"}]}}, "false"),
    "condition_group": (
        "customer",
        {"relation": {"name": "orders", "strategy": "join", "where": {"relation": "OR", "clauses": [{"o_orderstatus": "P"}, {"o_totalprice": {"compare": ">", "value": 250000}}]}}},
        "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderstatus = 'P' OR o_totalprice > 250000))",
    ),
    "unknown": ("orders", {"relation": {"name": "nothing"}}, "false"),
    "has_many_needs_join": ("customer", {"relation": {"name": "orders"}}, "false"),
}
for _name, (_table, _spec, _sql) in _RELATIONS.items():
    register(f"rel_{_name}", _table, _spec, f"SELECT * FROM {_table} t WHERE {_sql}")

# Metadata: events as key/value rows of customers.
_M = "SELECT 1 FROM events WHERE user_id = c_custkey"
_METAS: dict[str, tuple[Spec, str]] = {
    "simple": ({"meta_key": "purchase", "meta_value": "100", "meta_compare": ">", "meta_type": "NUMERIC"}, f"EXISTS ({_M} AND event_type = 'purchase' AND trunc(value) > 100)"),
    "equal": ({"meta_query": [{"key": "click", "compare": "EXISTS"}]}, f"EXISTS ({_M} AND event_type = 'click')"),
    "not_exists": ({"meta_query": [{"key": "error", "compare": "NOT EXISTS"}]}, f"NOT EXISTS ({_M} AND event_type = 'error')"),
    "or_named": (
        {"meta_query": {"relation": "OR", "clauses": {"big": {"key": "purchase", "compare": ">", "value": 150, "type": "DECIMAL(12,4)"}, "none": {"key": "signup", "compare": "NOT EXISTS"}}}},
        f"EXISTS ({_M} AND event_type = 'purchase' AND CAST(value AS DECIMAL(12,4)) > 150) OR NOT EXISTS ({_M} AND event_type = 'signup')",
    ),
    "and_two": (
        {"meta_query": [{"key": "view", "compare": "BETWEEN", "value": [10, 20], "type": "DECIMAL(12,4)"}, {"key": "click"}]},
        f"EXISTS ({_M} AND event_type = 'view' AND CAST(value AS DECIMAL(12,4)) BETWEEN 10 AND 20) AND EXISTS ({_M} AND event_type = 'click')",
    ),
    "key_list": ({"meta_query": [{"key": ["signup", "error"], "compare_key": "IN"}]}, f"EXISTS ({_M} AND event_type IN ('signup', 'error'))"),
    "key_like": ({"meta_query": [{"key": "ur", "compare_key": "LIKE"}]}, f"EXISTS ({_M} AND contains(event_type, 'ur'))"),
    "key_negative": ({"meta_query": [{"key": "error", "compare_key": "!="}]}, f"NOT EXISTS ({_M} AND event_type = 'error')"),
    "key_negative_value": ({"meta_query": [{"key": "error", "compare_key": "!=", "value": "1"}]}, "false"),
}
for _name, (_spec, _sql) in _METAS.items():
    register(f"meta_{_name}", "customer", _spec, f"SELECT * FROM customer WHERE {_sql}")
register(
    "meta_orderby_num",
    "customer",
    {"meta_query": [{"key": "purchase"}], "orderby": {"meta_value_num": "ASC", "c_custkey": "ASC"}, "number": 20},
    """SELECT customer.* FROM customer JOIN (SELECT user_id, trunc(arg_min(value, event_id)) AS v FROM events WHERE event_type = 'purchase' GROUP BY user_id) ON user_id = c_custkey
    ORDER BY v NULLS FIRST, c_custkey LIMIT 20""",
)

# Aggregates and counts.
register(
    "agg_global",
    "lineitem",
    {"aggregate": {"n": ["count", "*"], "total": ["sum", "l_quantity"], "mean": ["avg", "l_quantity"], "most": ["max", "l_extendedprice"], "first": ["min", "l_shipdate"]}},
    "SELECT count(*) AS n, sum(l_quantity) AS total, avg(l_quantity) AS mean, max(l_extendedprice) AS most, min(l_shipdate) AS first FROM lineitem",
)
register("agg_empty", "orders", {"o_orderstatus": "nothing", "aggregate": {"n": ["count", "o_custkey"], "total": ["sum", "o_custkey"]}}, "SELECT count(o_custkey) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders WHERE false")
register(
    "agg_grouped_having_order",
    "orders",
    {"aggregate": {"n": ["count", "*"], "keys": ["sum", "o_custkey"]}, "groupby": ["o_orderstatus", "o_orderpriority"], "having": {"n": {"compare": ">=", "value": 10}, "nothing": [">", 1]}, "orderby": {"n": "DESC"}},
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY ALL HAVING count(*) >= 10",
)
register("agg_count_distinct", "orders", {"aggregate": {"customers": {"function": "count", "column": "o_custkey", "distinct": True}}}, "SELECT count(DISTINCT o_custkey) AS customers FROM orders")
register(
    "agg_fanout_safe",
    "orders",
    {"relation_query": {"name": "items", "where": {"l_returnflag": "R"}}, "aggregate": {"n": ["count", "*"], "keys": ["sum", "o_orderkey"]}},
    "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
register("agg_dropped_entries", "orders", {"aggregate": {"n": ["count", "*"], "bad": ["sum", "o_orderstatus"], "worse": ["median", "o_custkey"]}, "groupby": "nothing"}, "SELECT count(*) AS n FROM orders")
register("count", "orders", {"count": True, "o_orderstatus": "F"}, "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
register("count_distinct", "orders", {"count": True, "distinct": True}, "SELECT count(DISTINCT o_orderkey) AS count FROM orders")
register("count_groupby", "orders", {"count": True, "groupby": "o_orderpriority"}, "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
register("groupby_rows", "orders", {"groupby": "o_orderpriority"}, "SELECT * FROM orders WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_orderpriority)")

# Order and paging; every limited query has a total order.
register("order_page", "orders", {"orderby": {"o_totalprice": "DESC", "o_orderkey": "ASC"}, "number": 25, "offset": 50}, "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
register("order_default", "orders", {"orderby": "", "number": 10}, "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 10")
register("order_expression", "part", {"orderby": [func("LENGTH", col("p_name")), "p_partkey"], "order": "ASC", "number": 15}, "SELECT * FROM part ORDER BY length(p_name), p_partkey LIMIT 15")
register("order_list_position", "nation", {"n_nationkey__in": [7, 3, 5], "orderby": "n_nationkey__in", "order": "ASC", "number": 2}, "SELECT * FROM nation WHERE n_nationkey IN (7, 3)")
register("order_date", "orders", {"orderby": {"o_orderdate_query": "ASC", "o_orderkey": "ASC"}, "number": 12}, "SELECT * FROM orders ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 12")

# Criteria.
register(
    "criteria_or",
    "orders",
    {"o_orderstatus": "P", **where("o_totalprice", ">", 250000), "criteria": {"relation": "OR", "items": ["columns", "compare"]}},
    "SELECT * FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 250000",
)
register(
    "criteria_not_or",
    "orders",
    {"o_orderstatus": "P", **where("o_totalprice", ">", 150000), "o_orderpriority__in": ["1-URGENT", "2-HIGH"], "criteria": {"relation": "OR", "not": True, "items": ["by", "compare"]}},
    "SELECT * FROM orders WHERE NOT (o_orderstatus = 'P' OR o_totalprice > 150000) AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
register(
    "criteria_exists_or",
    "customer",
    {"c_mktsegment": "BUILDING", "relation_query": {"name": "orders", "where": {"o_orderstatus": "P"}}, "criteria": {"relation": "OR", "items": ["columns", "relation"]}},
    "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
)
register("criteria_refused", "orders", {"o_orderstatus": "P", "relation_query": {"name": "customer"}, "criteria": {"relation": "OR", "items": ["columns", "relation"]}}, "SELECT * FROM orders WHERE false")


def query(name: str, sql: str | None = None):
    """Register a query that is more than a specification."""

    def add(run: Runner) -> Runner:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = " ".join(sql.split())
        return run

    return add


@query("related_belongs_to", "SELECT o_custkey AS _base_o_custkey, o_orderkey AS _base_o_orderkey, customer.* FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def related_belongs_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(sample_catalog(spark, sf_dir), "orders").related("customer", {"o_orderstatus": "P"})


@query("related_many_to_many", "SELECT DISTINCT p_partkey AS _base_p_partkey, supplier.* FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 7")
def related_many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(sample_catalog(spark, sf_dir), "part").related("suppliers", {"p_size": 7})


@query(
    "prefetch_has_many",
    """SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(k, 0) AS keys FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_nationkey = 3""",
)
def prefetch_has_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Query(sample_catalog(spark, sf_dir), "customer").query({"c_nationkey": 3, "with": ["orders"], "number": 0, "orderby": "none"})
    total = F.aggregate(F.transform("orders", lambda o: o["o_orderkey"]), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return rows.select("c_custkey", F.size("orders").cast("bigint").alias("n_orders"), total.alias("keys"))


@query("select_primary_keys", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def select_primary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(sample_catalog(spark, sf_dir), "orders").select_primary_keys({"o_orderstatus": "P"})


@query("get_item", "SELECT * FROM orders WHERE o_orderkey = 7")
def get_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(sample_catalog(spark, sf_dir), "orders").get_item(7)


@query("view_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def view_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querywright.model.schema import TableSpec

    catalog = sample_catalog(spark, sf_dir)
    spec = TableSpec("finished_orders", tuple(c for c in catalog.tables["orders"].columns if c.name in ("o_orderkey", "o_totalprice")), read_only=True)
    catalog.add_view(spec, lambda: Query(catalog, "orders").query({"o_orderstatus": "F", "fields": ["o_orderkey", "o_totalprice"], "number": 0, "orderby": "none"}), ("orders",))
    return Query(catalog, "finished_orders").query({"o_totalprice_compare": {"compare": ">", "value": 200000}, "number": 0, "orderby": "none"})


@query("update_items", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'RENAMED' ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = sample_catalog(spark, sf_dir)
    return Writer(catalog, "nation", options=OPTIONS).updated({"n_regionkey": 1}, {"n_name": "RENAMED"})


@query("delete_items", "SELECT * FROM nation WHERE n_regionkey NOT IN (1, 2)")
def delete_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Writer(sample_catalog(spark, sf_dir), "nation", options=OPTIONS).remaining({"n_regionkey__in": [1, 2]})


@query("add_items", "SELECT * FROM region UNION ALL SELECT 90, 'ATLANTIS' UNION ALL SELECT 91, 'LEMURIA'")
def add_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Writer(sample_catalog(spark, sf_dir), "region", options=OPTIONS).added([{"r_regionkey": 90, "r_name": "ATLANTIS"}, {"r_regionkey": 91, "r_name": "LEMURIA"}])


@query("copy_items", "SELECT * FROM region UNION ALL SELECT 70 + r_regionkey, r_name FROM region WHERE r_regionkey = 2")
def copy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Writer(sample_catalog(spark, sf_dir), "region", options=OPTIONS).copied({"r_regionkey": 2}, {"r_regionkey": 72})


#: Values are numbers but for those that the queries write.
_META_ROWS = "SELECT event_id AS meta_id, user_id AS customer_id, event_type AS meta_key, value AS number, CAST(NULL AS VARCHAR) AS text FROM events"


def _shown(rows: DataFrame) -> DataFrame:
    """Metadata rows with their values, numbers and texts apart."""
    n = F.col("meta_value").try_cast("double")
    return rows.select("meta_id", "customer_id", "meta_key", n.alias("number"), F.when(n.isNull(), F.col("meta_value")).alias("text"))


@query("meta_add", f"{_META_ROWS} UNION ALL SELECT max(event_id) + 1, 3, 'note', NULL, '{{\"a\": 1}}' FROM events")
def meta_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_metadata(spark, sf_dir).add(3, "note", {"a": 1}))


@query("meta_add_unique", _META_ROWS)
def meta_add_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_metadata(spark, sf_dir).add(3, "click", "x", unique=True))


@query("meta_update", "SELECT event_id AS meta_id, user_id AS customer_id, event_type AS meta_key, CASE WHEN NOT (user_id = 3 AND event_type = 'click') THEN value END AS number, CASE WHEN user_id = 3 AND event_type = 'click' THEN 'changed' END AS text FROM events")
def meta_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_metadata(spark, sf_dir).update(3, "click", "changed"))


@query("meta_delete", f"{_META_ROWS} WHERE NOT (user_id = 3 AND event_type = 'click')")
def meta_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_metadata(spark, sf_dir).delete(3, "click"))


@query("meta_delete_everywhere", f"{_META_ROWS} WHERE event_type <> 'click'")
def meta_delete_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_metadata(spark, sf_dir).delete(None, "click", everywhere=True))


@query("meta_purge", f"{_META_ROWS} WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def meta_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(Writer(sample_catalog(spark, sf_dir), "customer", options=OPTIONS).purged_metadata({"c_nationkey": 3}))


def _metadata(spark: SparkSession, sf_dir: str) -> MetaWriter:
    catalog = sample_catalog(spark, sf_dir)
    return MetaWriter(catalog, catalog.tables["customer"].meta)


@query("prefetch_bounded", "SELECT c_custkey, least(count(o_orderkey), 2) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY 1")
def prefetch_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querywright.plans.relations import prefetch

    q = Query(sample_catalog(spark, sf_dir), "customer", OPTIONS)
    rows = prefetch(q.context, q.matched({"c_nationkey": 3}), "orders", most=2)
    return rows.select("c_custkey", F.size("orders").cast("bigint").alias("n"))


@query("transitions", "SELECT o_orderkey, 'o_orderstatus' AS column, 'P' AS before, 'F' AS after FROM orders WHERE o_orderstatus = 'P'")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    catalog = sample_catalog(spark, sf_dir)
    status = replace(catalog.tables["orders"].column("o_orderstatus"), transition=True)
    catalog.tables["orders"] = catalog.tables["orders"].with_columns(status)
    w = Writer(catalog, "orders", options=OPTIONS)
    return w.transitions(w.updated({"o_orderstatus": "P"}, {"o_orderstatus": "F"}))


@query(
    "diff_patch",
    """SELECT * FROM (VALUES ('add_column', 'r_note'), ('drop_column', 'r_name'), ('modify_column', 'r_regionkey'), ('add_index', 'idx_note')) AS t(operation, subject)""",
)
def diff_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = next(t for t in TABLES if t.name == "region")
    new = old.without_columns("r_name").with_columns(ColumnSpec("r_regionkey", "bigint", primary=True), ColumnSpec("r_note", "text"))
    from dataclasses import replace

    new = replace(new, indexes=(IndexSpec("idx_note", ("r_note",)),), by_name={})
    return spark.createDataFrame([(o.kind, o.subject) for o in compare(old, new).operations], "operation string, subject string")
