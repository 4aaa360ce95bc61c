"""The declared tables of the sample data, with their relationships."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywright.model.schema import ColumnSpec as C
from querywright.model.schema import IndexSpec, MetaSpec, RelationSpec, TableSpec
from querywright.sources.catalog import Catalog


def _int(name: str, **more) -> C:
    return C(name, "bigint", sortable=True, compare=True, **more)


def _small(name: str, **more) -> C:
    return C(name, "int", sortable=True, compare=True, **more)


def _float(name: str, **more) -> C:
    return C(name, "double", sortable=True, compare=True, **more)


def _text(name: str, **more) -> C:
    return C(name, "varchar", **({"length": 255, "sortable": True} | more))


def _time(name: str) -> C:
    return C(name, "datetime", sortable=True, date_query=True, compare=True)


def _belongs(name: str, table: str, columns: str, references: str, **more) -> RelationSpec:
    return RelationSpec(name, table, "belongs_to", tuple(columns.split()), tuple(references.split()), **more)


def _many(name: str, table: str, columns: str, references: str, **more) -> RelationSpec:
    return RelationSpec(name, table, "has_many", tuple(columns.split()), tuple(references.split()), **more)


TABLES = (
    TableSpec("region", (_small("r_regionkey", primary=True), _text("r_name", searchable=True)), relations=(_many("nations", "nation", "r_regionkey", "n_regionkey"),)),
    TableSpec(
        "nation",
        (_small("n_nationkey", primary=True), _text("n_name", searchable=True), _small("n_regionkey")),
        relations=(_belongs("region", "region", "n_regionkey", "r_regionkey"), _many("customers", "customer", "n_nationkey", "c_nationkey")),
    ),
    TableSpec(
        "customer",
        (_int("c_custkey", primary=True), _text("c_name", searchable=True), _small("c_nationkey"), _float("c_acctbal"), _text("c_mktsegment", searchable=True)),
        indexes=(IndexSpec("idx_segment", ("c_mktsegment",)),),
        relations=(_belongs("nation", "nation", "c_nationkey", "n_nationkey"), _many("orders", "orders", "c_custkey", "o_custkey")),
        meta=MetaSpec("customermeta", "customer_id"),
    ),
    TableSpec(
        "customermeta",
        (_int("meta_id", primary=True), _int("customer_id"), _text("meta_key"), C("meta_value", "longtext", allow_null=True)),
        relations=(_belongs("customer", "customer", "customer_id", "c_custkey"),),
    ),
    TableSpec(
        "supplier",
        (_int("s_suppkey", primary=True), _text("s_name", searchable=True), _small("s_nationkey"), _float("s_acctbal")),
        relations=(
            _belongs("nation", "nation", "s_nationkey", "n_nationkey"),
            RelationSpec("parts", "part", "many_to_many", ("s_suppkey",), ("p_partkey",), (), "lineitem", ("l_suppkey",), ("l_partkey",)),
        ),
    ),
    TableSpec(
        "part",
        (_int("p_partkey", primary=True), _text("p_name", searchable=True), _text("p_brand", searchable=True), _text("p_type"), _small("p_size"), _float("p_retailprice")),
        relations=(RelationSpec("suppliers", "supplier", "many_to_many", ("p_partkey",), ("s_suppkey",), (), "lineitem", ("l_partkey",), ("l_suppkey",)),),
    ),
    TableSpec(
        "orders",
        (_int("o_orderkey", primary=True), _int("o_custkey"), _text("o_orderstatus"), _float("o_totalprice"), _time("o_orderdate"), _text("o_orderpriority")),
        indexes=(IndexSpec("idx_status", ("o_orderstatus",)),),
        relations=(
            _belongs("customer", "customer", "o_custkey", "c_custkey"),
            _many("items", "lineitem", "o_orderkey", "l_orderkey"),
            _many("returned", "lineitem", "o_orderkey", "l_orderkey", condition=(("l_returnflag", "R"),)),
        ),
    ),
    TableSpec(
        "lineitem",
        (
            _int("l_orderkey"),
            _int("l_partkey"),
            _int("l_suppkey"),
            _small("l_linenumber"),
            _float("l_quantity"),
            _float("l_extendedprice"),
            _float("l_discount"),
            _float("l_tax"),
            _text("l_returnflag"),
            _text("l_linestatus"),
            _time("l_shipdate"),
        ),
        relations=(
            _belongs("order", "orders", "l_orderkey", "o_orderkey"),
            _belongs("part", "part", "l_partkey", "p_partkey"),
            _belongs("supplier", "supplier", "l_suppkey", "s_suppkey"),
            _many("same_offer", "lineitem", "l_partkey l_suppkey", "l_partkey l_suppkey"),
        ),
    ),
    TableSpec("events", (_int("event_id", primary=True), _time("ts"), _int("user_id"), _text("event_type"), _float("value"), C("props", "json")), relations=(_belongs("customer", "customer", "user_id", "c_custkey"),)),
)


def event_metadata(events: DataFrame) -> DataFrame:
    """Events as key/value rows of customers."""
    return events.select(F.col("event_id").alias("meta_id"), F.col("user_id").alias("customer_id"), F.col("event_type").alias("meta_key"), F.col("value").cast("string").alias("meta_value"))


def sample_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The sample tables under ``sf_dir``, read as Parquet; customers' metadata is made of their events."""
    catalog = Catalog(spark)
    for table in TABLES:
        if table.name == "customermeta":
            catalog.add(table, lambda: event_metadata(spark.read.parquet(f"{sf_dir}/events.parquet")))
        else:
            catalog.add_parquet(table, f"{sf_dir}/{table.name}.parquet")
    return catalog


def with_relation(table: TableSpec, relation: RelationSpec) -> TableSpec:
    return replace(table, relations=(*table.relations, relation), by_name={})
