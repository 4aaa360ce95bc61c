"""Declarations, differences, stored tables and row writes."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querywright.ddl.diff import APPLIED, DEFERRED, PENDING, UNCHANGED, Snapshot, compare, reconcile
from querywright.ddl.tables import Migrations, StoredTable
from querywright.functions.casts import cast_to
from querywright.functions.json_values import checked, decoded
from querywright.model.presets import created, current_timestamp, identifier, modified, uuid
from querywright.model.schema import ColumnSpec as C
from querywright.model.schema import IndexSpec, RelationSpec, TableSpec, clean_cast, parse_declared
from querywright.model.validation import schema_errors
from querywright.plans.context import Options
from querywright.plans.query import Query
from querywright.queries import SQL
from querywright.sources.catalog import Catalog
from querywright.sources.connection import Connection, NullConnection
from querywright.table_queries import temporary_table
from querywright.writes.items import Writer
from querywright.writes.store import Conflict, ParquetStore
from tests.conftest import NOW

WIDGET = TableSpec(
    "widget",
    (identifier(), C("name", "varchar", 8, default=""), C("status", "varchar", 20, default="active", transition=True), C("price", "decimal", 10, 2), C("data", "json", allow_null=True), created(), modified(), current_timestamp("seen", allow_null=True), uuid()),
    (IndexSpec("by_status", ("status",)),),
)


@pytest.fixture
def writer(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "widget"))
    table = StoredTable(spark, WIDGET, store)
    assert table.create() and not table.create()
    catalog = Catalog(spark).add(WIDGET, store.read)
    w = Writer(catalog, "widget", store, Options(now=NOW))
    w.commit(w.added([{"name": "first"}, {"name": "second name too long", "price": "12.345abc", "data": "nonsense", "seen": None}, {"name": "third", "status": "off", "data": '{"a": 1}', "seen": "2020-01-02 03:04:05"}]))
    return w


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_added_rows_are_completed_and_checked(writer):
    rows = by_id(writer.rows)
    assert sorted(rows) == [1, 2, 3]
    assert rows[1]["status"] == "active" and rows[1]["date_created"] == NOW == rows[1]["date_modified"]
    assert rows[2]["name"] == "second n" and str(rows[2]["price"]) == "12.34" or str(rows[2]["price"]) == "12.35"
    assert rows[2]["data"] == "{}" and rows[3]["data"] == '{"a": 1}' and rows[1]["data"] is None
    assert rows[2]["seen"] is None and rows[1]["seen"] == NOW and str(rows[3]["seen"]) == "2020-01-02 03:04:05"
    import re

    assert all(re.fullmatch(r"urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", r["uuid"]) for r in rows.values()) and len({r["uuid"] for r in rows.values()}) == 3


def test_update_delete_copy_and_events(writer):
    events = writer.commit(writer.updated({"id": 1}, {"status": "off", "id": 99}))
    assert [tuple(r) for r in events.collect()] == [("transition", 1, "status", "active", "off")]
    assert by_id(writer.rows)[1]["status"] == "off"
    later = Writer(writer.catalog, "widget", writer.store, Options())
    same = by_id(later.updated({"id": 1}, {"status": "off"}))
    assert same[1]["date_modified"] == NOW
    copy = by_id(writer.copied({"id": 3}, {"name": "copy", "id": 1, "nothing": 2}))
    assert copy[4]["name"] == "copy" and copy[4]["uuid"] != copy[3]["uuid"] and copy[4]["status"] == "off"
    assert [tuple(r) for r in writer.commit(writer.remaining({"id__in": [2]})).collect()] == [("deleted", 2, "", None, None)]
    assert sorted(by_id(writer.rows)) == [1, 3]
    for change in (writer.remaining, lambda s: writer.updated(s, {"status": "x"}), lambda s: writer.copied(s, {})):
        with pytest.raises(ValueError):
            change({})
    assert writer.added([{"id": 1, "name": "again"}]).count() == 2


def test_get_item(writer):
    q = Query(writer.catalog, "widget")
    assert q.get_item(2).count() == 1 and q.get_item(9).count() == 0
    assert q.get_item_by("status", "off").count() == 1 and q.get_item_by("nothing", 1).count() == 0


def test_read_only_view_refuses_writes(spark, writer):
    c = writer.catalog
    view = TableSpec("shown", (C("id", "bigint", primary=True),))
    with pytest.raises(KeyError):
        c.add_view(view, lambda: c.frame("widget").select("id"), ("missing",))
    c.add_view(view, lambda: c.frame("widget").select("id"), ("widget",))
    assert spark.table("shown").count() == 3
    with pytest.raises(PermissionError):
        Writer(c, "shown")
    assert c.drop_view("shown") and not c.drop_view("shown")


def test_composite_key_writes(spark, tmp_path):
    spec = TableSpec("member", (C("account", "bigint", primary=True), C("user", "bigint", primary=True), C("status", "varchar", 20)))
    store = ParquetStore(spark, str(tmp_path / "member"))
    store.replace(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], spec.struct()))
    w = Writer(Catalog(spark).add(spec, store.read), "member", store)
    w.commit(w.updated({"account": 1, "user": 2}, {"status": "z"}))
    w.commit(w.remaining({"user": 1, "account": 2}))
    assert sorted(tuple(r) for r in w.rows.collect()) == [(1, 1, "a"), (1, 2, "z")]


def test_stored_table_upkeep(spark, tmp_path, writer):
    t = StoredTable(spark, WIDGET, writer.store)
    other = t.duplicate(ParquetStore(spark, str(tmp_path / "copy")), with_rows=True)
    assert other.count() == 3 and other.checksum() == t.checksum() and other.check() == []
    assert other.optimize() == 1 and other.optimize(file_bytes=other.store.bytes() // 3) >= 3
    assert other.checksum() == t.checksum() and other.store.vacuum() == 2 and other.count() == 3
    other.rename(str(tmp_path / "moved"))
    other.copy_to(t)
    assert t.count() == 6 and t.status()["rows"] == 6 and t.analyze() == {"rows": 6}
    other.truncate()
    assert other.count() == 0 and other.indexes() == ["by_status"] and "USING parquet" in other.create_sql()
    assert other.drop() and not other.exists()


def test_diff_patch_and_reconcile(spark, tmp_path):
    old = TableSpec("t", (C("id", "bigint", 20, primary=True), C("a", "varchar", 10, allow_null=True), C("n", "varchar", 5, allow_null=True)), (IndexSpec("i", ("a",)),))
    same = TableSpec("t", (C("id", "bigint", 11, primary=True), C("a", "varchar", 10, allow_null=True), C("n", "varchar", 5, allow_null=True)), (IndexSpec("i", ("a",), "index"),))
    assert not compare(old, same)
    new = TableSpec("t", (C("id", "bigint", primary=True), C("n", "int", allow_null=True), C("b", "int", default=7)), (IndexSpec("i", ("n",)),))
    patch = compare(old, new)
    assert [(o.kind, o.subject) for o in patch.operations] == [("modify_column", "n"), ("add_column", "b"), ("drop_column", "a"), ("modify_index", "i")]
    assert [o.kind for o in patch.planned().operations] == ["modify_column", "add_column", "modify_index"]
    assert compare(patch.reverted().apply_to_spec(patch.apply_to_spec(old)), old).operations == ()
    assert patch.to_sql("t")[1] == "ALTER TABLE t ADD COLUMNS (b int)"
    store = ParquetStore(spark, str(tmp_path / "t"))
    store.replace(spark.createDataFrame([(1, "x", "12z"), (2, None, None)], old.struct()))
    table = StoredTable(spark, old, store)
    outcome = table.reconcile(new)
    assert outcome.state == APPLIED and [o.subject for o in outcome.left.operations] == ["a"]
    assert sorted((r["id"], r["n"], r["b"], r["a"]) for r in table.rows().collect()) == [(1, 12, 7, "x"), (2, None, 7, None)]
    assert table.reconcile(new).state == UNCHANGED
    assert table.reconcile(new, drop=True).state == APPLIED and "a" not in table.rows().columns
    assert reconcile(Snapshot(old, complete=False), new).state == DEFERRED
    assert reconcile(Snapshot(old), new).state == PENDING


def test_migrations_stop_at_a_failure(spark, tmp_path):
    t = StoredTable(spark, WIDGET, ParquetStore(spark, str(tmp_path / "m")))
    ran = []
    upgrades = {3: lambda x: False, 1: lambda x: ran.append(1), 2: lambda x: ran.append(2)}
    m = Migrations(upgrades)
    t.create()
    assert m.run(t) == [1, 2] and ran == [1, 2] and m.pending(t) == [3]
    # Another process sees the same version and the same lock.
    again = StoredTable(spark, WIDGET, ParquetStore(spark, str(tmp_path / "m")))
    assert Migrations(upgrades).pending(again) == [3]
    token = t.store.lock(900)
    assert token and again.store.lock(900) is None and Migrations({4: lambda x: None}).run(again) == []
    assert not again.store.unlock("not the token") and t.store.unlock(token)
    old = t.store.lock(900)
    newer = again.store.lock(0)
    assert newer and not t.store.unlock(old) and again.store.unlock(newer)
    assert m.uninstall(t) and m.install(t) and m.pending(t) == []


def test_appends_write_new_rows_only(spark, tmp_path, writer):
    store = writer.store
    before = store.parts()
    stored = writer.insert([{"name": "fourth"}, {"id": 2, "name": "there already"}])
    assert [(r["id"], r["name"]) for r in stored.collect()] == [(4, "fourth")]
    assert store.parts()[:-1] == before and sorted(by_id(writer.rows)) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in store.read(store.version() - 1).collect()) == [1, 2, 3]
    late = ParquetStore(spark, store.path)
    late.version = lambda: store.version() - 1
    with pytest.raises(Conflict):
        late.replace(writer.rows.limit(0))
    assert sorted(by_id(writer.rows)) == [1, 2, 3, 4]


@pytest.mark.parametrize("size", [9, 33])
def test_a_temporary_table_takes_a_row_whose_key_its_source_has(spark, tmp_path, size):
    rows = [(7, "a", "b", "c", 9, 1.0), (900001, "d", "e", "f", size, 2.0)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(str(tmp_path / "part.parquet"))
    got = temporary_table(spark, str(tmp_path))
    wanted = spark.sql(SQL["temporary_table"].replace("FROM part", "FROM {part}"), part=part)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) == [(7, 9), *[(900001, 9)] * (2 if size == 9 else 1)]


def test_events_name_what_was_stored(spark, tmp_path):
    spec = TableSpec("e", (C("id", "bigint", primary=True), C("tag", "varchar", 100, uuid=True, transition=True)))
    store = ParquetStore(spark, str(tmp_path / "e"))
    store.replace(spark.createDataFrame([(1, "urn:uuid:a"), (2, "urn:uuid:b")], spec.struct()))
    w = Writer(Catalog(spark).add_stored(spec, store), "e", store)
    events = w.commit(w.rows.withColumn("tag", F.concat(F.lit("urn:uuid:"), F.uuid())))
    assert {r["id"]: r["after"] for r in events.collect()} == {r["id"]: r["tag"] for r in w.rows.collect()}


def test_events_of_new_null_and_unchanged_values(spark, tmp_path):
    spec = TableSpec("s", (identifier(), C("state", "varchar", 20, allow_null=True, transition=True), C("rank", "bigint", default=0, transition=True), C("other", "bigint", default=0)))
    store = ParquetStore(spark, str(tmp_path / "s"))
    store.replace(spark.createDataFrame([], spec.struct()))
    w = Writer(Catalog(spark).add_stored(spec, store), "s", store)

    def events(after):
        return sorted(((r["kind"], r["id"], r["column"], r["before"], r["after"]) for r in w.commit(after).collect()), key=str)

    assert events(w.added([{"state": "active"}, {"state": None}])) == [("transition", 1, "rank", "new", "0"), ("transition", 1, "state", "new", "active"), ("transition", 2, "rank", "new", "0"), ("transition", 2, "state", "new", None)]
    assert events(w.updated({"id": 1}, {"state": None})) == [("transition", 1, "state", "active", None)]
    assert events(w.updated({"id": 1}, {"state": "again"})) == [("transition", 1, "state", None, "again")]
    # A value that is read back as the stored one, or a change of another column, moves nothing that is watched.
    assert events(w.updated({"id": 1}, {"rank": "no number"})) == events(w.updated({"id": 1}, {"other": 5})) == []
    assert by_id(w.rows)[1]["other"] == 5
    assert events(w.remaining({"id": 2})) == [("deleted", 2, "", None, None)]


def test_connection_binds_values_and_counts_changes(writer):
    c = Connection(writer.catalog, Options(now=NOW))
    assert c.value("SELECT name FROM {widget} WHERE name = :n", n="first' OR '1' = '1") is None
    assert c.value("SELECT id, name FROM {widget} WHERE name = :n", 1, n="first") == "first" and c.value("SELECT 1", 5) is None
    assert c.column("SELECT * FROM {widget} ORDER BY id") == [1, 2, 3] and c.column("SELECT 1", 3) == [] and c.row("SELECT 1", 2) is None
    assert c.rows("SELECT * FROM {widget} WHERE name LIKE :p", p=c.like("f%") + "%") == [] and c.like("a_b%") == "a\\_b\\%"
    assert c.insert("widget", [{"name": "a, b"}, {"id": 1}]) == 1 and c.update("widget", {"status": "z"}, {"name": "a, b"}) == 1
    assert c.update("widget", {"status": "q"}, {"seen": None}) == 1 and c.delete("widget", {"id": 99}) == 0 and c.delete("widget", {"id": 4}) == 1
    assert sorted(by_id(writer.catalog.frame("widget"))) == [1, 2, 3]
    with pytest.raises(ValueError):
        c.delete("widget", {})
    with pytest.raises(PermissionError):
        c.insert("nothing", {"id": 1})
    none = NullConnection(writer.catalog)
    assert none.rows("SELECT * FROM {widget}") == [] and none.value("x") is None and none.column("x") == []
    assert none.insert("widget", {"id": 9}) == none.update("widget", {}, {}) == none.delete("widget", {}) == 0


def test_events_of_a_first_version_and_of_rows_without_a_key(spark, tmp_path):
    spec = TableSpec("f", (C("id", "bigint", primary=True), C("state", "varchar", 20, transition=True)))
    store = ParquetStore(spark, str(tmp_path / "f"))
    w = Writer(Catalog(spark).add(spec, spark.createDataFrame([], spec.struct())), "f", store)
    assert [tuple(r) for r in w.commit(spark.createDataFrame([(1, "on")], spec.struct())).collect()] == [("transition", 1, "state", "new", "on")]
    bare = TableSpec("b", (C("x", "bigint"),))
    w = Writer(Catalog(spark).add(bare, spark.createDataFrame([], bare.struct())), "b", ParquetStore(spark, str(tmp_path / "b")))
    assert w.commit(spark.createDataFrame([(1,)], bare.struct())).count() == 0 and w.rows.count() == 1


def test_names_without_their_prefix_become_the_default(spark):
    from querywright.writes.values import validated

    df = spark.createDataFrame([("urn:uuid:1",), ("other",), (None,)], "v string")
    assert [r["x"] for r in df.select(validated(C("u", "varchar", uuid=True, default="none"), F.col("v")).alias("x")).collect()] == ["urn:uuid:1", "none", "none"]


def test_single_changes_of_a_stored_table(spark, tmp_path):
    spec = TableSpec("s", (identifier(), C("a", "varchar", 10), C("c", "bigint")), (IndexSpec("by_a", ("a",)),), (RelationSpec("owner", "owner", "belongs_to", ("c",), ("id",), enforce=True),))
    t = StoredTable(spark, spec, ParquetStore(spark, str(tmp_path / "s")))
    t.create()
    t.store.append(spark.createDataFrame([(1, "12x", 5), (2, None, 6)], "id long, a string, c long"))
    assert t.add_column(C("n", "int", default=3)) and not t.add_column(C("n", "int")) and not t.add_column(C("no name"))
    assert t.modify_column(C("a", "int", allow_null=True)) and not t.modify_column(C("zz", "int"))
    assert sorted(tuple(r) for r in t.rows().select("id", "a", "c", "n").collect()) == [(1, 12, 5, 3), (2, None, 6, 3)]
    assert t.drop_column("n") and not t.drop_column("n") and not t.drop_column("id")
    assert t.add_index(IndexSpec("by_c", ("c",))) and not t.add_index(IndexSpec("by_c", ("c",))) and not t.add_index(IndexSpec("bad", ("zz",)))
    assert t.replace_index(IndexSpec("by_c", ("c",)), IndexSpec("by_ca", ("c", "a"))) and not t.replace_index(IndexSpec("by_c", ("c",)), IndexSpec("x", ("c",)))
    assert t.drop_index("by_a") and not t.drop_index("by_a") and t.indexes() == ["by_ca"]
    owner = TableSpec("owner", (identifier(),))
    catalog = Catalog(spark)
    assert not t.add_foreign_keys(catalog) and t.enforced() == []
    catalog.add(owner, spark.createDataFrame([(5,)], "id long"))
    assert not t.add_foreign_keys(catalog)
    catalog.add(owner, spark.createDataFrame([(5,), (6,)], "id long"))
    assert t.add_foreign_keys(catalog) and t.enforced() == ["owner"]
    assert not t.auto_increment(0) and t.auto_increment(50) and t.next_number() == 50
    w = Writer(Catalog(spark).add_stored(t.spec, t.store), "s", t.store)
    assert [r["id"] for r in w.insert([{"a": 1}, {"a": 2}]).orderBy("id").collect()] == [50, 51] and t.next_number() == 52
    # Another process takes up the declaration as it was left.
    seen = StoredTable(spark, spec, ParquetStore(spark, str(tmp_path / "s")))
    assert [i.name for i in seen.snapshot().table.indexes] == ["by_ca"] and seen.snapshot().table.column("a").type == "int"


def test_drift_of_stored_columns_is_noticed(spark, tmp_path):
    spec = TableSpec("d", (identifier(), C("n", "bigint", allow_null=True), C("t", "varchar", 5, allow_null=True)))
    t = StoredTable(spark, spec, ParquetStore(spark, str(tmp_path / "d")))
    t.create()
    assert not t.diverged()
    # Somebody else's files: n is text, t is gone, x is new.
    t.store.replace(spark.createDataFrame([(1, "7", 1.5)], "id long, n string, x double"))
    assert [(o.kind, o.subject) for o in t.diff().operations] == [("modify_column", "n"), ("add_column", "t"), ("drop_column", "x")]
    assert t.reconcile(spec).state == APPLIED and t.reconcile(spec).state == UNCHANGED
    assert [tuple(r) for r in t.rows().select("id", "n", "x", "t").collect()] == [(1, 7, 1.5, None)]
    t.store.replace(t.rows().drop("t"))
    assert t.check() == ["t"] and t.repair() == ["t"] and t.check() == []


def test_foreign_keys_are_told(spark, tmp_path):
    spec = TableSpec("o", (C("id", "bigint", primary=True), C("c", "bigint")), relations=(RelationSpec("owner", "customer", "belongs_to", ("c",), ("id",), enforce=True, on_delete="cascade"),))
    assert StoredTable(spark, spec, ParquetStore(spark, str(tmp_path / "o"))).foreign_keys() == ["FOREIGN KEY (c) REFERENCES customer (id) ON DELETE CASCADE"]


def test_declarations():
    assert parse_declared("decimal(10,2) unsigned") == ("decimal", 10, 2, True)
    assert clean_cast("decimal( 10, 2 )") == "DECIMAL(10,2)" and clean_cast("varchar(3)") is None
    spec = TableSpec.from_spark("x", T.StructType([T.StructField("id", T.LongType(), False), T.StructField("at", T.TimestampNTZType())]), ("id",))
    assert spec.column("at").date_query and spec.primary == ("id",)
    assert {c for c, _ in schema_errors(TableSpec("e", ()))} == {"schema_no_columns"}
    many = TableSpec("m", (C("a", "varchar", 0), C("1x"), C("d", "decimal", 2, 5), C("k", "bigint", primary=True, allow_null=True), C("s", extra="auto_increment")), (IndexSpec("i", ()), IndexSpec("i", ("zz",)), IndexSpec("f", ("d",), method="fulltext"), IndexSpec("p", ("a",), "primary")))
    assert {c for c, _ in schema_errors(many)} == {
        "column_invalid_length",
        "column_invalid_name",
        "column_invalid_scale",
        "primary_nullable",
        "auto_increment_not_numeric",
        "index_no_columns",
        "index_duplicate",
        "index_unknown_column",
        "index_fulltext_not_text",
        "primary_conflict",
    }


@pytest.mark.parametrize(
    ("value", "target", "expected"),
    [("12abc", "SIGNED", "12"), ("9007199254740993", "SIGNED", "9007199254740993"), ("abc", "SIGNED", "0"), (None, "SIGNED", None), ("-3", "UNSIGNED", str(2**64 - 3)), ("1.239", "DECIMAL(5,2)", "1.24"), ("x", "DATE", None), ("2024-02-30", "DATE", None), ("2024-02-29 10:00:00", "TIME", "10:00:00"), ("hello", "CHAR(2)", "he")],
)
def test_casts_never_raise(spark, value, target, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(cast_to(F.col("v"), target, "string").cast("string").alias("x")).first()["x"] == expected


def test_json(spark):
    df = spark.createDataFrame([('{"k": 3}',), ("nonsense",), (None,)], "j string")
    assert [r["k"] for r in df.select(decoded(F.col("j"), "struct<k: long>")["k"].alias("k")).collect()] == [3, None, None]
    assert [r["c"] for r in df.select(checked(F.col("j")).alias("c")).collect()] == ['{"k": 3}', "{}", None]


def test_concat_ws_greatest_and_formats(spark):
    from querywright.functions.scalar import FUNCTIONS, format_date

    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    cols = [(F.lit("-"), "string")] + [(F.col(c), "string") for c in "xyz"]
    assert df.select(FUNCTIONS["CONCAT_WS"].build(cols, None).alias("r")).first()["r"] == "a-c"
    odd = spark.createDataFrame([("a\x00b", None, "c")], df.schema)
    assert odd.select(FUNCTIONS["CONCAT_WS"].build(cols, None).alias("r")).first()["r"] == "a\x00b-c"
    assert odd.select(FUNCTIONS["CONCAT_WS"].build([(F.col("y"), "string"), *cols[1:]], None).alias("r")).first()["r"] is None
    assert df.select(FUNCTIONS["GREATEST"].build(cols[1:], None).alias("r")).first()["r"] is None
    assert len(FUNCTIONS) == 24
    day = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-02 04:05:06' AS t")
    assert day.select(format_date(F.col("t"), "%d.%c.%y %k:%i %p 100%% %D %w %j").alias("r")).first()["r"] == "02.3.24 4:05 AM 100% 2nd 6 062"


def test_numbers_cast_whole(spark):
    df = spark.createDataFrame([(9007199254740993, 2.4999999999999996), (-(1 << 63), 2.5), (None, float("nan")), (1, 1e300)], "n long, x double")
    got = df.select(cast_to(F.col("n"), "SIGNED", "numeric").alias("n"), cast_to(F.col("x"), "SIGNED", "numeric").alias("x")).collect()
    assert [tuple(r) for r in got] == [(9007199254740993, 2), (-(1 << 63), 3), (None, None), (1, None)]


def test_rows_are_numbered_without_gaps(spark):
    from querywright.writes.numbering import numbered

    rows = numbered(spark.range(0, 5000, 3), ["id"], "n").collect()
    assert sorted(r["n"] for r in rows) == list(range(1, len(rows) + 1))
    assert numbered(spark.range(0), ["id"], "n").count() == 0
