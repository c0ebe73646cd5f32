from pyspark.sql import functions as F

from accesslake.functions.values import redact
from accesslake.operators import changes, masking, risks
from accesslake.sources import ingest as i


def test_equal_snapshots_have_no_difference(tables):
    df = tables.customer
    assert changes.field_diff(df, df.repartition(3), "c_custkey", ["c_name", "c_acctbal"]).isEmpty()


def test_field_diff_sees_nulls_and_missing_rows(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "id int, s string, n int")
    after = spark.createDataFrame([(1, "a", 5), (3, None, 2)], "id int, s string, n int")
    got = {tuple(r) for r in changes.field_diff(before, after, "id", ["s", "n"]).collect()}
    assert got == {(1, "n", None, "5"), (2, "s", "b", None), (2, "n", "1", None), (3, "n", None, "2")}


def test_nested_diff_leaves_out_what_only_the_base_has(spark):
    objects = spark.sql("SELECT 1 AS id, named_struct('a', 1, 'b', named_struct('c', 2, 'd', 3)) AS o")
    bases = spark.sql("SELECT 1 AS id, named_struct('a', 1, 'z', 9, 'b', named_struct('c', 5)) AS o")
    assert {(r.path, r.value) for r in changes.nested_diff(objects, bases, "id", "o").collect()} == {("b.c", "2"), ("b.d", "3")}


def test_decision_table_keeps_its_own_spellings(spark):
    found = spark.createDataFrame(
        [("new_found", False), ("new_found", True), ("sudoers_changed", True), ("sudo_changed", True), ("account_deleted", True)],
        ["risk", "exists"],
    )
    got = {(r.risk, r["exists"], r.action) for r in risks.allowed_actions(found).collect()}
    assert ("new_found", False, "change_password_add") in got and ("new_found", True, "change_password_add") not in got
    assert not any(r == "sudoers_changed" for r, _, _ in got)
    assert ("sudo_changed", True, "review") in got
    assert {a for r, _, a in got if r == "account_deleted"} == {"delete_account", "review"}


def test_repeated_secrets_with_a_hot_one(spark):
    df = spark.range(600).select(F.col("id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("s"))
    rows = risks.repeated(df, "s", "id").collect()
    assert len(rows) == 200 and {r.same for r in rows} == {200}


def test_weak(spark):
    df = spark.createDataFrame([("abc",), ("abcdefgh1234",), ("abcdefgh123!",)], ["s"])
    assert [r[0] for r in df.select(risks.weak(F.col("s"))).collect()] == [True, True, False]


def test_status_change_touches_the_chosen_only(spark):
    acc = spark.createDataFrame([(1, "0"), (2, "0")], ["id", "status"])
    got = {r.id: r.status for r in risks.set_status(acc, acc.where("id = 2").union(acc.where("id = 2")), ["id"], "ignored").collect()}
    assert got == {1: "0", 2: "2"}


def test_masking_scope_and_priority(spark):
    df = spark.createDataFrame([(1, "abcdefgh", 5), (2, "abcdefgh", 6), (3, None, 7)], ["id", "name", "n"])
    docs = [
        {"id": 1, "priority": 60, "fields_pattern": "na*", "masking_method": "keep_suffix"},
        {"id": 2, "priority": 10, "fields_pattern": "name", "masking_method": "fixed_char", "mask_pattern": "##", "users": {"type": "ids", "ids": [1]}},
    ]
    rows = masking.mask_columns(df, docs, "id").orderBy("id").collect()
    assert [r.name for r in rows] == ["##", "******gh", None] and [r.n for r in rows] == [5, 6, 7]


def test_create_keeps_present_keys_and_takes_each_new_key_once(spark):
    target = spark.createDataFrame([(1, "old")], ["id", "s"])
    batch = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], ["id", "s"])
    assert {tuple(r) for r in i.append_new(target, batch, "id").collect()} == {(1, "old"), (2, "a")}


def test_patch_writes_nulls_and_leaves_absent_columns(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], ["id", "s", "n"])
    batch = spark.createDataFrame([(1, None), (9, "x")], "id int, s string")
    assert {tuple(r) for r in i.patch(target, batch, "id").collect()} == {(1, None, 1), (2, "b", 2)}


def test_upload_reports_bad_rows(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,price\n1,2.5\nx,3\n4,5,6\n5,\n")
    rows = i.read_upload(spark, str(tmp_path / "u.csv"), ["id", "price"])
    checked = i.validate_import(rows, {"id": "bigint", "price": "double"}).collect()
    assert {r.id: (r.status, list(r.errors)) for r in checked} == {
        "1": ("ok", []),
        "x": ("error", ["id: not a valid bigint"]),
        "4": ("error", ["row: malformed"]),
        "5": ("ok", []),
    }


def test_export_then_import_is_the_input(spark, tables, tmp_path):
    rows = tables.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    i.export(rows, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), schema=rows.schema, header=True)
    empty = rows.where("o_orderkey < 0")
    assert i.append_new(empty, back, "o_orderkey").exceptAll(rows).isEmpty() and back.count() == rows.count()


def test_profile_drops_empty_columns(spark):
    df = spark.createDataFrame([(1, "", None, [], True), (22, None, None, [1], False)], "a int, b string, c string, d array<int>, e boolean")
    assert {r.column: r.max_length for r in i.column_profile(df).collect()} == {"a": 2, "b": 0, "c": 0, "d": 3, "e": 5}
    assert i.drop_empty_columns(df).columns == ["a", "d", "e"]


def test_listing_order(tables):
    meta = {"c_name": {"primary": True}, "c_acctbal": {"write_only": True}, "c_mktsegment": {"order": 0}}
    assert i.listing(tables.customer, meta).columns == ["c_name", "c_mktsegment", "c_custkey", "c_nationkey"]
    assert i.listing(tables.customer, order=["c_nationkey", "nope", "c_custkey"]).columns == ["c_nationkey", "c_custkey"]


def test_redact_leaves_other_columns(tables):
    assert redact(tables.region).collect() == tables.region.collect()


def test_retention_per_kind(tables):
    logs = {"login_log": (tables.events, "ts"), "ftp_log": (tables.events, "ts")}
    kept = i.retain_kinds(logs, {"login_log": 1}, "2024-01-30")
    assert kept["ftp_log"].count() == tables.events.count()
    assert kept["login_log"].count() == tables.events.where("ts >= timestamp_ntz '2024-01-30'").count()
    try:
        i.retain_kinds(logs, {"other": 1}, "2024-01-30")
        raise AssertionError
    except ValueError:
        pass
