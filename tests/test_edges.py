"""Rows that fixtures do not have: null times and groups, unknown assets, deep trees, unlisted values, odd uploads."""

import pytest
from pyspark.sql import functions as F

from accesslake.functions import values
from accesslake.operators import metrics, predicates, ranking, risks, rules, tree
from accesslake.sources import adapters, ingest


def test_numbering_keeps_rows_without_time_or_group(spark):
    rows = [(1, "a", None), (2, "a", "2024-01-01 00:00:00"), (3, None, "2024-01-01 00:00:00"), (4, None, None), (5, None, "2023-01-01 00:00:00"), (6, "a", None)]
    df = spark.createDataFrame(rows, "id long, g string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for width in (None, 2):
        got = {r.id: r.version for r in ranking.number_within(df, "g", "ts", "id", tie_width=width).collect()}
        assert got == {1: 1, 6: 2, 2: 3, 4: 1, 5: 2, 3: 3}


RECONCILED = (
    "username long, asset long, present boolean, remote_present boolean, managed_date_last_login date, remote_date_last_login date, "
    "managed_date_secret_changed date, remote_date_secret_changed date, managed_groups string, remote_groups string, "
    "managed_sudoers string, remote_sudoers string, managed_authorized_keys string, remote_authorized_keys string, secret string"
)


def test_an_account_without_a_secret_keeps_its_other_risks(spark):
    rows = [(1, 10, False, True, *[None] * 11), (2, 10, True, True, *[None] * 10, "abc"), (3, 11, True, True, *[None] * 10, "abc")]
    accounts = spark.createDataFrame(rows, RECONCILED)
    leaks = spark.createDataFrame([("abc",), (None,)], "password string")
    got = {(r.username, r.risk) for r in risks.findings(accounts, F.col("secret"), leaks, "2024-01-30").collect()}
    secret_risks = {"weak_password", "leaked_password", "repeated_password"}
    assert got == {(1, "new_found"), (1, "long_time_no_login")} | {(u, r) for u in (2, 3) for r in secret_risks | {"long_time_no_login"}}


def test_never_logged_in_is_idle_everywhere(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    logins = spark.createDataFrame([(1, "2024-01-29"), (2, "2020-01-01")], "u long, at string").withColumn("at", F.col("at").cast("date"))
    got = {r.id for r in predicates.no_login_for(users, logins, 90, "2024-01-30", "id", "u", "at").collect()}
    assert got == {2, 3}


def test_trees_of_any_depth_and_cycles(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(70)] + [("x", "y"), ("y", "z"), ("z", "x"), ("leaf", "x"), ("lost", "nowhere"), ("self", "self")]
    nodes = spark.createDataFrame(chain, "id string, parent_id string")
    got = {r.id: [a.id for a in r.ancestors] for r in tree.with_ancestors(nodes).collect()}
    assert all(got[f"n{i}"] == [f"n{k}" for k in range(i - 1, -1, -1)] for i in range(70))
    assert got["leaf"] == ["x", "y", "z"] and got["x"] == ["y", "z"] and got["y"] == ["z", "x"]
    assert got["lost"] == [] and got["self"] == []
    assert tree.closure(nodes.where("id like 'n%'")).count() == 70 * 71 // 2
    assert tree.with_ancestors(nodes.limit(0)).collect() == []


def test_a_hot_parent_is_one_join(spark):
    nodes = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") % 3 == 0, "root").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("parent_id"))
    inner = spark.createDataFrame([("root", None), *((f"p{i}", "root") for i in range(50))], "id string, parent_id string")
    counts = {r.id: r.assets for r in tree.subtree_counts(nodes.union(inner), nodes.select(F.col("id").alias("asset"), F.col("id").alias("node"))).where("id = 'root'").collect()}
    assert counts == {"root": 3000}


def test_series_and_tables_have_every_value_found(spark):
    rows = [("2024-01-30", "web"), ("2024-01-30", None), ("2024-01-28", "new kind"), ("2024-01-28", "new kind"), ("2020-01-01", "old")]
    df = spark.createDataFrame(rows, "ts string, how string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {(str(r.date), r.series): r.value for r in metrics.daily_by(df, "ts", "how", "2024-01-30", 3).collect()}
    assert len(got) == 9 and {k: v for k, v in got.items() if v} == {("2024-01-30", "web"): 1, ("2024-01-30", None): 1, ("2024-01-28", "new kind"): 2}
    table = {(r.ts, r.how): r.value for r in metrics.crosstab(df.withColumn("ts", F.year("ts")), "ts", "how").collect()}
    assert len(table) == 8 and sum(table.values()) == 5 and table[2020, None] == 0 and table[2024, "new kind"] == 2


def test_an_empty_command_group_hits_nothing(spark):
    commands = spark.createDataFrame([("ls -l",), ("",), (" ",)], "input string")
    groups = [{"id": 1, "type": "command", "content": " \n "}, {"id": 2, "type": "regex", "content": ""}, {"id": 3, "type": "command", "content": "ls"}]
    assert [(r.input, r.group) for r in rules.match_commands(commands, groups).collect()] == [("ls -l", 3)]


def test_repeated_batch_keys_leave_the_target_its_rows(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    batch = spark.createDataFrame([(1, "y"), (1, "x")], "id long, name string")
    assert sorted(ingest.patch(target, batch, "id").collect()) == [(1, "x"), (2, "b")]


def test_uploads_are_read_by_their_header(spark, tmp_path):
    (tmp_path / "up.csv").write_text("name,extra,id\nbob,1,7\nann,2,8\n")
    got = ingest.read_upload(spark, str(tmp_path / "up.csv"), ["id", "name"])
    assert sorted((r.id, r.name) for r in got.collect()) == [("7", "bob"), ("8", "ann")]
    with pytest.raises(ValueError):
        ingest.read_upload(spark, str(tmp_path / "up.csv"), ["id", "mail"])


def test_bad_numbers_do_not_end_a_job(spark):
    df = spark.createDataFrame([('{"k":"abc"}',), ('{"k":5}',), (None,)], "props string")
    assert [r[0] for r in df.select(adapters.props_key(F.col("props"))).collect()] == [None, 5, None]


def test_only_nothing_is_blank(spark):
    df = spark.createDataFrame([("  x ",), ("  ",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(values.blank_default(F.col("c"))).collect()] == ["  x ", "  ", "-", "-"]


def test_search_needs_columns():
    with pytest.raises(ValueError):
        predicates.compile_params({"search": "a"})


@pytest.mark.parametrize("order", ["v", "-v", None])
def test_pages_follow_any_order(spark, order):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i * 7 % 4) for i in range(23)], "id long, v long")
    whole = [(r.id, r.v) for r in ranking.sort_by(df, order, "id").collect()]
    seen, last = [(r.id, r.v) for r in ranking.page(df, 1, 4, order, "id").collect()], None
    while seen[-1] != last:
        last = seen[-1]
        seen += [(r.id, r.v) for r in ranking.page_after(df, "id", last[0], 4, order, last[1]).collect()]
    assert seen == whole


def test_ten_thousand_rules_as_a_table(spark):
    from accesslake.operators import rule_tables

    table = spark.range(10000).select(F.col("id").alias("rule"), (F.col("id") % 97).cast("int").alias("priority"), F.lit("deny").alias("action"))
    users = spark.range(10000).where("id % 2 = 0").select(F.col("id").alias("rule"), (F.col("id") % 500).alias("value"))
    kinds = spark.range(10000).where("id % 3 = 0").select(F.col("id").alias("rule"), F.concat(F.lit("k"), F.col("id") % 7).alias("value"))
    events = spark.range(300).select("id", F.when(F.col("id") % 10 > 0, F.col("id") * 2 % 500).alias("user"), F.concat(F.lit("k"), F.col("id") % 9).alias("kind"))
    got = {r.id: (r.priority, r.rule) for r in rule_tables.evaluate_table(events, "id", table, {"user": users, "kind": kinds}).collect()}
    for e in events.collect():
        fits = [(i % 97, i) for i in range(10000) if (i % 2 or i % 500 == e.user) and (i % 3 or f"k{i % 7}" == e.kind)]
        assert got[e.id] == min(fits)
    none = rule_tables.evaluate_table(events, "id", table.where("rule % 6 = 0 and rule < 10"), {"user": users, "kind": kinds})
    assert none.count() == 300 and none.where("rule is null").count() > 0


def test_networks_as_a_table(spark):
    import ipaddress

    from accesslake.operators import rule_tables

    texts = ["10.0.0.0/8", "10.1.2.3", "0.0.0.0/0", "10.1.2.0/30", "bad", "1.2.3.4/40", None]
    nets = spark.createDataFrame(list(enumerate(texts)), "group int, network string")
    addresses = ["10.1.2.3", "10.1.2.4", "192.168.0.1", "x", None, "300.1.1.1"]
    got = {(r.address, r.group) for r in rule_tables.match_networks(spark.createDataFrame([(x,) for x in addresses], "address string"), "address", nets).collect()}
    assert got == {(x, g) for x in addresses[:3] for g in range(4) if ipaddress.ip_address(x) in ipaddress.ip_network(texts[g], strict=False)}
    assert rule_tables.match_networks(spark.createDataFrame([("1.1.1.1",)], "address string"), "address", nets.limit(0)).collect() == []


def test_expired_and_inactive_permissions_grant_nothing(spark):
    from accesslake.operators import relations

    rows = [(1, ["connect"], True, "2020-01-01", "2030-01-01"), (2, ["upload"], False, "2020-01-01", "2030-01-01"), (3, ["upload"], True, "2020-01-01", "2021-01-01")]
    perms = spark.createDataFrame(rows, "permission long, actions array<string>, is_active boolean, date_start string, date_expired string")
    perms = perms.withColumn("date_start", F.col("date_start").cast("timestamp")).withColumn("date_expired", F.col("date_expired").cast("timestamp"))
    live = relations.in_force(perms, "2024-01-01")
    users = spark.createDataFrame([(p, 7) for p in (1, 2, 3)], "permission long, user long")
    assets = spark.createDataFrame([(p, a) for p, a in ((1, 1), (2, 1), (3, 2))], "permission long, asset long")
    asked = spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "user long, asset long")
    got = {(r.user, r.asset): (r.permissions, r.granted, r.actions) for r in relations.resolve(asked, live, users, assets, ["connect", "upload"]).collect()}
    assert got == {(7, 1): (1, True, ["connect"]), (7, 2): (0, False, []), (8, 1): (0, False, [])}
    selectors = live.withColumn("selectors", F.array(F.lit("@SPEC"), F.lit("root")))
    accounts = spark.createDataFrame([(1, "root"), (1, "dev"), (2, "root")], "asset long, username string")
    found = relations.granted_accounts(relations.granted(asked, selectors, users, assets), selectors, accounts, ["connect", "upload"]).collect()
    assert [tuple(r) for r in found] == [("7", 1, "root", ["connect"])]


def test_a_hot_key_is_spread_by_its_own_count(spark):
    from accesslake.operators.relations import attach_spread

    df = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    per_key = df.groupBy("k").agg(F.count("*").alias("n"))
    joined = attach_spread(df, per_key, "k", F.col("row"), "n", hot_keys=30)
    assert joined.count() == 3000 and joined.where("n is null").count() == 0
    assert joined.where("k = 0").agg(F.max("n")).first()[0] == 1000
