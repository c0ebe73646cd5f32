import random
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from accesslake.operators import relations as r
from accesslake.operators import rules, sets, tree
from accesslake.sources import adapters as a
from tests.conftest import SMALL

SELECTORS = [
    ["@ALL"],
    ["@ALL", "@USER", "@INPUT"],
    ["@SPEC", "a", "zz", "u"],
    ["@SPEC", "a", "@USER", "@ANON"],
    ["@NOT", "a", "zz"],
    ["@NOT", "u", "@USER"],
    ["@NONE", "@INPUT"],
    ["@USER"],
    ["@INPUT", "@ANON"],
    [],
]


def allowed(selectors, user, username, exists):
    if "@NONE" in selectors:
        return False
    if username in ("@INPUT", "@ANON"):
        return username in selectors
    real = (
        "@ALL" in selectors
        or ("@SPEC" in selectors and username in selectors)
        or ("@NOT" in selectors and username not in selectors)
        or ("@USER" in selectors and username == user)
    )
    return exists and real


def test_account_selectors_agree_with_brute_force(spark):
    accounts = [(asset, name) for asset in (1, 2) for name in ("a", "b", "u", "w")[: 2 + asset]] + [(1, "a")]
    scopes = [(i, user, asset, s) for i, s in enumerate(SELECTORS) for user in ("u", "q") for asset in (1, 2, 3)]
    acc = spark.createDataFrame(accounts, ["asset", "username"])
    sc = spark.createDataFrame(scopes, "scope int, user string, asset int, selectors array<string>")
    known = set(accounts)
    names = sorted({n for _, n in accounts}) + ["@INPUT", "@ANON"]
    want = {(i, u, x, n) for i, u, x, s in scopes for n in names if allowed(s, u, n, (x, n) in known)}

    listed = r.selected_accounts(sc, acc.distinct()).collect()
    assert sorted(tuple(t) for t in listed) == sorted(want)

    counted = {(t.scope, t.user, t.asset): t.usable for t in r.usable_accounts(sc, acc).collect()}
    assert counted == {(i, u, x): sum(w[:3] == (i, u, x) for w in want) for i, u, x, _ in scopes}

    requests = sc.crossJoin(spark.createDataFrame([(n,) for n in [*names, "nobody"]], ["username"]))
    got = {(t.scope, t.user, t.asset, t.username) for t in r.account_allowed(requests, acc).collect() if t.allowed}
    assert got == want


@pytest.mark.parametrize("listed, most_long", [(1000, 10), (4, 10), (4, 0)])
def test_listed_accounts_agree_with_brute_force(spark, monkeypatch, listed, most_long):
    """All assets listed, one of two too long for it, and more of these than are told apart."""
    for name, value in {"FEW": 0, "LISTED": listed, "MOST_LONG": most_long}.items():
        monkeypatch.setattr(r, name, value)
    test_account_selectors_agree_with_brute_force(spark)


def test_listed_accounts_agree_with_looked_up_ones(spark, monkeypatch):
    rng, some = random.Random(2), ["a", "b", "u", "@odd", "@ALL", "@SPEC", "@NOT", "@NONE", "@USER", "@INPUT", "@ANON", None]
    pick = lambda values: rng.choice([*values, None])
    accounts = spark.createDataFrame([(pick([1, 2, 3]), pick(["a", "b", "u", "@odd", "@INPUT"])) for _ in range(25)], "asset int, username string")
    rows = [(pick(range(90)), pick(["a", "u", "@odd"]), pick([1, 2, 3, 4]), rng.choice([None, *[rng.sample(some, rng.randrange(6)) for _ in range(9)]]), pick(some)) for _ in range(400)]
    scopes = spark.createDataFrame(rows, "scope int, user string, asset int, selectors array<string>, username string").dropDuplicates(["scope", "user", "asset"]).localCheckpoint()
    found = {}
    for few in (10_000, 0):
        monkeypatch.setattr(r, "FEW", few)
        done = r.account_allowed(r.usable_accounts(scopes, accounts), accounts).select("scope", "user", "asset", "selectors", "username", "allowed", "usable")
        found[few] = sorted(map(repr, done.collect()))
    assert found[0] == found[10_000] and len(found[0]) == scopes.count() > 200


def test_accesses_move_once_an_answer(spark, monkeypatch):
    """Two exchanges join orders and lines, two make lists of accounts, and each of two answers moves the accesses once."""
    monkeypatch.setattr(r, "FEW", 0, raising=False)
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        found = queries()["account_spec"](spark, SMALL)
        found.collect()
        text = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
    assert len(re.findall(r"(?<!, )Exchange hashpartitioning", text)) == 6


def test_batch_exists_only_if_all_do(spark):
    acc = spark.createDataFrame([("a", 1)], ["username", "asset"])
    some = r.account_exists(spark.createDataFrame([("a", 1), ("b", 1)], ["username", "asset"]), acc, ["username", "asset"])
    assert r.all_exist(some).first()[0] is False
    assert r.all_exist(some.where("username = 'a'")).first()[0] is True
    assert r.all_exist(some.where("username = 'none'")).first()[0] is False


def test_spread_join_equals_plain_join(spark, tables):
    lines = tables.lineitem.select("l_returnflag", "l_orderkey")
    per_key = lines.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    plain = lines.join(per_key, "l_returnflag", "left")
    for options in ({}, {"rows": "n"}, {"rows": "n", "hot_keys": 2}):
        spread_out = r.attach_spread(lines, per_key, "l_returnflag", F.col("l_orderkey"), **options).select(*plain.columns)
        assert spread_out.exceptAll(plain).isEmpty() and plain.exceptAll(spread_out).isEmpty()


def test_permitted_users_agree_with_resolution(spark, tables):
    from accesslake.catalog.relations import permission_sides

    users, assets = permission_sides(tables)
    page = {(t.user, t.permission) for t in r.permitted_users(1, users, assets).collect()}
    asked = users.select("user").distinct().withColumn("asset", F.lit(1).cast("bigint"))
    perms = a.permissions(tables.nation).select("permission", "actions")
    granted = {t.user for t in r.resolve(asked, perms, users, assets, a.ACTIONS).where("granted").collect()}
    assert granted == {u for u, _ in page} and granted


def test_rules_by_priority_then_id(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], ["u"])
    docs = [
        {"id": 7, "action": "late", "users": {"type": "all"}},
        {"id": 9, "priority": 5, "action": "b", "users": {"type": "ids", "ids": [1]}},
        {"id": 8, "priority": 5, "action": "a", "users": {"type": "ids", "ids": [1, 2]}},
        {"id": 1, "priority": 1, "action": "off", "users": {"type": "all"}, "is_active": False},
    ]
    assert [(t.u, t.action) for t in rules.evaluate(df, docs, "u").orderBy("u").collect()] == [(1, "a"), (2, "a"), (3, "late")]
    assert rules.evaluate(df, [], "u").where("rule is not null").isEmpty()


def test_login_rules_need_reviewers():
    try:
        rules.check_login_rules([{"id": 1, "action": "review"}])
        raise AssertionError
    except ValueError:
        pass
    assert rules.check_login_rules([{"id": 1}])[0]["action"] == "reject"


def test_command_groups_match_whole_words(spark):
    df = spark.createDataFrame([("rm -rf /",), ("alarm",), ("RM x",), ("a.b",), ("axb",)], ["input"])
    group = {"id": 1, "type": "command", "content": "rm\r\na.b", "ignore_case": False}
    assert {t.input for t in rules.match_commands(df, [group]).collect()} == {"rm -rf /", "a.b"}
    assert {t.input for t in rules.match_commands(df, [{**group, "ignore_case": True}]).collect()} == {"rm -rf /", "RM x", "a.b"}


NODES = [("1", None, "Root"), ("2", "1", "Asia"), ("3", "2", "Leaf"), ("4", "1", "Other"), ("5", "3", "Deep")]


def test_tree_needs_no_depth(spark):
    nodes = spark.createDataFrame(NODES, "id string, parent_id string, name string")
    free = tree.closure(nodes)
    assert free.count() == 1 + 2 + 3 + 2 + 4
    flat = tree.flatten(nodes).orderBy("path").collect()
    assert [(x.id, x._level) for x in flat] == [("1", 0), ("2", 1), ("3", 2), ("5", 3), ("4", 1)]


def test_tree_search_and_visibility(spark):
    nodes = spark.createDataFrame(NODES, "id string, parent_id string, name string")
    assert {x.id for x in tree.search(nodes, "LEAF").collect()} == {"1", "2", "3", "5"}
    assert {x.id for x in tree.search(nodes, "none").collect()} == set()
    marked = nodes.withColumn("expanded", F.col("name") != "Leaf")
    assert {x.id for x in tree.visible(marked, "expanded").collect()} == {"1", "2", "3", "4"}
    assert {x.id for x in tree.leaves(nodes.select("id"), nodes).collect()} == {"4", "5"}


def test_tree_cycles_end(spark):
    nodes = spark.createDataFrame([("a", "b", "A"), ("b", "a", "B"), ("c", "c", "C")], "id string, parent_id string, name string")
    assert {tuple(x) for x in tree.closure(nodes).collect()} == {
        ("a", "a", 0), ("b", "a", 1), ("b", "b", 0), ("a", "b", 1), ("c", "c", 0),
    }


def test_dependencies_go_one_hop_and_skip_unknown(spark):
    def ids(*xs):
        return spark.createDataFrame([(x,) for x in xs], "id string")

    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x")], ["id", "depends_on"])
    assert {x.id for x in tree.expand_dependencies(ids("a"), deps, ids("a", "b", "c")).collect()} == {"a", "b"}


def test_page_toggle(spark):
    def ids(*xs):
        return spark.createDataFrame([(x,) for x in xs], "id int")

    assert sorted(x.id for x in sets.toggle_page(ids(1, 2), ids(2, 3), "id").collect()) == [1, 2, 3]
    assert sorted(x.id for x in sets.toggle_page(ids(1, 2, 3), ids(2, 3), "id").collect()) == [1]


def test_inventory_classes(spark):
    cloud = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, x string")
    local = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id int, x string")
    got = {x.id: x["class"] for x in r.sync_classify(cloud, local, "id", ["x"]).collect()}
    assert got == {1: "new", 2: "unsync", 3: "sync", 4: "released"}


LINES = "l_suppkey long, l_partkey long, l_linestatus string, l_returnflag string, l_shipdate timestamp_ntz, l_quantity double, l_discount double, l_tax double"


def test_snapshots_of_one_log_are_reduced_together(spark):
    import datetime as dt

    day = lambda n: None if n is None else dt.datetime(2024, 1, n)
    rows = [(k % 3 if k % 7 else None, k % 2 if k % 5 else None, "OF"[k % 2] if k % 11 else None, "RNA"[k // 2 % 3] if k % 13 else None, day(k % 9 + 1 if k % 4 else None), float(k % 6), 0.1, None) for k in range(80)]
    rows += [(9, 9, "O", "R", day(3), 1.0, 0.0, 0.0), (8, 8, "F", "N", day(4), 2.0, 0.0, 0.0), (7, 7, "F", "R", day(5), 3.0, 0.0, 0.0), (6, None, "O", "N", day(6), 4.0, 0.0, 0.0)]
    lines = a.account_lines(spark.createDataFrame(rows, LINES))
    keys = ["username", "asset"]
    together = r.reconcile(a.managed_snapshot(lines), a.discovered_snapshot(lines), keys)
    joined = r.reconcile(a.managed_snapshot(lines).frame(), a.discovered_snapshot(lines).frame(), keys)
    assert together.columns == joined.columns
    key = lambda row: str(tuple(row))
    found = sorted(together.collect(), key=key)
    assert found == sorted(joined.collect(), key=key)
    assert len([x for x in found if x.username == 6]) == 2  # a null key meets none
    text = together._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in text and text.count("Exchange") == 1
