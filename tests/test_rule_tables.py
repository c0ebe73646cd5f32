import datetime as dt
import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from accesslake.operators import patterns, rule_tables, rules

RANGES = ["10.0.0.1-10.0.0.1", "10.0.0.0-10.0.0.255", "0.0.0.1-255.255.255.254", "0.0.0.0-255.255.255.255", " 10.0.0.3 - 10.0.1.77 ", "255.255.255.255-255.255.255.255"]


def test_a_range_becomes_the_fewest_networks(spark):
    rng = random.Random(4)
    ends = [sorted(rng.randrange(2**32) for _ in range(2)) for _ in range(60)]
    specs = RANGES + [f"{ipaddress.IPv4Address(x)}-{ipaddress.IPv4Address(y)}" for x, y in ends]
    df = spark.createDataFrame([(s,) for s in specs], "s string").select("s", rule_tables.network_blocks(F.col("s")).alias("b"))
    for r in df.collect():
        low, high = (ipaddress.IPv4Address(x.strip()) for x in r.s.split("-"))
        want = {(n.prefixlen, int(n.network_address) >> (32 - n.prefixlen)) for n in ipaddress.summarize_address_range(low, high)}
        assert {(b.length, b.prefix) for b in r.b} == want and len(r.b) == len(want) <= 62


def test_groups_by_every_kind_of_network(spark):
    specs = [(1, "*"), (2, "10.0.0.8-10.0.0.20"), (3, "10.0.0.16/28"), (3, "10.0.0.17"), (4, "10.0.0.20-10.0.0.8"), (5, "nowhere"), (6, None), (7, "10.0.0.0/40"), (8, "10.0.0.9"), (9, "")]
    groups = spark.createDataFrame(specs, "group int, network string")
    rows = spark.createDataFrame([(i, f"10.0.0.{i}") for i in (7, 8, 9, 17, 20, 21)] + [(90, None), (91, "host"), (92, "10.0.0.999")], "id int, address string")
    found = {}
    for r in rule_tables.match_networks(rows, "address", groups).collect():
        found.setdefault(r.id, set()).add(r.group)
    assert found == {7: {1}, 8: {1, 2}, 9: {1, 2, 8}, 17: {1, 2, 3}, 20: {1, 2, 3}, 21: {1, 3}}
    assert {r.group for r in rule_tables.unreadable_networks(groups).collect()} == {4, 5, 6, 7, 9}


def test_hits_are_not_made_distinct_and_busy_blocks_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(rule_tables, "ROWS_A_BLOCK", 3)
    specs = [(g, "*") for g in (1, 2, None)] + [(1, "10.0.0.0/8"), (1, "10.0.0.3"), (3, "10.0.0.0/30"), (3, "10.0.0.1-10.0.0.6"), (3, "10.0.0.2"), (None, "10.0.0.4"), (4, "10.0.0.5"), (4, "10.0.0.5")]
    groups = spark.createDataFrame(specs, "group int, network string")
    ids = [(i, f"10.0.0.{i % 8}") for i in range(40)] + [(3, "10.0.0.3"), (None, "10.0.0.5"), (77, None)]
    hits = rule_tables.match_networks(spark.createDataFrame(ids, "id int, address string"), "address", groups)
    held = {1: range(8), 2: range(8), None: range(8), 3: range(7), 4: [5]}
    want = [(i, a, g) for i, a in set(ids) if a for g, last in held.items() if int(a[-1]) in last]
    assert sorted(map(str, (tuple(r) for r in hits.collect()))) == sorted(map(str, want))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join Inner")]
    assert "Aggregate" not in top  # a distinct would move every hit
    assert "rightHint=(strategy=merge)" in plan  # the looked-up rows are not broadcast


def test_login_rules_as_rows_agree_with_compiled_rules(spark):
    rng = random.Random(6)
    compiled, users, networks, periods, table = [], [], [], [], []
    for i in range(40):
        rule = {"id": i, "priority": rng.randrange(1, 9), "action": rng.choice(["reject", "accept"])}
        table.append((i, rule["priority"], rule["action"]))
        if rng.random() < 0.7:
            ids = rng.sample(range(8), 3)
            rule["users"] = {"type": "ids", "ids": ids}
            users += [(i, u) for u in ids]
        if rng.random() < 0.6:
            rule["ip_group"] = rng.sample(["10.0.0.0/30", "10.0.0.2-10.0.0.9", "10.0.0.5"], 2)
            networks += [(i, n) for n in rule["ip_group"]]
        if rng.random() < 0.7:
            spans = [(rng.randrange(7), b := rng.randrange(40), rng.randrange(b + 1, 49)) for _ in range(3)]
            clock = lambda h: f"{h // 2 % 24:02d}:{h % 2 * 30:02d}"
            rule["time_period"] = [{"id": d, "value": f"{clock(b)}~{clock(e)}"} for d, b, e in spans]
            periods += [(i, d, clock(b), clock(e)) for d, b, e in spans]
        compiled.append(rule)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.randrange(9), f"10.0.0.{rng.randrange(12)}", start + dt.timedelta(minutes=rng.randrange(20000))) for i in range(600)]
    rows += [(600, None, "10.0.0.1", start), (601, 1, None, start), (602, 1, "10.0.0.1", None), (603, None, None, None), (604, 3, "host", start)]
    logins = spark.createDataFrame(rows, "id int, user_id int, ip string, ts timestamp")
    tables = [spark.createDataFrame(table, "rule int, priority int, action string"), spark.createDataFrame(users, "rule int, value int"), spark.createDataFrame(networks, "rule int, network string"), spark.createDataFrame(periods, "rule int, weekday int, begin string, finish string")]
    got = {r.id: r.rule for r in rule_tables.login_acl_table(logins, "user_id", "ip", "ts", *tables).collect()}
    want = {r.id: r.rule for r in rules.login_acl(logins, compiled, "user_id", "ip", "ts").collect()}
    assert got == want and len(set(got.values())) > 8
    none = [t.limit(0) for t in tables]
    assert {r.rule for r in rule_tables.login_acl_table(logins, "user_id", "ip", "ts", *none).collect()} == {None}
    assert rule_tables.login_acl_table(logins.limit(0), "user_id", "ip", "ts", *tables).collect() == []


def most_rows(spark, df):
    """The result's rows and the most rows that one operator of its plan gave out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows, todo, most = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    while todo:
        node = todo.pop()
        counted = node.metrics().get("numOutputRows")
        most = max(most, counted.get().value() if counted.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def test_events_and_rules_are_not_paired(spark):
    numbers = spark.range(300)
    table = numbers.select(F.col("id").alias("rule"), (F.col("id") % 7).cast("int").alias("priority"), F.lit("deny").alias("action"))
    users = numbers.select(F.col("id").alias("rule"), F.lit(1).alias("value"))
    kinds = numbers.select(F.col("id").alias("rule"), F.concat(F.lit("k"), F.col("id") % 5).alias("value")).where("rule % 7 > 1")
    events = numbers.select("id", F.lit(1).alias("user"), F.concat(F.lit("k"), F.col("id") % 6).alias("kind"))
    rows, most = most_rows(spark, rule_tables.evaluate_table(events, "id", table, {"user": users, "kind": kinds}))
    assert {(r.id, r.priority, r.rule) for r in rows} == {(i, 0, 0) for i in range(300)}
    assert most <= 900


@pytest.mark.parametrize("spelled", [1, 2, 16])
def test_rules_with_many_values_agree_with_brute_force(spark, monkeypatch, spelled):
    monkeypatch.setattr(rule_tables, "MOST_SPELLED", spelled)
    rng, names = random.Random(spelled), ["a", "b", "c"]
    table = [(i if i < 40 else None, rng.randrange(9), rng.choice("xy")) for i in range(41)] + [(3, 1, "z")]
    scopes = {n: [(i, v) for i in range(40) if rng.random() < 0.6 for v in rng.sample([0, 1, 2, 3, 4, 5, None], rng.randrange(1, 6))] for n in names}
    rows = [(i % 190, *(rng.choice([0, 1, 2, 3, 4, 5, 6, None]) for _ in names)) for i in range(200)] + [(None, 1, 1, 1)]

    def fits(rule, event):
        held = [({v for r, v in scopes[n] if r == rule and rule is not None}, any(r == rule for r, _ in scopes[n])) for n in names]
        return all(not limited or (x is not None and x in some) for x, (some, limited) in zip(event, held))

    def won(number):
        mine = [e[1:] for e in rows if e[0] == number] if number is not None else []
        free = [r for r in table if all(r[0] is None or r[0] not in {i for i, _ in scopes[n]} for n in names)]
        known = [r for r in table if r[0] is not None and any(fits(r[0], e) for e in mine)] + free
        return min((p, -1 if r is None else r, a) for r, p, a in known) if known else (None, -1, None)

    events = spark.createDataFrame(rows, "id int, a int, b int, c int")
    frames = {n: spark.createDataFrame(scopes[n], "rule int, value int") for n in names}
    got = rule_tables.evaluate_table(events, "id", spark.createDataFrame(table, "rule int, priority int, action string"), frames).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.priority, -1 if r.rule is None else r.rule, r.action) == won(r.id)


def test_half_hours(spark):
    df = spark.createDataFrame([(1, 0, "00:00", "00:30"), (1, 6, "23:30", "00:00"), (2, 3, "08:10", "09:20"), (3, 1, "x", "09:00"), (4, 2, "10:00", "09:00")], "rule int, weekday int, begin string, finish string")
    got = {r.rule: list(r.weeks) for r in rule_tables.week_bitmaps(df).collect()}
    assert got == {1: [1, 0, 0, 0, 0, 0, 1 << 47], 2: [0, 0, 0, 0b111 << 16, 0, 0, 0], 3: [0] * 7, 4: [0] * 7}


GROUPS = [
    (1, "command", "the\r\nthat  \n\n", True), (2, "regex", "th.*and|reboot", False), (3, "command", "La", False), (4, "command", "rm -rf", True),
    (5, "regex", "colou?r", True), (6, "command", "", True), (7, "regex", "  ", True), (8, "command", "***", True), (9, "regex", "ab+cde*f", False),
    (10, "regex", r"^sudo\s+su", True), (11, "command", "été", True), (12, "regex", None, True), (13, "regex", "shut.?down now", None), (14, "command", "x", True),
]
TEXTS = ["the end", "other", "La la", "la", "sudo rm -rf /", "xrm -rf", "color", "colour", "colr", "a *** b", "abbbcdf", "abbbcdeeef", "sudo   su -", "l'été", "ete", "shut down now", "SHUTDOWN NOW", "th x and", "reboot", "x", "", None, "that that", "İ x K"]


def test_patterns_agree_with_compiled_groups(spark):
    commands = spark.createDataFrame(list(enumerate(TEXTS)), "id int, said string")
    table = spark.createDataFrame(GROUPS, "group int, type string, content string, ignore_case boolean")
    got = patterns.match_command_table(commands, ["id"], "said", table)
    assert got.columns == ["id", "said", "group"]
    documents = [{"id": g, "type": k, "content": c or "", "ignore_case": i is not False} for g, k, c, i in GROUPS]
    want = sorted((r.id, r.group) for r in rules.match_commands(commands, documents, "said").collect())
    assert sorted((r.id, r.group) for r in got.collect()) == want and len(want) > 15


def test_patterns_in_many_blocks_agree_with_compiled_groups(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK", 30)
    monkeypatch.setattr(patterns, "TASK_TRIES", 5)
    rng, parts = random.Random(4), ["rm", "Rm", "-rf", "rf", "RM_x", "été", "su", "sudo", " ", "  ", "/", "x", "İ", "K", "a1", "a1b", "_"]
    made = lambda most: "".join(rng.choice(parts) + rng.choice(["", " ", "-"]) for _ in range(rng.randrange(1, most)))
    documents = [{"id": i, "type": "command", "content": f"{made(3)}\n{made(4)}\r\n{made(2)}", "ignore_case": i % 2 == 0} for i in range(30)]
    documents += [{"id": i, "type": "regex", "content": rng.choice([".*", "+", ".?", " "]).join(rng.choice(["rm", "sudo", "RM_x", "a1b", "su  x"]) for _ in range(2)), "ignore_case": i % 2 == 0} for i in range(30, 50)]
    commands = spark.createDataFrame([(i % 70, made(9)) for i in range(120)], "id int, said string")
    table = spark.createDataFrame([(d["id"], d["type"], d["content"], d["ignore_case"]) for d in documents], "group int, type string, content string, ignore_case boolean")
    got = patterns.match_command_table(commands, ["id"], "said", table)
    want = {(r.id, r.group) for r in rules.match_commands(commands, documents, "said").collect()}
    assert sorted((r.id, r.group) for r in got.collect()) == sorted(want) and len(want) > 300


@pytest.mark.parametrize("block", [3, 200_000])
def test_only_commands_move_and_once(spark, monkeypatch, block):
    """Neither the pieces of commands nor what is tried on them nor the hits are dealt out."""
    monkeypatch.setattr(patterns, "BLOCK", block, raising=False)
    commands = spark.createDataFrame([(i, "the end of all and one") for i in range(50)], "id int, said string")
    table = spark.createDataFrame([(g, "command", "the\nall", True) for g in range(4)], "group int, type string, content string, ignore_case boolean")
    hits = patterns.match_command_table(commands, ["id"], "said", table).select("id", "group")
    assert sorted(hits.collect()) == [(i, g) for i in range(50) for g in range(4)]
    dealt = re.findall(r"(?<!, )Exchange hashpartitioning\(([^)]*)\)", hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
    assert len(dealt) == 1 and dealt[0].startswith("id#")


def test_conversations_of_one_word_make_no_group(spark, tmp_path):
    from accesslake.catalog import QUERIES

    said = ["abcd", "Abcd and efgh-x", "abcd efgh-x", None, "", "go abcd efgh"]
    rows = [(c, n, "user", text) for n in range(2) for c, text in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted({(r.session, r.turn, r.group) for r in QUERIES["command_filter_table"](spark, str(tmp_path)).collect()})
    assert {g for _, _, g in got} == {1, 2, 5} and {s for s, _, g in got if g == 2} == {1, 2, 5}


def test_too_many_patterns_without_a_piece(spark, monkeypatch):
    monkeypatch.setattr(patterns, "MOST_LOOSE", 2)
    table = spark.createDataFrame([(i, "regex", f"(a{i})", True) for i in range(3)], "group int, type string, content string, ignore_case boolean")
    commands = spark.createDataFrame([(1, "a1")], "id int, said string")
    with pytest.raises(ValueError):
        patterns.match_command_table(commands, ["id"], "said", table)


def _first(node, found):
    """The first node of a logical plan, from the top, for which ``found`` holds."""
    if found(node):
        return node
    below = (_first(node.children().apply(i), found) for i in range(node.children().size()))
    return next((n for n in below if n is not None), None)


def test_findings_do_not_move_the_snapshots(tables):
    from accesslake.catalog.risks import findings

    top = _first(findings(tables)._jdf.queryExecution().optimizedPlan(), lambda n: n.nodeName() == "Join")
    assert "managed_" not in top.output().toString() and "remote_" not in top.output().toString()


def test_looked_up_names_do_not_carry_their_selectors(spark):
    from accesslake.operators import relations as r

    scopes = spark.createDataFrame([(1, "u", 1, ["@SPEC", "a"]), (2, "u", 1, ["@NOT", "u", "b"])], "scope int, user string, asset int, selectors array<string>")
    counted = r.usable_accounts(scopes, spark.createDataFrame([(1, "a"), (1, "u"), (1, "c")], "asset int, username string"))
    assert sorted((x.scope, x.usable) for x in counted.collect()) == [(1, 1), (2, 2)]
    plan = counted._jdf.queryExecution().optimizedPlan()
    sums = _first(plan, lambda n: n.nodeName() == "Aggregate" and "_own_named" in n.output().toString())
    assert "selectors" not in _first(sums, lambda n: n.nodeName() == "Join").output().toString()
