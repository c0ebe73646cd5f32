"""Queries over differences, account risks and masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.catalog.registry import LINES_AS_OF, ORDERS_AS_OF, query
from accesslake.catalog.relations import LEAK_SQL, RECONCILE_SQL, accounts_with_secret, reconciled
from accesslake.operators import changes, masking, ranking, risks
from accesslake.operators import relations as r
from accesslake.sources import adapters as a

SNAPSHOT_SQL = """
    b AS (SELECT * FROM customer),
    a AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey < 5 THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal,
                 CASE WHEN c_mktsegment = 'FURNITURE' AND c_acctbal > 5000 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment
          FROM customer WHERE c_acctbal >= 0
          UNION ALL SELECT s_suppkey + 10000000000, s_name, s_nationkey, s_acctbal, 'NEW' FROM supplier),
    j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS id, a.c_name AS an, b.c_name AS bn, a.c_nationkey AS ak, b.c_nationkey AS bk,
                 a.c_acctbal AS ab, b.c_acctbal AS bb, a.c_mktsegment AS am, b.c_mktsegment AS bm
          FROM a FULL OUTER JOIN b ON a.c_custkey = b.c_custkey)
"""


def snapshots(t):
    return a.user_snapshot_before(t.customer), a.user_snapshot_after(t.customer, t.supplier)


@query(
    "field_diff",
    f"""WITH {SNAPSHOT_SQL}, d AS (
            SELECT id, 'c_name' AS field, bn AS before, an AS after FROM j UNION ALL SELECT id, 'c_nationkey', bk::VARCHAR, ak::VARCHAR FROM j
            UNION ALL SELECT id, 'c_acctbal', bb::VARCHAR, ab::VARCHAR FROM j UNION ALL SELECT id, 'c_mktsegment', bm, am FROM j)
        SELECT * FROM d WHERE before IS DISTINCT FROM after""",
)
def field_diff(t):
    fields = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    return changes.field_diff(*snapshots(t), "c_custkey", fields).withColumnRenamed("c_custkey", "id")


@query(
    "nested_diff",
    f"""WITH {SNAPSHOT_SQL}, d AS (
            SELECT id, 'profile.name' AS path, an AS value, bn AS base FROM j WHERE an IS NOT NULL
            UNION ALL SELECT id, 'profile.place.nation', ak::VARCHAR, bk::VARCHAR FROM j WHERE an IS NOT NULL
            UNION ALL SELECT id, 'balance', ab::VARCHAR, bb::VARCHAR FROM j WHERE an IS NOT NULL)
        SELECT id, path, value FROM d WHERE value IS DISTINCT FROM base""",
)
def nested_diff(t):
    def shaped(df):
        place = F.struct(F.col("c_nationkey").alias("nation"))
        profile = F.struct(F.col("c_name").alias("name"), place.alias("place"))
        return df.select(
            F.col("c_custkey").alias("id"), F.struct(profile.alias("profile"), F.col("c_acctbal").alias("balance")).alias("object")
        )

    before, after = snapshots(t)
    return changes.nested_diff(shaped(after), shaped(before), "id", "object")


@query("risk_new_found", f"WITH {RECONCILE_SQL} SELECT username, asset FROM rec WHERE remote_present AND NOT present")
def risk_new_found(t):
    return risks.new_found(reconciled(t)).select("username", "asset")


@query("risk_account_deleted", f"WITH {RECONCILE_SQL} SELECT username, asset FROM rec WHERE present AND NOT remote_present")
def risk_account_deleted(t):
    return risks.account_deleted(reconciled(t)).select("username", "asset")


@query(
    "risk_long_no_login",
    """SELECT l_suppkey AS username, l_partkey AS asset, date_diff('day', max(l_shipdate)::DATE, DATE '2001-11-04') AS days FROM lineitem
       GROUP BY 1, 2 HAVING max(l_shipdate) IS NULL OR date_diff('day', max(l_shipdate)::DATE, DATE '2001-11-04') > 90""",
)
def risk_long_no_login(t):
    idle = a.account(t.lineitem).where(risks.idle(F.col("date_last_login"), risks.NO_LOGIN_DAYS, LINES_AS_OF))
    days = F.datediff(F.lit(LINES_AS_OF).cast("date"), F.col("date_last_login"))
    return idle.select("username", "asset", days.cast("bigint").alias("days"))


@query(
    "risk_long_time_password",
    """SELECT o_custkey AS account, strftime(max(o_orderdate), '%Y-%m-%d') AS changed FROM orders GROUP BY 1
       HAVING date_diff('day', max(o_orderdate)::DATE, DATE '2001-08-01') > 180""",
)
def risk_long_time_password(t):
    newest = t.orders.groupBy(F.col("o_custkey").alias("account")).agg(F.max("o_orderdate").alias("changed"))
    old = newest.where(risks.older_than(F.col("changed"), risks.PASSWORD_DAYS, ORDERS_AS_OF))
    return old.select("account", F.date_format("changed", "yyyy-MM-dd").alias("changed"))


@query(
    "risk_password_expired",
    """SELECT o_custkey AS account FROM orders GROUP BY 1 HAVING date_diff('day', max(o_orderdate)::DATE, DATE '2001-08-01') > 365""",
)
def risk_password_expired(t):
    newest = t.orders.groupBy(F.col("o_custkey").alias("account")).agg(F.max("o_orderdate").alias("changed"))
    return newest.where(risks.older_than(F.col("changed"), risks.PASSWORD_VALID_DAYS, ORDERS_AS_OF)).select("account")


WEAK_SQL = """(length(s) < 12 OR NOT regexp_matches(s, '[A-Za-z]') OR NOT regexp_matches(s, '[0-9]') OR NOT regexp_matches(s, '[^A-Za-z0-9]'))"""


@query(
    "risk_weak_password",
    f"""WITH acc AS (SELECT DISTINCT l_suppkey AS username, l_partkey AS asset, p_name || '#' || p_size || '#' || l_suppkey AS s
                     FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT username, asset FROM acc WHERE {WEAK_SQL}""",
)
def risk_weak_password(t):
    return accounts_with_secret(t).where(risks.weak(F.col("secret"))).select("username", "asset")


@query(
    "risk_leaked_password",
    f"""WITH {LEAK_SQL}, s AS (SELECT DISTINCT l_suppkey AS username, p_partkey AS asset, p_name || '#' || p_size || '#' || l_suppkey AS secret
                               FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N')
        SELECT username, asset FROM s WHERE secret IN (SELECT password FROM leak)""",
)
def risk_leaked_password(t):
    """Secrets to be handed out, checked against the leak list."""
    asked = t.lineitem.where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("username"), F.col("l_partkey").alias("asset")).distinct()
    wanted = asked.join(t.part, F.col("asset") == F.col("p_partkey")).select(
        "username", "asset", a.account_secret(F.col("p_name"), F.col("p_size"), F.col("username")).alias("secret")
    )
    return r.leaked(wanted, a.leak_list(t.lineitem, t.part)).select("username", "asset")


@query(
    "risk_repeated_password",
    """SELECT doc_id AS account, same FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS same FROM documents) WHERE same > 1""",
)
def risk_repeated_password(t):
    secrets = t.documents.select(F.col("doc_id").alias("account"), F.col("text").alias("secret"))
    return risks.repeated(secrets, "secret", "account").select("account", "same")


@query(
    "risk_attr_changed",
    f"""WITH {RECONCILE_SQL}, both_sides AS (SELECT * FROM rec WHERE present AND remote_present)
        SELECT username, asset, 'groups_changed' AS risk FROM both_sides WHERE mg <> dg
        UNION ALL SELECT username, asset, 'sudoers_changed' FROM both_sides WHERE ms <> ds
        UNION ALL SELECT username, asset, 'authorized_keys_changed' FROM both_sides WHERE mk <> dk""",
)
def risk_attr_changed(t):
    rec = reconciled(t)
    named = [F.when(test, F.lit(name)) for name, test in risks.attr_changed(rec).items()]
    return rec.select("username", "asset", F.explode(F.array_compact(F.array(*named))).alias("risk"))


FINDINGS_SQL = f"""{RECONCILE_SQL}, {LEAK_SQL},
    full_rec AS (SELECT rec.*, p_name || '#' || p_size || '#' || username AS s FROM rec LEFT JOIN part ON asset = p_partkey),
    full_rep AS (SELECT *, CASE WHEN s IS NOT NULL THEN count(*) OVER (PARTITION BY s) ELSE 0 END AS same FROM full_rec),
    found AS (
        SELECT asset, username, present, 'long_time_no_login' AS risk FROM full_rep WHERE last_login IS NULL OR date_diff('day', last_login::DATE, DATE '2001-11-04') > 90
        UNION ALL SELECT asset, username, present, 'new_found' FROM full_rep WHERE remote_present AND NOT present
        UNION ALL SELECT asset, username, present, 'groups_changed' FROM full_rep WHERE present AND remote_present AND mg <> dg
        UNION ALL SELECT asset, username, present, 'sudoers_changed' FROM full_rep WHERE present AND remote_present AND ms <> ds
        UNION ALL SELECT asset, username, present, 'authorized_keys_changed' FROM full_rep WHERE present AND remote_present AND mk <> dk
        UNION ALL SELECT asset, username, present, 'account_deleted' FROM full_rep WHERE present AND NOT remote_present
        UNION ALL SELECT asset, username, present, 'password_expired' FROM full_rep WHERE date_diff('day', changed::DATE, DATE '2001-11-04') > 365
        UNION ALL SELECT asset, username, present, 'long_time_password' FROM full_rep WHERE date_diff('day', changed::DATE, DATE '2001-11-04') > 180
        UNION ALL SELECT asset, username, present, 'weak_password' FROM full_rep WHERE {WEAK_SQL}
        UNION ALL SELECT asset, username, present, 'leaked_password' FROM full_rep WHERE s IN (SELECT password FROM leak)
        UNION ALL SELECT asset, username, present, 'repeated_password' FROM full_rep WHERE same > 1)
"""


def findings(t):
    assets = t.part.select(F.col("p_partkey").alias("asset"), "p_name", "p_size")
    secret = a.account_secret(F.col("p_name"), F.col("p_size"), F.col("username"))
    return risks.findings(reconciled(t), secret, a.leak_list(t.lineitem, t.part), LINES_AS_OF, assets)


@query(
    "risk_counts",
    f"WITH {FINDINGS_SQL} SELECT risk, count(*) AS value FROM found GROUP BY 1",
)
def risk_counts(t):
    found = findings(t)
    return found.groupBy("risk").agg(F.count("*").alias("value"))


@query(
    "risk_per_asset",
    f"""WITH {FINDINGS_SQL}, c AS (SELECT asset, risk, count(*) AS n FROM found GROUP BY 1, 2)
        SELECT asset, sum(n)::BIGINT AS risk_total, string_agg(risk || '=' || n, ',' ORDER BY risk) AS risk_summary FROM c GROUP BY 1""",
)
def risk_per_asset(t):
    shown = F.array_join(
        F.array_sort(F.transform(F.map_entries("risk_summary"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ","
    )
    return risks.risk_per_asset(findings(t)).select("asset", "risk_total", shown.alias("risk_summary"))


@query("pending_risk_types", f"WITH {FINDINGS_SQL} SELECT DISTINCT risk FROM found WHERE NOT present")
def pending_risk_types(t):
    status = F.when(F.col("present"), risks.STATUS["confirmed"]).otherwise(risks.STATUS["pending"])
    return risks.pending_types(findings(t).withColumn("status", status))


RISK_ACTIONS_SQL = """(VALUES ('delete_remote', NULL, 'long_time_no_login'), ('delete_remote', NULL, 'new_found'), ('delete_both', NULL, 'long_time_no_login'),
    ('add_account', NULL, 'new_found'), ('change_password_add', FALSE, 'new_found'), ('change_password_add', FALSE, 'long_time_password'),
    ('change_password_add', FALSE, 'password_expired'), ('change_password', TRUE, 'long_time_password'), ('change_password', TRUE, 'weak_password'),
    ('change_password', TRUE, 'password_expired'), ('change_password', TRUE, 'leaked_password'), ('change_password', TRUE, 'repeated_password'),
    ('delete_account', TRUE, 'account_deleted'), ('review', NULL, 'group_changed'), ('review', NULL, 'sudo_changed'),
    ('review', NULL, 'authorized_key_changed'), ('review', NULL, 'account_deleted'), ('review', NULL, 'others')) v(action, must, risk)"""


@query(
    "risk_actions",
    f"""WITH {FINDINGS_SQL} SELECT asset, username, f.risk, action FROM found f JOIN {RISK_ACTIONS_SQL} ON f.risk = v.risk
        WHERE must IS NULL OR must = present""",
)
def risk_actions(t):
    found = findings(t).withColumnRenamed("present", "exists")
    return risks.allowed_actions(found).select("asset", "username", "risk", "action")


@query(
    "discovery_status",
    f"""WITH {RECONCILE_SQL} SELECT username, asset, CASE WHEN dg > 25 THEN '1' ELSE '0' END AS status FROM rec WHERE remote_present""",
)
def discovery_status(t):
    gathered = a.discovered_accounts(t.lineitem).withColumn("status", F.lit(risks.STATUS["pending"]))
    chosen = gathered.where(F.col("groups") > 25).select("username", "asset")
    return risks.set_status(gathered, chosen, ["username", "asset"], "confirmed").select("username", "asset", "status")


# On the fixtures the event type decides the kind of entry and the key of its properties the risk.
TIMELINE_RISKS = ["new_found", "long_time_no_login", "sudoers_changed", "weak_password", "repeat_password", "leak_password", "others"]

TIMELINE_SQL = """
    e AS (SELECT user_id AS finding, event_id, ts, user_id % 7 AS risk, json_extract_string(props, '$.k') AS k,
                 CASE WHEN event_type IN ('purchase', 'click') THEN 'process' WHEN event_type = 'view' THEN 'refind' ELSE 'init' END AS kind,
                 CASE WHEN event_type = 'purchase' THEN 'ignore' ELSE 'close' END AS action FROM events)
    SELECT finding, row_number() OVER (PARTITION BY finding ORDER BY ts, event_id) AS position,
           CASE WHEN kind = 'process' THEN action || CASE WHEN action = 'ignore' THEN ' (' || k || ')' ELSE '' END
                WHEN risk = 0 THEN 'New found' WHEN risk = 1 THEN 'Last login time: ' || strftime(ts, '%Y-%m-%d %H:%M:%S')
                WHEN risk = 2 THEN 'Diff: ' || k WHEN risk = 3 THEN 'Weak password' WHEN risk = 4 THEN 'Repeated password'
                WHEN risk = 5 THEN 'Leaked password' ELSE 'Other' END AS entry FROM e
"""


@query("risk_history", f"WITH {TIMELINE_SQL}")
def risk_history(t):
    kind = (
        F.when(F.col("event_type").isin("purchase", "click"), "process").when(F.col("event_type") == "view", "refind").otherwise("init")
    )
    action = F.when(F.col("event_type") == "purchase", "ignore").otherwise("close")
    names = F.array(*[F.lit(x) for x in TIMELINE_RISKS])
    key = a.props_key(F.col("props")).cast("string")
    entry = risks.timeline_text(
        F.get(names, (F.col("user_id") % 7).cast("int")), kind, action, F.when(action == "ignore", key), F.col("ts"), key
    )
    entries = t.events.select(F.col("user_id").alias("finding"), "event_id", "ts", entry.alias("entry"))
    return ranking.number_within(entries, "finding", "ts", "event_id", "position").select("finding", "position", "entry")


MASKING_RULES = [
    {"id": 1, "priority": 10, "fields_pattern": "user*", "masking_method": "hide_middle", "users": {"type": "attrs", "attrs": [{"name": "source", "match": "in", "value": ["BUILDING"]}]}},
    {"id": 2, "fields_pattern": "username,balance", "masking_method": "fixed_char", "mask_pattern": "####", "users": {"type": "attrs", "attrs": [{"name": "org", "match": "lte", "value": 9}]}},
    {"id": 3, "priority": 90, "fields_pattern": "source", "masking_method": "keep_prefix"},
]


@query(
    "mask_columns",
    """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN left(c_name, length(c_name) // 4) || repeat('*', length(c_name) - 2 * (length(c_name) // 4))
                                         || right(c_name, length(c_name) // 4) WHEN c_nationkey <= 9 THEN '####' ELSE c_name END AS username,
              CASE WHEN c_nationkey <= 9 THEN '####' ELSE c_acctbal::VARCHAR END AS balance,
              left(c_mktsegment, length(c_mktsegment) // 4) || repeat('*', length(c_mktsegment) - length(c_mktsegment) // 4) AS source FROM customer""",
)
def mask_columns(t):
    masked = masking.mask_columns(a.user(t.customer), MASKING_RULES, "id")
    return masked.select("id", "username", "balance", "source")


