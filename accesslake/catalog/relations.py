"""Queries over joins between entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.catalog.registry import ORDERS_AS_OF, query
from accesslake.functions.network import dotted_quad
from accesslake.operators import relations as r
from accesslake.operators import rule_tables
from accesslake.operators import rules, tree
from accesslake.sources import adapters as a


@query(
    "relation_display",
    """SELECT c_custkey AS id, c_name AS username, coalesce(n_name, '-') AS nation
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def relation_display(t):
    shown = r.attach(t.customer, t.nation, "c_nationkey", "n_nationkey", nation="n_name")
    return shown.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.coalesce("nation", F.lit("-")).alias("nation"))


@query(
    "relation_amounts",
    """SELECT o_orderkey AS id, count(DISTINCT l_partkey) AS assets_amount, count(DISTINCT l_suppkey) AS accounts_amount,
              count(DISTINCT l_returnflag) AS groups_amount
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def relation_amounts(t):
    members = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_partkey", "l_suppkey", "l_returnflag")
    amounts = {"assets_amount": "l_partkey", "accounts_amount": "l_suppkey", "groups_amount": "l_returnflag"}
    return r.relation_amounts(t.orders.select(F.col("o_orderkey").alias("id")), "id", [(members, amounts)])


# Permissions on the fixtures, once for every oracle that needs them.
PERM_SQL = """
    perm AS (SELECT n_nationkey AS permission, n_nationkey % 6 + 1 AS n_actions, 'r' || n_regionkey AS node FROM nation),
    live AS (SELECT n_nationkey AS permission, n_nationkey % 6 + 1 AS n_actions FROM nation WHERE n_nationkey % 4 <> 3
             AND TIMESTAMP '1995-01-01' + to_days(40 * n_nationkey::INT) <= TIMESTAMP '2001-08-01'
             AND TIMESTAMP '1999-01-01' + to_days(60 * n_nationkey::INT) > TIMESTAMP '2001-08-01'),
    perm_users AS (SELECT c_nationkey AS permission, c_custkey AS "user" FROM customer
                   UNION SELECT s_nationkey, s_suppkey FROM supplier),
    perm_assets AS (SELECT p_size - 1 AS permission, p_partkey AS asset FROM part WHERE p_size - 1 IN (SELECT n_nationkey FROM nation)
                    UNION SELECT perm.permission, p_partkey FROM perm JOIN nation ON node = 'r' || n_regionkey
                          JOIN part ON 'n' || (regexp_extract(p_brand, '(\\d+)$', 1)::INT - 1) = 'n' || n_nationkey),
    asked AS (SELECT DISTINCT o_custkey AS "user", l_partkey AS asset FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
"""


def permission_sides(t):
    """(permission, user) and (permission, asset) of the fixture permissions, factored and deduplicated."""
    users = r.permission_users(a.permission_users(t.nation, t.supplier), a.permission_groups(t.nation), a.group_members(t.customer))
    closure = tree.closure(a.organisation_nodes(t.region, t.nation))
    assets = r.permission_assets(
        a.permission_assets(t.nation, t.part), a.permission_nodes(t.nation), closure, a.asset_nodes(t.part)
    )
    return users, assets


@query(
    "effective_permissions",
    f"""WITH {PERM_SQL},
        hits AS (SELECT "user", asset, count(DISTINCT permission) AS permissions, max(n_actions) AS n
                 FROM asked JOIN perm_users USING ("user") JOIN perm_assets USING (permission, asset) JOIN live USING (permission)
                 GROUP BY ALL)
        SELECT "user", asset, coalesce(permissions, 0) AS permissions, permissions IS NOT NULL AS granted,
               CASE n WHEN 1 THEN 'connect' WHEN 2 THEN 'connect,upload' WHEN 3 THEN 'connect,upload,download'
                      WHEN 4 THEN 'connect,upload,download,copy' WHEN 5 THEN 'connect,upload,download,copy,paste'
                      WHEN 6 THEN 'connect,upload,download,copy,paste,share' ELSE '' END AS actions
        FROM asked LEFT JOIN hits USING ("user", asset)""",
)
def effective_permissions(t):
    """Every access that took place, with the permissions that cover it."""
    users, assets = permission_sides(t)
    asked = a.session(t.orders, t.lineitem).select(F.col("user_id").alias("user"), F.col("asset_id").alias("asset"))
    live = r.in_force(a.permissions(t.nation), ORDERS_AS_OF).select("permission", "actions")
    return r.resolve(asked, live, users, assets, a.ACTIONS).withColumn("actions", F.array_join("actions", ","))


@query(
    "effective_accounts",
    f"""WITH {PERM_SQL},
        acc AS (SELECT DISTINCT l_partkey AS asset, l_suppkey AS username FROM lineitem),
        hits AS (SELECT "user", asset, permission, n_actions FROM asked JOIN perm_users USING ("user")
                 JOIN perm_assets USING (permission, asset) JOIN live USING (permission)),
        chosen AS (SELECT "user", asset, username::VARCHAR AS account, n_actions FROM hits JOIN acc USING (asset)
                   WHERE CASE permission % 3 WHEN 0 THEN username = "user" WHEN 1 THEN username IN (1, 2, 3, 5, 8)
                              ELSE username NOT IN (1, 2, 3) END
                   UNION ALL SELECT "user", asset, '@INPUT', n_actions FROM hits WHERE permission % 3 = 0),
        best AS (SELECT "user", asset, account, max(n_actions) AS n FROM chosen GROUP BY ALL)
        SELECT "user"::VARCHAR AS "user", asset, account,
               CASE n WHEN 1 THEN 'connect' WHEN 2 THEN 'connect,upload' WHEN 3 THEN 'connect,upload,download'
                      WHEN 4 THEN 'connect,upload,download,copy' WHEN 5 THEN 'connect,upload,download,copy,paste'
                      ELSE 'connect,upload,download,copy,paste,share' END AS actions FROM best""",
)
def effective_accounts(t):
    """Every access that took place, with the accounts that the permissions in force give and their actions."""
    users, assets = permission_sides(t)
    asked = a.session(t.orders, t.lineitem).select(F.col("user_id").alias("user"), F.col("asset_id").alias("asset"))
    kind = F.col("permission") % 3
    names = lambda *x: F.array(*map(F.lit, x))
    selectors = F.when(kind == 0, names("@USER", "@INPUT")).when(kind == 1, names("@SPEC", "1", "2", "3", "5", "8")).otherwise(names("@NOT", "1", "2", "3"))
    live = r.in_force(a.permissions(t.nation), ORDERS_AS_OF).select("permission", "actions", selectors.alias("selectors"))
    accounts = t.lineitem.select(F.col("l_partkey").alias("asset"), F.col("l_suppkey").cast("string").alias("username"))
    found = r.granted_accounts(r.granted(asked, live, users, assets), live, accounts, a.ACTIONS)
    return found.withColumn("actions", F.array_join("actions", ","))


@query(
    "asset_permitted_users",
    f"""WITH {PERM_SQL} SELECT "user", permission::BIGINT AS permission FROM perm_users JOIN perm_assets USING (permission)
        WHERE asset = 1""",
)
def asset_permitted_users(t):
    """One asset's page: permitted users and the permissions that grant it."""
    users, assets = permission_sides(t)
    return r.permitted_users(1, users, assets).withColumn("permission", F.col("permission").cast("bigint"))


# On the fixtures the order's priority decides the account selector.
def _selectors(key):
    priority = F.col("o_orderpriority")
    return (
        F.when(priority == "1-URGENT", F.array(F.lit("@ALL")))
        .when(priority == "2-HIGH", F.array(F.lit("@SPEC"), F.lit("u1"), F.lit("u2"), key))
        .when(priority == "3-MEDIUM", F.array(F.lit("@NOT"), F.lit("u1"), F.lit("u2"), key))
        .when(priority == "4-NOT SPECIFIED", F.array(F.lit("@NONE")))
        .otherwise(F.array(F.lit("@USER"), F.lit("@INPUT"), F.lit("@ANON")))
    )


@query(
    "account_spec",
    """WITH acc AS (SELECT DISTINCT l_partkey AS asset, 'u' || l_suppkey AS username FROM lineitem),
            total AS (SELECT asset, count(*) AS n FROM acc GROUP BY 1),
            s AS (SELECT o_orderkey AS scope, 'u' || o_custkey AS "user", l_partkey AS asset, o_orderpriority AS p,
                         'u' || min(l_suppkey) AS named, 'u' || max(l_suppkey) AS username
                  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
            look AS (SELECT scope, asset, count(*) AS k FROM (SELECT scope, asset, unnest(list_distinct(['u1', 'u2', named])) AS username FROM s)
                     JOIN acc USING (asset, username) GROUP BY ALL),
            own AS (SELECT scope, asset, 1 AS k FROM s JOIN acc USING (asset) WHERE acc.username = "user")
       SELECT s.scope, s."user", s.asset, s.username,
              CASE p WHEN '1-URGENT' THEN TRUE WHEN '2-HIGH' THEN s.username IN ('u1', 'u2', named)
                     WHEN '3-MEDIUM' THEN s.username NOT IN ('u1', 'u2', named) WHEN '4-NOT SPECIFIED' THEN FALSE
                     ELSE s.username = s."user" END AS allowed,
              CASE p WHEN '1-URGENT' THEN total.n WHEN '2-HIGH' THEN coalesce(look.k, 0) WHEN '3-MEDIUM' THEN total.n - coalesce(look.k, 0)
                     WHEN '4-NOT SPECIFIED' THEN 0 ELSE coalesce(own.k, 0) + 2 END AS usable
       FROM s JOIN total USING (asset) LEFT JOIN look ON s.scope = look.scope AND s.asset = look.asset
              LEFT JOIN own ON s.scope = own.scope AND s.asset = own.asset""",
)
def account_spec(t):
    """Every access by scope, user and asset: was the account used allowed, and how many were usable?"""

    def named(column):
        return F.concat(F.lit("u"), column.cast("string"))

    accounts = t.lineitem.select(F.col("l_partkey").alias("asset"), named(F.col("l_suppkey")).alias("username"))
    accesses = (
        t.orders.join(t.lineitem, t.orders.o_orderkey == t.lineitem.l_orderkey)
        .groupBy(F.col("o_orderkey").alias("scope"), "o_custkey", "o_orderpriority", F.col("l_partkey").alias("asset"))
        .agg(F.min("l_suppkey").alias("_low"), F.max("l_suppkey").alias("_high"))
        .select(
            "scope",
            named(F.col("o_custkey")).alias("user"),
            "asset",
            _selectors(named(F.col("_low"))).alias("selectors"),
            named(F.col("_high")).alias("username"),
        )
    )
    counted = r.usable_accounts(accesses, accounts)
    return r.account_allowed(counted, accounts).select("scope", "user", "asset", "username", "allowed", "usable")


@query(
    "selected_accounts",
    """WITH acc AS (SELECT DISTINCT l_partkey AS asset, 'u' || l_suppkey AS username FROM lineitem),
            s AS (SELECT o_orderkey AS scope, 'u' || o_custkey AS "user", l_partkey AS asset, o_orderpriority AS p, 'u' || min(l_suppkey) AS named
                  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
       SELECT scope, "user", asset, username FROM s JOIN acc USING (asset)
       WHERE CASE p WHEN '1-URGENT' THEN TRUE WHEN '2-HIGH' THEN username IN ('u1', 'u2', named)
                    WHEN '3-MEDIUM' THEN username NOT IN ('u1', 'u2', named) WHEN '4-NOT SPECIFIED' THEN FALSE ELSE username = "user" END
       UNION ALL SELECT scope, "user", asset, unnest(['@INPUT', '@ANON']) FROM s WHERE p NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')""",
)
def selected_accounts(t):
    """The accounts each scope may use on its asset, as rows."""
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    accounts = t.lineitem.select(F.col("l_partkey").alias("asset"), name(F.col("l_suppkey")).alias("username"))
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").alias("scope"), "o_custkey", "o_orderpriority", F.col("l_partkey").alias("asset"))
    scopes = lines.agg(F.min("l_suppkey").alias("_low")).select("scope", name(F.col("o_custkey")).alias("user"), "asset", _selectors(name(F.col("_low"))).alias("selectors"))
    return r.selected_accounts(scopes, accounts)


@query(
    "account_exists",
    """WITH wanted AS (SELECT DISTINCT l_suppkey AS username, l_partkey + l_linenumber % 2 AS asset FROM lineitem WHERE l_quantity < 10),
            checked AS (SELECT username, asset, (username, asset) IN (SELECT (l_suppkey, l_partkey) FROM lineitem) AS exists FROM wanted)
       SELECT username, asset, exists, (SELECT bool_and(exists) FROM checked) AS all_exist FROM checked""",
)
def account_exists(t):
    """Accounts that small lines ask for, on the line's asset or the next one."""
    asset = F.col("l_partkey") + F.col("l_linenumber") % 2
    wanted = t.lineitem.where("l_quantity < 10").select(F.col("l_suppkey").alias("username"), asset.alias("asset")).distinct()
    known = t.lineitem.select(F.col("l_suppkey").alias("username"), F.col("l_partkey").alias("asset"))
    checked = r.account_exists(wanted, known, ["username", "asset"])
    return checked.withColumn("all_exist", r.all_exist(checked).scalar())


RECONCILE_SQL = """
    m AS (SELECT l_suppkey AS username, l_partkey AS asset, max(l_shipdate) AS last_login, min(l_shipdate) AS changed,
                 max(l_quantity) AS groups, max(l_discount) AS sudoers, max(l_tax) AS keys
          FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
    d AS (SELECT l_suppkey AS username, l_partkey AS asset, max(l_shipdate) AS last_login, min(l_shipdate) AS changed,
                 max(l_quantity) AS groups, max(l_discount) AS sudoers, max(l_tax) AS keys
          FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
    rec AS (SELECT username, asset, m.username IS NOT NULL AS present, d.username IS NOT NULL AS remote_present,
                   greatest(m.last_login, d.last_login) AS last_login, greatest(m.changed, d.changed) AS changed,
                   m.groups AS mg, d.groups AS dg, m.sudoers AS ms, d.sudoers AS ds, m.keys AS mk, d.keys AS dk
            FROM m FULL OUTER JOIN d USING (username, asset))
"""


def reconciled(t):
    lines = a.account_lines(t.lineitem)
    return r.reconcile(a.managed_snapshot(lines), a.discovered_snapshot(lines), ["username", "asset"])


@query("discovery_reconcile", f"WITH {RECONCILE_SQL} SELECT username, asset, present, remote_present FROM rec")
def discovery_reconcile(t):
    return reconciled(t).select("username", "asset", "present", "remote_present")


@query(
    "inventory_sync",
    """WITH cloud AS (SELECT l_partkey AS k, count(*) AS n, max(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
            local AS (SELECT l_partkey AS k, count(*) AS n, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
            j AS (SELECT CASE WHEN local.k IS NULL THEN 'new' WHEN cloud.k IS NULL THEN 'released' WHEN cloud.q = local.q THEN 'sync'
                              ELSE 'unsync' END AS class FROM cloud FULL OUTER JOIN local ON cloud.k = local.k)
       SELECT class, count(*) AS amount FROM j GROUP BY class""",
)
def inventory_sync(t):
    def snapshot(rows):
        return rows.groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_quantity").alias("size"))

    cloud = snapshot(t.lineitem.where(F.col("l_linestatus") == "O"))
    local = snapshot(t.lineitem.where(F.col("l_returnflag") == "N"))
    return r.sync_classify(cloud, local, "id", ["size"]).groupBy("class").agg(F.count("*").alias("amount"))


@query(
    "session_children",
    """SELECT o_orderkey AS session, count(l_orderkey) AS command_amount, count(*) FILTER (l_returnflag = 'R') AS file_amount,
              count(*) FILTER (l_linestatus = 'O') AS join_amount
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def session_children(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("session"), "l_returnflag", "l_linestatus")
    return r.session_children(
        t.orders.select(F.col("o_orderkey").alias("session")),
        "session",
        [
            (
                lines,
                {
                    "command_amount": F.lit(True),
                    "file_amount": F.col("l_returnflag") == "R",
                    "join_amount": F.col("l_linestatus") == "O",
                },
            )
        ],
    )


ACCESS_RULES = [
    {
        "id": 3,
        "priority": 20,
        "action": "review",
        "users": {"type": "attrs", "attrs": [{"name": "user_id", "match": "gte", "value": 100}]},
        "assets": {"type": "attrs", "attrs": [{"name": "resource", "match": "lte", "value": 40}]},
    },
    {"id": 2, "priority": 10, "action": "reject", "users": {"type": "ids", "ids": [1, 2, 3, 5, 8, 13]}},
    {"id": 1, "priority": 50, "action": "accept", "users": {"type": "all"}, "accounts": ["click", "view"]},
    {"id": 4, "priority": 20, "action": "warn", "users": {"type": "all"}, "accounts": ["error"]},
    {"id": 5, "priority": 1, "action": "reject", "users": {"type": "all"}, "is_active": False},
]

ACCESS_SQL = """CASE WHEN user_id IN (1, 2, 3, 5, 8, 13) THEN 2 WHEN user_id >= 100 AND resource <= 40 THEN 3
                     WHEN event_type = 'error' THEN 4 WHEN event_type IN ('click', 'view') THEN 1 END"""


def access_events(t):
    return t.events.select(
        F.col("event_id").alias("id"), "user_id", "event_type", a.props_key(F.col("props")).alias("resource")
    )


@query(
    "acl_evaluate",
    f"""WITH e AS (SELECT event_id AS id, user_id, event_type, json_extract_string(props, '$.k')::BIGINT AS resource FROM events),
             w AS (SELECT *, {ACCESS_SQL} AS rule FROM e)
        SELECT id, rule, CASE rule WHEN 1 THEN 'accept' WHEN 2 THEN 'reject' WHEN 3 THEN 'review' WHEN 4 THEN 'warn' END AS action
        FROM w""",
)
def acl_evaluate(t):
    result = rules.evaluate(access_events(t), ACCESS_RULES, "user_id", asset_key="resource", account="event_type")
    return result.select("id", "rule", "action")


LOGIN_RULES = [
    {
        "id": 1,
        "priority": 10,
        "users": {"type": "all"},
        "ip_group": ["10.0.0.0/28"],
        "time_period": [{"id": i, "value": "08:00~12:00、14:00~00:00"} for i in (1, 2, 3, 4, 5)],
    },
    {
        "id": 2,
        "priority": 20,
        "users": {"type": "attrs", "attrs": [{"name": "username", "match": "endswith", "value": "7"}]},
        "ip_group": ["10.0.0.0-10.0.0.99"],
        "action": "review",
        "reviewers": ["admin"],
    },
    {"id": 3, "users": {"type": "all"}, "time_period": [{"id": 0, "value": "00:00~06:00"}], "action": "accept"},
]


ACL_TABLE_SQL = """WITH rules AS (SELECT s_suppkey AS rule, CASE WHEN s_suppkey % 10 = 0 THEN 90 ELSE 1 + s_suppkey % 40 END AS priority,
                             CASE s_nationkey % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'review' ELSE 'accept' END AS action, s_nationkey % 3 AS kind FROM supplier),
            u AS (SELECT DISTINCT l_suppkey AS rule, o_custkey AS user_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey % 10 <> 0),
            m AS (SELECT event_id, priority, rule, action FROM events JOIN u USING (user_id) JOIN rules USING (rule)
                  WHERE kind = 2 OR (kind = 0 AND event_type = 'error') OR (kind = 1 AND event_type IN ('click', 'view'))
                  UNION ALL SELECT event_id, priority, rule, action FROM events, rules
                  WHERE rule NOT IN (SELECT rule FROM u) AND (kind = 2 OR (kind = 0 AND event_type = 'error') OR (kind = 1 AND event_type IN ('click', 'view')))),
            b AS (SELECT event_id, min({'p': priority, 'r': rule, 'a': action}) AS best FROM m GROUP BY 1)
       SELECT event_id AS id, best.r AS rule, best.p::INT AS priority, best.a AS action FROM events LEFT JOIN b USING (event_id)"""


def supplier_rules(t):
    """Rules as rows: one a supplier, for the users it sold to and, by its nation, for some event types."""
    kind = F.col("s_nationkey") % 3
    priority = F.when(F.col("s_suppkey") % 10 == 0, 90).otherwise((F.col("s_suppkey") % 40 + 1).cast("int"))
    action = F.when(kind == 0, "reject").when(kind == 1, "review").otherwise("accept")
    access_rules = t.supplier.select(F.col("s_suppkey").alias("rule"), priority.alias("priority"), action.alias("action"))
    sold = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).where("l_suppkey % 10 <> 0")
    types = F.when(kind == 0, F.array(F.lit("error"))).when(kind == 1, F.array(F.lit("click"), F.lit("view")))
    scopes = {
        "user_id": sold.select(F.col("l_suppkey").alias("rule"), F.col("o_custkey").alias("value")).distinct(),
        "event_type": t.supplier.select(F.col("s_suppkey").alias("rule"), F.explode(types).alias("value")),
    }
    return access_rules, scopes


@query("acl_evaluate_table", ACL_TABLE_SQL)
def acl_evaluate_table(t):
    events = t.events.select(F.col("event_id").alias("id"), "user_id", "event_type")
    return rule_tables.evaluate_table(events, "id", *supplier_rules(t)).select("id", "rule", "priority", "action")


@query(
    "match_ip_table",
    """SELECT p_partkey AS id, s_suppkey AS "group" FROM supplier JOIN part
       ON p_partkey BETWEEN s_suppkey * 16 AND s_suppkey * 16 + CASE WHEN s_suppkey % 2 = 0 THEN 15 ELSE 3 END""",
)
def match_ip_table(t):
    """Assets and the address groups they belong to, one network a supplier."""
    length = F.when(F.col("s_suppkey") % 2 == 0, "/28").otherwise("/30")
    groups = t.supplier.select(F.col("s_suppkey").alias("group"), F.concat(dotted_quad(F.col("s_suppkey") * 16), length).alias("network"))
    return rule_tables.match_networks(a.asset(t.part).select("id", "address"), "address", groups).select("id", "group")


@query(
    "login_acl",
    """WITH w AS (SELECT event_id AS id, CASE
              WHEN user_id BETWEEN 0 AND 15 AND dayofweek(ts) BETWEEN 1 AND 5 AND (hour(ts) BETWEEN 8 AND 11 OR hour(ts) >= 14) THEN 1
              WHEN user_id % 10 = 7 AND user_id <= 99 THEN 2 WHEN dayofweek(ts) = 0 AND hour(ts) < 6 THEN 3 END AS rule FROM events)
       SELECT id, rule, CASE rule WHEN 1 THEN 'reject' WHEN 2 THEN 'review' WHEN 3 THEN 'accept' END AS action FROM w""",
)
def login_acl(t):
    decided = rules.login_acl(a.login_log(t.events), LOGIN_RULES, "user_id", "remote_addr", "datetime")
    return decided.select("id", "rule", "action")


COMMAND_GROUPS = [
    {"id": 1, "type": "command", "content": "the\r\nthat", "ignore_case": True},
    {"id": 2, "type": "regex", "content": "th.*and|reboot", "ignore_case": False},
    {"id": 3, "type": "command", "content": "La", "ignore_case": False},
]


@query(
    "command_filter",
    r"""SELECT conv_id AS session, turn::BIGINT AS turn, 1 AS "group" FROM conversations
              WHERE regexp_matches(' ' || text || ' ', '(?i)[^0-9A-Za-z_](the|that)[^0-9A-Za-z_]')
        UNION ALL SELECT conv_id, turn, 2 FROM conversations WHERE regexp_matches(text, 'th.*and|reboot')
        UNION ALL SELECT conv_id, turn, 3 FROM conversations WHERE regexp_matches(' ' || text || ' ', '[^0-9A-Za-z_]La[^0-9A-Za-z_]')""",
)
def command_filter(t):
    hits = rules.match_commands(a.command_log(t.conversations), COMMAND_GROUPS)
    return hits.select("session", F.col("turn").cast("bigint").alias("turn"), "group")


STRATEGIES = [
    {
        "id": 2,
        "priority": 20,
        "rules": [{"name": "name", "match": "contains", "value": "red"}, {"name": "platform", "match": "in", "value": ["Brand#1", "Brand#2"]}],
        "rule_relation": "or",
        "actions": [{"attr": "platform", "value": "Linux"}, {"attr": "node", "value": "/red"}],
    },
    {
        "id": 1,
        "priority": 10,
        "rules": [{"name": "address", "match": "ip_in", "value": ["10.0.0.0/25"]}],
        "actions": [{"attr": "node", "value": "/edge"}],
    },
    {"id": 3, "rules": [], "actions": [{"attr": "zone", "value": "default"}]},
]


@query(
    "strategy_assign",
    """WITH s AS (SELECT p_partkey AS id, contains(p_name, 'red') OR p_brand IN ('Brand#1', 'Brand#2') AS red, p_partkey < 128 AS edge
                  FROM part)
       SELECT id, 'platform' AS attr, 'Linux' AS value, 2 AS strategy FROM s WHERE red
       UNION ALL SELECT id, 'node', CASE WHEN edge THEN '/edge' ELSE '/red' END, CASE WHEN edge THEN 1 ELSE 2 END FROM s WHERE edge OR red
       UNION ALL SELECT id, 'zone', 'default', 3 FROM s""",
)
def strategy_assign(t):
    instances = a.asset(t.part).select("id", "name", "platform", "address")
    return rules.assign(instances, STRATEGIES).select("id", "attr", "value", "strategy")


LEAK_SQL = """leak AS (SELECT DISTINCT p_name || '#' || p_size || '#' || l_suppkey AS password FROM lineitem JOIN part ON l_partkey = p_partkey
                       WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1996-01-01')"""


def accounts_with_secret(t):
    accounts = a.account(t.lineitem).join(t.part.select(F.col("p_partkey").alias("asset"), "p_name", "p_size"), "asset", "left")
    return accounts.withColumn("secret", a.account_secret(F.col("p_name"), F.col("p_size"), F.col("username")))


@query(
    "leaked_secret",
    f"""WITH {LEAK_SQL}, acc AS (SELECT DISTINCT l_suppkey AS username, l_partkey AS asset, p_name || '#' || p_size || '#' || l_suppkey AS secret
                                 FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
        SELECT username, asset FROM acc WHERE secret IN (SELECT password FROM leak)""",
)
def leaked_secret(t):
    return r.leaked(accounts_with_secret(t), a.leak_list(t.lineitem, t.part)).select("username", "asset")


@query(
    "group_members",
    "SELECT c_custkey AS id, c_nationkey = 3 AS member FROM customer",
)
def group_members(t):
    users, membership = a.user(t.customer), a.group_members(t.customer)
    inside = r.members_of(users, membership, 3).select("id", F.lit(True).alias("member"))
    return inside.union(r.not_members_of(users, membership, 3).select("id", F.lit(False).alias("member")))


@query(
    "node_assets",
    """WITH asset_node AS (SELECT p_partkey AS asset, regexp_extract(p_brand, '(\\d+)$', 1)::INT - 1 AS nation FROM part)
       SELECT 'r' || n_regionkey AS ancestor, asset FROM asset_node JOIN nation ON nation = n_nationkey
       UNION ALL SELECT 'n3', asset FROM asset_node WHERE nation = 3""",
)
def node_assets(t):
    closure = tree.closure(a.organisation_nodes(t.region, t.nation))
    wanted = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node")).union(
        t.nation.where(F.col("n_nationkey") == 3).select(F.concat(F.lit("n"), "n_nationkey"))
    )
    return r.assets_below(a.asset_nodes(t.part), closure, wanted)
