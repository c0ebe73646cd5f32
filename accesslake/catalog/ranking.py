"""Queries over rankings, sorts, pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.catalog.registry import EVENTS_AS_OF, ORDERS_AS_OF, query
from accesslake.catalog.relations import ACCESS_RULES, access_events
from accesslake.functions import calendar as cal
from accesslake.operators import metrics, rules, sets
from accesslake.operators import ranking as k
from accesslake.operators.risks import flag_duplicates
from accesslake.sources import adapters as a


@query(
    "top10_users",
    """SELECT user_id, count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, user_id) AS rank FROM events
       WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1 ORDER BY total DESC, user_id LIMIT 10""",
)
def top10_users(t):
    return k.top_k(cal.in_days(a.login_log(t.events), "datetime", EVENTS_AS_OF, 7), "user_id", F.count("*"))


@query(
    "top10_assets",
    """SELECT l_partkey AS asset, count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '2001-07-03' AND l_shipdate < TIMESTAMP '2001-08-02' GROUP BY 1 ORDER BY total DESC, asset LIMIT 10""",
)
def top10_assets(t):
    lines = cal.in_days(t.lineitem, "l_shipdate", ORDERS_AS_OF, 30).select(F.col("l_partkey").alias("asset"))
    return k.top_k(lines, "asset", F.count("*"))


@query(
    "top_asset_accounts",
    """SELECT l_partkey AS asset, count(DISTINCT l_suppkey) AS account_count,
              row_number() OVER (ORDER BY count(DISTINCT l_suppkey) DESC, l_partkey) AS rank
       FROM lineitem GROUP BY 1 ORDER BY account_count DESC, asset LIMIT 10""",
)
def top_asset_accounts(t):
    pairs = t.lineitem.select(F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("username"))
    return k.top_k(pairs, "asset", F.count_distinct("username"), name="account_count")


@query(
    "top_version_accounts",
    """SELECT o_custkey AS account, count(*) AS version, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rank
       FROM orders GROUP BY 1 ORDER BY version DESC, account LIMIT 10""",
)
def top_version_accounts(t):
    """The newest version of an account is the number of its secrets, so no row has to be numbered."""
    return k.top_k(t.orders.select(F.col("o_custkey").alias("account")), "account", F.count("*"), name="version")


@query(
    "top10_changed",
    """WITH c AS (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS op FROM events WHERE event_type = 'signup'),
            x AS (SELECT 'target' AS side, user_id AS who, count(*) AS total FROM c GROUP BY 2
                  UNION ALL SELECT 'operator', op, count(*) FROM c GROUP BY 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY total DESC, who) AS rank FROM x)
       SELECT * FROM r WHERE rank <= 10""",
)
def top10_changed(t):
    changes = a.password_change_log(t.events)
    sides = [
        k.top_k(changes, column, F.count("*")).select(F.lit(side).alias("side"), F.col(column).alias("who"), "total", "rank")
        for side, column in (("target", "user"), ("operator", "change_by"))
    ]
    return sides[0].union(sides[1])


@query(
    "recent_activity",
    """SELECT user_id, event_id, event_type, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position
       FROM events) WHERE position <= 30""",
)
def recent_activity(t):
    recent = k.recent_per_group(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id", 30)
    return recent.select("user_id", "event_id", "event_type", F.col("position").cast("bigint").alias("position"))


@query(
    "latest_version",
    """WITH v AS (SELECT o_custkey AS account, o_orderkey AS secret, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
                         count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
       SELECT account, secret, version, version = n AS is_latest FROM v""",
)
def latest_version(t):
    history = t.orders.select(
        F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("secret"), F.col("o_orderdate").alias("history_date")
    )
    numbered = k.number_within(history, "account", "history_date", "secret", bucket="DAY", tie_width=1 << 26, total="versions")
    return numbered.select("account", "secret", "version", (F.col("version") == F.col("versions")).alias("is_latest"))


@query(
    "first_match",
    """WITH e AS (SELECT event_id AS id, user_id, event_type, json_extract_string(props, '$.k')::BIGINT AS resource FROM events),
            h AS (SELECT id, 2 AS rule, 10 AS priority FROM e WHERE user_id IN (1, 2, 3, 5, 8, 13)
                  UNION ALL SELECT id, 3, 20 FROM e WHERE user_id >= 100 AND resource <= 40
                  UNION ALL SELECT id, 4, 20 FROM e WHERE event_type = 'error'
                  UNION ALL SELECT id, 1, 50 FROM e WHERE event_type IN ('click', 'view'))
       SELECT id, arg_min(rule, priority * 100 + rule) AS rule, min(priority) AS priority, count(*) AS matching FROM h GROUP BY id""",
)
def first_match(t):
    """The rule of least (priority, id) among all that match, from the list of matches."""
    hits = rules.all_matches(access_events(t), ACCESS_RULES, "user_id", asset_key="resource", account="event_type")
    first = hits.groupBy("id").agg(F.min(F.struct("priority", "rule")).alias("_f"), F.count("*").alias("matching"))
    return first.select("id", "_f.rule", "_f.priority", "matching")


@query(
    "sort_toggle",
    "SELECT *, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier ORDER BY place LIMIT 15",
)
def sort_toggle(t):
    order = k.sort_parameter("s_acctbal", "descending")
    shown = k.page(t.supplier, 1, order=order, tie="s_suppkey")
    from pyspark.sql import Window

    return shown.withColumn("place", F.row_number().over(Window.orderBy(*k.order_terms(order, "s_suppkey"))).cast("bigint"))


@query("order_desc_key", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50")
def order_desc_key(t):
    return k.page(t.events, 1, 50, "-ts", "event_id").select("event_id", "event_type")


@query(
    "page",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM
       (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 30)""",
)
def page(t):
    rows = t.orders.where(F.col("o_orderstatus") == "F")
    shown = k.page(rows, 3, 15, "-o_totalprice", "o_orderkey")
    return shown.select("o_orderkey", "o_totalprice").withColumn("total", rows.select(F.count("*")).scalar())


@query(
    "page_deep",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 885",
)
def page_deep(t):
    return k.page_at(t.orders, 60, 15, "-o_totalprice", "o_orderkey", parts=100).select("o_orderkey", "o_totalprice")


@query(
    "page_keyset",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1998-03-01' OR (o_orderdate = TIMESTAMP '1998-03-01' AND o_orderkey > 700)
       ORDER BY o_orderdate, o_orderkey LIMIT 30""",
)
def page_keyset(t):
    last = F.lit("1998-03-01").cast(t.orders.schema["o_orderdate"].dataType)
    return k.page_after(t.orders, "o_orderkey", 700, 30, "o_orderdate", last).select("o_orderkey", "o_orderdate")


@query(
    "count_probe",
    """SELECT count(*) AS all_rows, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent,
              count(*) FILTER (o_totalprice > 300000) AS large FROM orders""",
)
def count_probe(t):
    badges = {
        "all_rows": F.lit(True),
        "finished": F.col("o_orderstatus") == "F",
        "urgent": F.col("o_orderpriority") == "1-URGENT",
        "large": F.col("o_totalprice") > 300000,
    }
    return metrics.counters(t.orders, badges)


@query(
    "transfer_difference",
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)",
)
def transfer_difference(t):
    chosen = t.lineitem.where(F.col("l_quantity") >= 48).select(F.col("l_partkey").alias("p_partkey"))
    return sets.minus(t.part.select("p_partkey"), chosen, "p_partkey")


@query(
    "unique_by",
    """SELECT p_type, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1""",
)
def unique_by(t):
    return sets.unique_by(t.part.select("p_type", "p_partkey", "p_name", "p_brand"), "p_type", "p_partkey")


def _catalogs(t):
    """Two catalogues of (path, value): parts by type and key, and the ones that were ever ordered open."""
    path = F.concat_ws(".", "p_type", F.col("p_partkey").cast("string"))
    base = t.part.select(path.alias("path"), F.when(F.col("p_size") > 5, F.col("p_name")).alias("value"))
    ordered = t.lineitem.where((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)).select(
        F.col("l_partkey").alias("p_partkey")
    )
    target = t.part.join(ordered.distinct(), "p_partkey", "left_semi").select(path.alias("path"), F.col("p_brand").alias("value"))
    return base, target


CATALOG_SQL = """base AS (SELECT p_type || '.' || p_partkey AS path, CASE WHEN p_size > 5 THEN p_name END AS value FROM part),
       target AS (SELECT p_type || '.' || p_partkey AS path, p_brand AS value FROM part
                  WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45))"""


@query(
    "catalog_missing_keys",
    f"WITH {CATALOG_SQL} SELECT * FROM base WHERE value IS NOT NULL AND path NOT IN (SELECT path FROM target)",
)
def catalog_missing_keys(t):
    return sets.missing_paths(*_catalogs(t))


@query(
    "catalog_apply",
    f"""WITH {CATALOG_SQL}, patch AS (SELECT path, upper(value) AS value FROM base WHERE value LIKE 'red%')
        SELECT coalesce(t.path, p.path) AS path, coalesce(p.value, t.value) AS value FROM target t FULL OUTER JOIN patch p USING (path)""",
)
def catalog_apply(t):
    base, target = _catalogs(t)
    changed = base.where(F.col("value").startswith("red")).select("path", F.upper("value").alias("value"))
    return sets.apply_paths(target, changed)


@query(
    "selected_across_pages",
    """WITH sel AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'),
            p1 AS (SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 15),
            p2 AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 15)
       SELECT 'add' AS step, id FROM (SELECT id FROM sel UNION SELECT id FROM p1)
       UNION ALL SELECT 'remove', id FROM sel WHERE id NOT IN (SELECT id FROM p2)""",
)
def selected_across_pages(t):
    ids = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    pending = ids.where(F.col("o_orderstatus") == "P").select("id")
    mixed = sets.toggle_page(pending, k.page(ids, 1), "id")
    whole = sets.toggle_page(pending, k.page(pending, 1), "id")
    return mixed.select(F.lit("add").alias("step"), "id").union(whole.select(F.lit("remove").alias("step"), "id"))


@query(
    "relation_delta",
    """WITH b AS (SELECT c_nationkey AS g, c_custkey AS u FROM customer),
            a AS (SELECT c_nationkey AS g, c_custkey AS u FROM customer WHERE c_acctbal >= 0 UNION SELECT s_nationkey, s_suppkey + 10000000000 FROM supplier)
       SELECT u AS "user", 'add' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
       UNION ALL SELECT u, 'remove' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def relation_delta(t):
    old = a.group_members(a.user_snapshot_before(t.customer))
    new = a.group_members(a.user_snapshot_after(t.customer, t.supplier))
    return sets.member_delta(old, new, ["group", "user"]).select("user", "change")


@query(
    "intersect_methods",
    "SELECT p_name AS method FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' INTERSECT SELECT p_name FROM part WHERE p_type = 'PROMO'",
)
def intersect_methods(t):
    used = t.part.join(t.lineitem.where(F.col("l_returnflag") == "R"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    offered = t.part.where(F.col("p_type") == "PROMO")
    return sets.common_values(used.select(F.col("p_name").alias("method")), offered.select(F.col("p_name").alias("method")))


@query("flag_duplicates", "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) > 1 AS is_same FROM part")
def flagged(t):
    return flag_duplicates(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey")


