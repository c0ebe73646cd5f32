"""Queries over counters, series, distributions and cross tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.catalog import choices
from accesslake.catalog.registry import EVENT_TYPES, EVENTS_AS_OF, LINES_AS_OF, ORDERS_AS_OF, PART_TYPES, query
from accesslake.catalog.relations import RECONCILE_SQL, reconciled
from accesslake.functions import calendar as cal
from accesslake.operators import metrics as m
from accesslake.plans import reports
from accesslake.sources import adapters as a

# The calendar of the last ``days`` days ending on a date, for oracles.
def days_sql(as_of: str, days: int) -> str:
    return (
        f"cal AS (SELECT d::DATE AS date FROM range(DATE '{as_of}' - INTERVAL {days - 1} DAY, "
        f"DATE '{as_of}' + INTERVAL 1 DAY, INTERVAL 1 DAY) r(d))"
    )


def dated(df, name="date"):
    return df.withColumn(name, F.col(name).cast("string"))


@query(
    "named_counters",
    """SELECT count(*) AS logins, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed,
              count(*) FILTER (event_type = 'signup') AS password_changes, count(*) FILTER (value > 100) AS long_ones FROM events""",
)
def named_counters(t):
    kind = F.col("event_type")
    return m.counters(
        t.events,
        {
            "logins": F.lit(True),
            "success": kind != "error",
            "failed": kind == "error",
            "password_changes": kind == "signup",
            "long_ones": F.col("value") > 100,
        },
    )


@query(
    "daily_series",
    f"""WITH {days_sql(EVENTS_AS_OF, 30)}, n AS (SELECT ts::DATE AS date, count(*) AS total FROM events GROUP BY 1)
        SELECT date::VARCHAR AS date, coalesce(total, 0) AS total FROM cal LEFT JOIN n USING (date)""",
)
def daily_series(t):
    return dated(m.daily(t.events, "ts", EVENTS_AS_OF, 30, {"total": F.count("*")}))


@query(
    "daily_success_failure",
    f"""WITH {days_sql(EVENTS_AS_OF, 30)},
             n AS (SELECT ts::DATE AS date, count(*) FILTER (event_type <> 'error') AS success,
                          count(*) FILTER (event_type = 'error') AS failure FROM events GROUP BY 1)
        SELECT date::VARCHAR AS date, coalesce(success, 0) AS success, coalesce(failure, 0) AS failure FROM cal LEFT JOIN n USING (date)""",
)
def daily_success_failure(t):
    logins = a.login_log(t.events)
    measures = {"success": F.count_if("status"), "failure": F.count_if(~F.col("status"))}
    return dated(m.daily(logins, "datetime", EVENTS_AS_OF, 30, measures))


@query(
    "daily_by_method",
    f"""WITH {days_sql(EVENTS_AS_OF, 30)}, n AS (SELECT ts::DATE AS date, event_type AS series, count(*) AS value FROM events GROUP BY 1, 2),
             s AS (SELECT DISTINCT series FROM n JOIN cal USING (date))
        SELECT date::VARCHAR AS date, series, coalesce(value, 0) AS value FROM cal CROSS JOIN s LEFT JOIN n USING (date, series)""",
)
def daily_by_method(t):
    return dated(m.daily_by(a.login_log(t.events), "datetime", "method", EVENTS_AS_OF, 30))


@query(
    "daypart_buckets",
    """SELECT daypart, count(event_id) AS value FROM (VALUES (0, '00:00-06:00'), (1, '06:00-12:00'), (2, '12:00-18:00'), (3, '18:00-24:00')) p(i, daypart)
       LEFT JOIN events ON hour(ts) // 6 = i GROUP BY daypart""",
)
def daypart_buckets(t):
    return m.dayparts(t.events, "ts")


@query("distribution", "SELECT c_mktsegment AS name, count(*) AS value FROM customer GROUP BY 1")
def distribution(t):
    return m.distribution(t.customer, "c_mktsegment")


@query(
    "distribution_or_nothing",
    """SELECT 'full' AS input, c_mktsegment AS name, count(*) AS value FROM customer GROUP BY ALL
       UNION ALL SELECT 'empty', 'Nothing', 0""",
)
def distribution_or_nothing(t):
    full = m.distribution_or_nothing(t.customer, "c_mktsegment").select(F.lit("full").alias("input"), "name", "value")
    nobody = t.customer.where(F.col("c_mktsegment") == "NOBODY")
    empty = m.distribution_or_nothing(nobody, "c_mktsegment").select(F.lit("empty").alias("input"), "name", "value")
    return full.union(empty)


@query(
    "share_floor",
    """SELECT p_brand AS name, count(*) AS value, (count(*) * 10000 // (SELECT count(*) FROM part)) / 100.0 AS share FROM part GROUP BY 1""",
)
def share_floor(t):
    return m.share_floor(t.part, "p_brand")


@query(
    "ratio_2dp",
    """SELECT event_type AS method, round(count(*) FILTER (value > 50) * 100.0::DOUBLE / count(*), 2) AS long_pct,
              round(100.0::DOUBLE - round(count(*) FILTER (value > 50) * 100.0::DOUBLE / count(*), 2), 2) AS short_pct,
              0.0::DOUBLE AS none_pct FROM events GROUP BY 1""",
)
def ratio_2dp(t):
    counted = t.events.groupBy(F.col("event_type").alias("method")).agg(
        F.count_if(F.col("value") > 50).alias("long"), F.count("*").alias("n"), F.count_if(F.col("value") < 0).alias("zero")
    )
    return counted.select(
        "method",
        *m.ratio_pair(F.col("long"), F.col("n"), "long_pct", "short_pct"),
        m.ratio(F.col("zero"), F.col("zero")).alias("none_pct"),
    )


@query(
    "ratio_console",
    """WITH u AS (SELECT count(DISTINCT o_custkey) AS active, (SELECT count(*) FROM customer) AS total FROM orders
                  WHERE o_orderdate >= TIMESTAMP '2001-07-03'),
            s AS (SELECT count(DISTINCT l_partkey) AS active, (SELECT count(*) FROM part) AS total FROM lineitem
                  WHERE l_shipdate >= TIMESTAMP '2001-07-03' AND l_shipdate < TIMESTAMP '2001-08-02'),
            b AS (SELECT 'users' AS name, * FROM u UNION ALL SELECT 'assets', * FROM s)
       SELECT name, active, total, round(active * 100.0::DOUBLE / total, 2) AS percent,
              round(100.0::DOUBLE - round(active * 100.0::DOUBLE / total, 2), 2) AS rest FROM b""",
)
def ratio_console(t):
    def ring(name, used, key, whole):
        counted = used.agg(F.count_distinct(key).alias("active")).withColumn("total", whole.select(F.count("*")).scalar())
        return counted.select(
            F.lit(name).alias("name"), "active", "total", *m.ratio_pair(F.col("active"), F.col("total"), "percent", "rest")
        )

    users = ring("users", cal.in_days(t.orders, "o_orderdate", ORDERS_AS_OF, 30), "o_custkey", t.customer)
    assets = ring("assets", cal.in_days(t.lineitem, "l_shipdate", ORDERS_AS_OF, 30), "l_partkey", t.part)
    return users.union(assets)


@query(
    "crosstab",
    """SELECT platform, category, count(p_partkey) AS value
       FROM (SELECT DISTINCT p_brand AS platform FROM part) CROSS JOIN (SELECT DISTINCT p_type AS category FROM part)
       LEFT JOIN part ON p_brand = platform AND p_type = category GROUP BY 1, 2""",
)
def crosstab(t):
    return m.crosstab(a.asset(t.part), "platform", "category")


@query(
    "active_per_day",
    f"""WITH {days_sql(ORDERS_AS_OF, 30)},
             n AS (SELECT o_orderdate::DATE AS date, count(DISTINCT o_custkey) AS users, count(DISTINCT l_partkey) AS assets
                   FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
        SELECT date::VARCHAR AS date, coalesce(users, 0) AS users, coalesce(assets, 0) AS assets FROM cal LEFT JOIN n USING (date)""",
)
def active_per_day(t):
    return dated(m.active_per_day(a.session(t.orders, t.lineitem), "date_start", "user_id", "asset_id", ORDERS_AS_OF, 30))


@query(
    "session_stats",
    """SELECT count(*) AS sessions, count(DISTINCT l_partkey) AS assets, count(DISTINCT o_custkey) AS users
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def session_stats(t):
    return m.total_and_distinct(a.session(t.orders, t.lineitem), "sessions", assets="asset_id", users="user_id")


USER_STATS_SQL = """SELECT unnest(['total', 'not_enabled_mfa', 'first_login', 'valid', 'need_update_password']) AS metric,
       unnest([count(*), count(*) FILTER (c_acctbal <= 0), count(*) FILTER (c_acctbal BETWEEN 0 AND 100),
               count(*) FILTER (c_acctbal >= 0), count(*) FILTER (c_acctbal > 9000)]) AS value FROM customer"""


@query("user_stats", USER_STATS_SQL)
def user_stats(t):
    return reports.user_stats(a.user(t.customer), choices.user_measures())


ASSET_STATS_SQL = """SELECT unnest(['total', 'active', 'connected', 'zone', 'directory_services', 'platform_count']) AS metric,
       unnest([count(*), count(*) FILTER (p_retailprice < 1500), count(*) FILTER (p_retailprice < 1200), count(DISTINCT p_type),
               count(*) FILTER (p_type = 'PROMO'), count(DISTINCT p_brand)]) AS value FROM part"""


@query("asset_stats", ASSET_STATS_SQL)
def asset_stats(t):
    return reports.overview(a.asset(t.part), choices.asset_measures())


ACCOUNT_SQL = """acc AS (SELECT l_suppkey AS username, l_partkey AS asset, max(l_shipdate) AS last_login, min(l_shipdate) AS created,
                                count(*) AS logins FROM lineitem GROUP BY 1, 2)"""
ACCOUNT_STATS_SQL = """SELECT unnest(['total', 'active', 'connected', 'su_from', 'date_change_secret', 'template_total']) AS metric,
       unnest([count(*), count(*) FILTER (logins > 1), count(*) FILTER (date_diff('day', last_login::DATE, DATE '2001-11-04') BETWEEN 0 AND 364),
               count(*) FILTER (username % 5 = 0), count(*) FILTER (date_diff('day', last_login::DATE, DATE '2001-11-04') BETWEEN 0 AND 29),
               count(DISTINCT username)]) AS value FROM acc"""


@query("account_stats", f"WITH {ACCOUNT_SQL} {ACCOUNT_STATS_SQL}")
def account_stats(t):
    return reports.overview(a.account(t.lineitem), choices.account_measures(LINES_AS_OF, 30))


@query(
    "week_added",
    """SELECT 'orders' AS name, count(*) AS total, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-07-30') AS week_added FROM orders
       UNION ALL SELECT 'lines', count(*), count(*) FILTER (l_shipdate >= TIMESTAMP '2001-07-30' AND l_shipdate < TIMESTAMP '2001-08-02')
       FROM lineitem""",
)
def week_added(t):
    orders = m.week_added(t.orders, "o_orderdate", ORDERS_AS_OF).select(F.lit("orders").alias("name"), "total", "week_added")
    lines = m.week_added(t.lineitem, "l_shipdate", ORDERS_AS_OF).select(F.lit("lines").alias("name"), "total", "week_added")
    return orders.union(lines)


PRIVILEGE_SQL = """SELECT count(*) FILTER (present AND username % 5 = 0) AS privileged, count(*) FILTER (present AND username % 5 <> 0) AS ordinary,
       count(*) FILTER (NOT present) AS unmanaged, count(*) FILTER (NOT remote_present) AS unavailable FROM rec"""


@query("privilege_counts", f"WITH {RECONCILE_SQL} {PRIVILEGE_SQL}")
def privilege_counts(t):
    return reports.privilege_counts(reconciled(t), choices.privileged())


# Automation kinds, each with the event type that stands for it on the fixtures.
AUTOMATIONS = {
    "change_secret": "signup",
    "gather": "view",
    "push": "click",
    "backup": "purchase",
    "integration": "missing",
}


@query(
    "automation_counts",
    """SELECT k AS kind, count(event_id) AS value FROM (VALUES ('change_secret', 'signup'), ('gather', 'view'), ('push', 'click'),
       ('backup', 'purchase'), ('integration', 'missing')) v(k, e) LEFT JOIN events ON event_type = e GROUP BY k""",
)
def automation_counts(t):
    jobs = a.job_log(t.events)
    return m.metric_rows(m.counters(jobs, {k: F.col("task") == e for k, e in AUTOMATIONS.items()}), metric="kind")


@query(
    "execution_metrics",
    f"""WITH {days_sql(EVENTS_AS_OF, 7)},
             n AS (SELECT ts::DATE AS date, count(*) FILTER (event_type = 'signup') AS change_secret, count(*) FILTER (event_type = 'view') AS gather,
                          count(*) FILTER (event_type = 'click') AS push, count(*) FILTER (event_type = 'purchase') AS backup FROM events GROUP BY 1)
        SELECT date::VARCHAR AS date, coalesce(change_secret, 0) AS change_secret, coalesce(gather, 0) AS gather, coalesce(push, 0) AS push,
               coalesce(backup, 0) AS backup, 0::BIGINT AS integration FROM cal LEFT JOIN n USING (date)""",
)
def execution_metrics(t):
    measures = {k: F.count_if(F.col("task") == e) for k, e in AUTOMATIONS.items()}
    return dated(m.daily(a.job_log(t.events), "date_start", EVENTS_AS_OF, 7, measures))


def secret_runs(t):
    state = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "failed").otherwise("ongoing")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("task"),
        (F.col("o_custkey") % 2 == 0).alias("periodic"),
        F.floor(F.col("o_totalprice") / 1000).alias("asset"),
        state.alias("state"),
        F.col("o_orderdate").alias("date_start"),
    )


@query(
    "change_secret_summary",
    """SELECT count(DISTINCT o_custkey) AS tasks, count(DISTINCT CASE WHEN o_custkey % 2 = 0 THEN o_custkey END) AS periodic,
              count(DISTINCT floor(o_totalprice / 1000)) AS assets, count(*) AS executions, count(*) FILTER (o_orderstatus = 'F') AS success,
              count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS ongoing FROM orders""",
)
def change_secret_summary(t):
    return reports.change_secret_summary(secret_runs(t))


@query(
    "label_values",
    """SELECT 'brand' AS name, p_brand AS value FROM part UNION SELECT 'type', p_type FROM part UNION SELECT 'size', p_size::VARCHAR FROM part""",
)
def label_values(t):
    return m.label_values(a.label_bridge(t.part))


@query(
    "label_resource_count",
    """WITH b AS (SELECT 'brand' AS name, p_brand AS value FROM part UNION ALL SELECT 'type', p_type FROM part
                  UNION ALL SELECT 'size', p_size::VARCHAR FROM part),
            l AS (SELECT DISTINCT name, value FROM b UNION SELECT 'segment', c_mktsegment FROM customer)
       SELECT l.name, l.value, count(b.name) AS res_count FROM l LEFT JOIN b ON l.name = b.name AND l.value = b.value GROUP BY ALL""",
)
def label_resource_count(t):
    bridge = a.label_bridge(t.part)
    labels = bridge.select("name", "value").union(t.customer.select(F.lit("segment"), "c_mktsegment")).distinct()
    return m.label_resource_count(labels, bridge)


HITS_SQL = """hits AS (SELECT 'user' AS model, c_custkey::VARCHAR AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '00001')
                       UNION ALL SELECT 'account', s_suppkey::VARCHAR, s_name FROM supplier WHERE contains(lower(s_name), '00001')
                       UNION ALL SELECT 'asset', p_partkey::VARCHAR, p_partkey || ' ' || p_name FROM part WHERE contains(p_partkey || ' ' || p_name, '00001'))"""


def hits(t):
    assets = t.part.withColumn("shown", F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name"))
    kinds = {
        "user": (t.customer, "c_custkey", "c_name"),
        "account": (t.supplier, "s_suppkey", "s_name"),
        "asset": (assets, "p_partkey", "shown"),
    }
    return m.tagged_union(kinds, "00001")


@query("tagged_union", f"WITH {HITS_SQL} SELECT * FROM hits")
def tagged_union(t):
    return hits(t)


@query("group_hits_by_model", f"WITH {HITS_SQL} SELECT *, count(*) OVER (PARTITION BY model) AS group_size FROM hits")
def group_hits_by_model(t):
    return m.group_hits(hits(t), "model", F.col("id"))


@query(
    "org_group",
    """SELECT n_name AS org, c_custkey AS id, c_name AS name, count(*) OVER (PARTITION BY n_name) AS group_size
       FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name), '1')""",
)
def org_group(t):
    found = t.customer.where(F.contains(F.lower("c_name"), F.lit("1"))).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    named = found.select(F.col("n_name").alias("org"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return m.group_hits(named, "org", F.col("id"))


@query(
    "import_summary",
    """WITH s AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 400000 THEN 'error' ELSE 'ok' END AS status FROM orders)
       SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS failed,
              count(*) FILTER (status = 'pending') AS pending,
              round(100.0 * count(*) FILTER (status <> 'pending') / count(*))::BIGINT AS processed_percent FROM s""",
)
def import_summary(t):
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_totalprice") > 400000, "error").otherwise("ok")
    return m.import_summary(t.orders.select(status.alias("status")))


@query(
    "job_summary",
    """WITH r AS (SELECT user_id AS execution, json_extract_string(props, '$.k')::BIGINT AS host,
                         CASE WHEN event_type = 'error' THEN 'failures' WHEN event_type = 'view' THEN 'excludes'
                              WHEN value > 150 THEN 'dark' ELSE 'ok' END AS outcome FROM events)
       SELECT execution, count(DISTINCT CASE WHEN outcome = 'ok' THEN host END) AS ok,
              count(DISTINCT CASE WHEN outcome = 'excludes' THEN host END) AS excludes,
              count(DISTINCT CASE WHEN outcome IN ('failures', 'dark') THEN host END) AS failed FROM r GROUP BY 1""",
)
def job_summary(t):
    jobs = a.job_log(t.events)
    outcome = (
        F.when(~F.col("is_success"), "failures").when(~F.col("is_finished"), "excludes").when(F.col("time_cost") > 150, "dark").otherwise("ok")
    )
    return m.job_summary(jobs.withColumn("outcome", outcome), "execution", "host", "outcome")


@query(
    "task_success_ratio",
    "SELECT event_type AS task, count(*) FILTER (value < 100) AS success, count(*) AS total FROM events GROUP BY 1",
)
def task_success_ratio(t):
    return m.task_ratio(a.job_log(t.events), "task", F.col("time_cost") < 100)


LOAD_SQL = ", ".join(
    f"count(*) FILTER (s = '{s}') AS {s}, round(count(*) FILTER (s = '{s}') * 100.0::DOUBLE / count(*), 2) AS {s}_pct"
    for s in m.LOAD_STATES
)


@query(
    "component_load",
    f"""WITH b AS (SELECT event_type AS kind, CASE WHEN value < 50 THEN 'normal' WHEN value < 120 THEN 'high' WHEN value < 250 THEN 'critical'
                          ELSE 'offline' END AS s FROM events) SELECT kind, count(*) AS total, {LOAD_SQL} FROM b GROUP BY kind""",
)
def component_load(t):
    value = F.col("value")
    state = F.when(value < 50, "normal").when(value < 120, "high").when(value < 250, "critical").otherwise("offline")
    return m.component_load(t.events.withColumnRenamed("event_type", "kind"), "kind", state)


CARDS = {"core": ["src0", "src1", "src2"], "web": ["src2", "src3"], "terminal": [f"src{i}" for i in range(4, 15)], "idle": ["none"]}


@query(
    "component_log_cards",
    """WITH c AS (SELECT unnest(['core', 'core', 'core', 'web', 'web', 'idle']) AS card, unnest(['src0', 'src1', 'src2', 'src2', 'src3', 'none']) AS source
                  UNION ALL SELECT 'terminal', 'src' || i FROM range(4, 15) r(i)),
            j AS (SELECT card, doc_id AS line_id, d.source AS component, md5(text) AS message FROM c LEFT JOIN documents d ON c.source = d.source)
       SELECT card, line_id, component, message, count(line_id) OVER (PARTITION BY card) AS log_count FROM j
       WHERE line_id IS NOT NULL OR card = 'idle'""",
)
def component_log_cards(t):
    cards = m.log_cards(a.component_log(t.documents), CARDS)
    return cards.select("card", "line_id", "component", F.md5("message").alias("message"), "log_count")


@query(
    "password_change_totals",
    """SELECT count(*) AS total, count(DISTINCT user_id) AS targets, count(DISTINCT json_extract_string(props, '$.k')) AS operators
       FROM events WHERE event_type = 'signup'""",
)
def password_change_totals(t):
    return m.total_and_distinct(a.password_change_log(t.events), "total", targets="user", operators="change_by")


@query(
    "bulk_result_counts",
    """WITH r AS (SELECT CASE WHEN o_totalprice > 400000 THEN 'error' WHEN o_orderstatus = 'F' THEN 'created' WHEN o_orderstatus = 'O' THEN 'updated' END AS k
                  FROM orders)
       SELECT 0::BIGINT AS position, 'total' AS key, count(*) AS value FROM r UNION ALL SELECT 1, k, count(*) FROM r WHERE k = 'created' GROUP BY k
       UNION ALL SELECT 2, k, count(*) FROM r WHERE k = 'updated' GROUP BY k UNION ALL SELECT 4, k, count(*) FROM r WHERE k = 'error' GROUP BY k""",
)
def bulk_result_counts(t):
    rows = t.orders.select(
        F.when(F.col("o_totalprice") > 400000, "too large").otherwise("").alias("error"),
        F.when(F.col("o_orderstatus") == "F", "created").when(F.col("o_orderstatus") == "O", "updated").alias("state"),
    )
    return m.bulk_result_counts(rows)


@query(
    "group_catalog",
    """SELECT 'all' AS choice, p_type AS "group", p_partkey, count(*) OVER (PARTITION BY p_type) AS group_size FROM part
       UNION ALL SELECT 'PROMO', p_brand, p_partkey, count(*) OVER (PARTITION BY p_brand) FROM part WHERE p_type = 'PROMO'""",
)
def group_catalog(t):
    everything = m.group_catalog(t.part, "p_partkey", "p_type")
    one = m.group_catalog(t.part, "p_partkey", "p_type", "p_brand", within="PROMO")
    return everything.select(F.lit("all").alias("choice"), "group", "p_partkey", "group_size").union(
        one.select(F.lit("PROMO"), "group", "p_partkey", "group_size")
    )
