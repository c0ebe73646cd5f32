"""Queries over composite reports; each returns the report's long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.catalog.metrics import (
    ACCOUNT_SQL,
    ACCOUNT_STATS_SQL,
    ASSET_STATS_SQL,
    AUTOMATIONS,
    PRIVILEGE_SQL,
    USER_STATS_SQL,
    days_sql,
    secret_runs,
)
from accesslake.catalog import choices
from accesslake.catalog.registry import EVENT_TYPES, EVENTS_AS_OF, LINES_AS_OF, ORDERS_AS_OF, PART_TYPES, query
from accesslake.catalog.relations import reconciled
from accesslake.catalog.risks import FINDINGS_SQL, findings
from accesslake.operators.metrics import DAYPARTS
from accesslake.operators.risks import RISKS
from accesslake.plans import reports
from accesslake.sources import adapters as a

DAYS = 30


def cells(table: str, source: str, row: str, columns: list[str]) -> str:
    """The long form of one table: a SELECT per value column."""
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS \"table\", CAST({row} AS VARCHAR) AS \"row\", '{c}' AS \"column\", "
        f"coalesce(CAST(\"{c}\" AS VARCHAR), '0') AS value FROM ({source})"
        for c in columns
    )


def union(*parts: str) -> str:
    return "\nUNION ALL ".join(parts)


def per_day(source: str, as_of: str, measures: dict[str, str], days: int = DAYS) -> str:
    """Zero-filled daily measures of a source with a ``date`` column."""
    named = ", ".join(f'{sql} AS "{n}"' for n, sql in measures.items())
    zero = ", ".join(f'coalesce("{n}", 0)::BIGINT AS "{n}"' for n in measures)
    return (
        f"WITH {days_sql(as_of, days)}, src AS ({source}), n AS (SELECT date, {named} FROM src GROUP BY date) "
        f"SELECT date, {zero} FROM cal LEFT JOIN n USING (date)"
    )


def metric_map(source: str, measures: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, ({sql})::BIGINT AS value FROM ({source})" for n, sql in measures.items())


def top10(source: str, key: str, total: str, name: str = "total") -> str:
    return (
        f"SELECT row_number() OVER (ORDER BY {total} DESC, {key}) AS rank, {key}, {total} AS {name} FROM ({source}) GROUP BY {key} "
        f"ORDER BY {name} DESC, {key} LIMIT 10"
    )


LOGINS = (
    "SELECT *, ts::DATE AS date, event_type <> 'error' AS status, json_extract_string(props, '$.k')::BIGINT AS k FROM events "
    "WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'"
)
SUCCESS = "count(*) FILTER (status)"
FAILURE = "count(*) FILTER (NOT status)"


@query(
    "report_user_login",
    union(
        cells("user_stats", USER_STATS_SQL, "metric", ["value"]),
        cells("user_by_source", "SELECT c_mktsegment AS name, count(*) AS value FROM customer GROUP BY 1", "name", ["value"]),
        cells("login_trend", per_day(LOGINS, EVENTS_AS_OF, {"success": SUCCESS, "failure": FAILURE}), "date", ["success", "failure"]),
        cells(
            "visit_time",
            metric_map(LOGINS, {d: f"count(*) FILTER (hour(ts) // 6 = {i})" for i, d in enumerate(DAYPARTS)}),
            "metric",
            ["value"],
        ),
        cells(
            "login_methods",
            per_day(LOGINS, EVENTS_AS_OF, {m: f"count(*) FILTER (event_type = '{m}')" for m in EVENT_TYPES}),
            "date",
            EVENT_TYPES,
        ),
    ),
)
def report_user_login(t):
    return reports.long_form(reports.user_login(a.user(t.customer), a.login_log(t.events), choices.user_measures(), DAYS, EVENTS_AS_OF))


CHANGES = f"SELECT user_id AS \"user\", k AS change_by, date FROM ({LOGINS}) WHERE event_type = 'signup'"


@query(
    "report_password_change",
    union(
        cells(
            "totals",
            metric_map(
                CHANGES, {"total": "count(*)", "targets": 'count(DISTINCT "user")', "operators": "count(DISTINCT change_by)"}
            ),
            "metric",
            ["value"],
        ),
        cells("per_day", per_day(CHANGES, EVENTS_AS_OF, {"total": "count(*)"}), "date", ["total"]),
        cells("top_targets", top10(CHANGES, '"user"', "count(*)"), "rank", ["user", "total"]),
        cells("top_operators", top10(CHANGES, "change_by", "count(*)"), "rank", ["change_by", "total"]),
    ),
)
def report_password_change(t):
    return reports.long_form(reports.password_change(a.password_change_log(t.events), DAYS, EVENTS_AS_OF))


@query(
    "report_asset_statistic",
    union(
        cells("asset_stats", ASSET_STATS_SQL, "metric", ["value"]),
        cells(
            "platform_by_category",
            "SELECT p_brand AS platform, "
            + ", ".join(f'count(*) FILTER (p_type = \'{c}\') AS "{c}"' for c in PART_TYPES)
            + " FROM part GROUP BY 1",
            "platform",
            PART_TYPES,
        ),
        cells(
            "assets_added",
            per_day("SELECT min(l_shipdate)::DATE AS date FROM lineitem GROUP BY l_partkey", ORDERS_AS_OF, {"total": "count(*)"}),
            "date",
            ["total"],
        ),
    ),
)
def report_asset_statistic(t):
    added = t.lineitem.groupBy(F.col("l_partkey").alias("asset")).agg(F.min("l_shipdate").alias("date_created"))
    return reports.long_form(reports.asset_statistic(a.asset(t.part), added, choices.asset_measures(), DAYS, ORDERS_AS_OF))


SESSIONS = (
    "SELECT o_orderdate::DATE AS date, o_custkey AS user_id, l_partkey AS asset_id, l_linestatus, l_returnflag, o_orderstatus = 'F' AS fin "
    "FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '2001-07-03' AND o_orderdate < TIMESTAMP '2001-08-02'"
)


def spread(column: str) -> str:
    return f"SELECT {column} AS name, count(*) AS value FROM ({SESSIONS}) GROUP BY 1"


@query(
    "report_asset_activity",
    union(
        cells(
            "session_stats",
            metric_map(
                SESSIONS, {"sessions": "count(*)", "assets": "count(DISTINCT asset_id)", "users": "count(DISTINCT user_id)"}
            ),
            "metric",
            ["value"],
        ),
        cells("session_trend", per_day(SESSIONS, ORDERS_AS_OF, {"total": "count(*)"}), "date", ["total"]),
        cells(
            "active_trend",
            per_day(SESSIONS, ORDERS_AS_OF, {"users": "count(DISTINCT user_id)", "assets": "count(DISTINCT asset_id)"}),
            "date",
            ["users", "assets"],
        ),
        cells("by_protocol", spread("l_linestatus"), "name", ["value"]),
        cells("by_login_from", spread("l_returnflag"), "name", ["value"]),
        cells("by_finished", spread("fin"), "name", ["value"]),
    ),
)
def report_asset_activity(t):
    return reports.long_form(reports.asset_activity(a.session(t.orders, t.lineitem), DAYS, ORDERS_AS_OF))


@query(
    "report_account_statistic",
    union(
        cells("account_stats", f"WITH {ACCOUNT_SQL} {ACCOUNT_STATS_SQL}", "metric", ["value"]),
        cells(
            "accounts_added",
            per_day(f"WITH {ACCOUNT_SQL} SELECT created::DATE AS date FROM acc", LINES_AS_OF, {"total": "count(*)"}),
            "date",
            ["total"],
        ),
        cells(
            "by_privilege",
            f"WITH {ACCOUNT_SQL} SELECT username % 5 = 0 AS name, count(*) AS value FROM acc GROUP BY 1",
            "name",
            ["value"],
        ),
        cells("by_logins", f"WITH {ACCOUNT_SQL} SELECT logins AS name, count(*) AS value FROM acc GROUP BY 1", "name", ["value"]),
        cells(
            "top_assets",
            top10(f"WITH {ACCOUNT_SQL} SELECT asset FROM acc", "asset", "count(*)", "account_count"),
            "rank",
            ["asset", "account_count"],
        ),
        cells("top_versions", top10("SELECT o_custkey AS account FROM orders", "account", "count(*)", "version"), "rank", ["account", "version"]),
    ),
)
def report_account_statistic(t):
    versions = t.orders.select(F.col("o_custkey").alias("account"))
    return reports.long_form(reports.account_statistic(a.account(t.lineitem), versions, choices.account_measures(LINES_AS_OF, DAYS), DAYS, LINES_AS_OF))


KINDS = {k: f"count(*) FILTER (event_type = '{e}')" for k, e in AUTOMATIONS.items()}
RISK_TOTALS = {f"total_{r}_accounts": f"count(*) FILTER (risk = '{r}')" for r in RISKS}


def found_sql(select: str) -> str:
    return f"WITH {FINDINGS_SQL} {select}"


def kinds_of(t):
    """The job log with the automation kind in place of the event type."""
    jobs = a.job_log(t.events)
    kind = F.coalesce(*[F.when(F.col("task") == e, F.lit(k)) for k, e in AUTOMATIONS.items()])
    return jobs.withColumn("task", kind)


@query(
    "report_account_automation",
    union(
        cells("automations", metric_map(LOGINS, KINDS), "metric", ["value"]),
        cells("executions", per_day(LOGINS, EVENTS_AS_OF, KINDS), "date", list(AUTOMATIONS)),
        cells("outcome", per_day(LOGINS, EVENTS_AS_OF, {"success": SUCCESS, "failed": FAILURE}), "date", ["success", "failed"]),
        cells("risks", metric_map(found_sql("SELECT risk FROM found"), RISK_TOTALS), "metric", ["value"]),
    ),
)
def report_account_automation(t):
    return reports.long_form(reports.account_automation(kinds_of(t), list(AUTOMATIONS), findings(t), DAYS, EVENTS_AS_OF))


RATIO = "round(count(*) FILTER (status) * 100.0::DOUBLE / count(*), 2)"


@query(
    "dashboard_audit",
    union(
        cells(
            "log_totals",
            metric_map(
                LOGINS,
                {
                    "logins": "count(*)",
                    "operations": "count(*) FILTER (event_type IN ('click', 'view'))",
                    "password_changes": "count(*) FILTER (event_type = 'signup')",
                    "file_logs": "count(*) FILTER (event_type = 'purchase')",
                    "jobs": "count(*) FILTER (event_type <> 'view')",
                },
            ),
            "metric",
            ["value"],
        ),
        cells(
            "session_totals",
            metric_map(
                "SELECT o_orderstatus AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
                {"online_sessions": "count(*) FILTER (s <> 'F')", "history_sessions": "count(*) FILTER (s = 'F')"},
            ),
            "metric",
            ["value"],
        ),
        cells(
            "login_ratio",
            f"SELECT 'login' AS name, {RATIO} AS succeeded, round(100.0::DOUBLE - {RATIO}, 2) AS failed FROM ({LOGINS})",
            "name",
            ["succeeded", "failed"],
        ),
        cells("login_trend", per_day(LOGINS, EVENTS_AS_OF, {"total": "count(*)"}), "date", ["total"]),
    ),
)
def dashboard_audit(t):
    return reports.long_form(reports.audit_board(t.events, a.session(t.orders, t.lineitem), choices.log_kinds(), choices.login_success(), DAYS, EVENTS_AS_OF))


RINGS = f"""WITH b AS (SELECT 'users' AS name, count(DISTINCT user_id) AS active, (SELECT count(*) FROM customer) AS total FROM ({LOGINS})
    UNION ALL SELECT 'assets', count(DISTINCT asset_id), (SELECT count(*) FROM part) FROM ({SESSIONS}))
    SELECT *, round(active * 100.0::DOUBLE / total, 2) AS percent, round(100.0::DOUBLE - round(active * 100.0::DOUBLE / total, 2), 2) AS rest FROM b"""


@query(
    "dashboard_console",
    union(
        cells("rings", RINGS, "name", ["active", "total", "percent", "rest"]),
        cells(
            "platforms",
            "SELECT p_brand AS name, count(*) AS value, ((count(*) * 10000 // (SELECT count(*) FROM part)) / 100.0::DOUBLE) AS share FROM part GROUP BY 1",
            "name",
            ["value", "share"],
        ),
        cells("top_users", top10(LOGINS, "user_id", "count(*)"), "rank", ["user_id", "total"]),
        cells("top_assets", top10(SESSIONS, "asset_id", "count(*)"), "rank", ["asset_id", "total"]),
    ),
)
def dashboard_console(t):
    board = reports.console_board(
        a.user(t.customer), a.asset(t.part), a.login_log(t.events), a.session(t.orders, t.lineitem), DAYS, EVENTS_AS_OF, ORDERS_AS_OF
    )
    return reports.long_form(board)


@query(
    "dashboard_pam",
    union(
        cells(
            "accounts",
            f"WITH {FINDINGS_SQL}, p AS ({PRIVILEGE_SQL}) SELECT unnest(['privileged', 'ordinary', 'unmanaged', 'unavailable']) AS metric, "
            "unnest([privileged, ordinary, unmanaged, unavailable]) AS value FROM p",
            "metric",
            ["value"],
        ),
        cells("risks", metric_map(found_sql("SELECT risk FROM found"), RISK_TOTALS), "metric", ["value"]),
        cells(
            "risk_shares",
            found_sql(
                "SELECT risk, count(*) AS value, ((count(*) * 10000 // (SELECT count(*) FROM found)) / 100.0::DOUBLE) AS share FROM found GROUP BY 1"
            ),
            "risk",
            ["value", "share"],
        ),
        cells("automations", metric_map(LOGINS, KINDS), "metric", ["value"]),
        cells("top_assets", top10(found_sql("SELECT asset FROM found"), "asset", "count(*)"), "rank", ["asset", "total"]),
    ),
)
def dashboard_pam(t):
    return reports.long_form(reports.pam_board(reconciled(t), choices.privileged(), findings(t), kinds_of(t), list(AUTOMATIONS), DAYS, EVENTS_AS_OF))


RUNS = (
    "SELECT o_orderkey AS id, o_custkey AS task, floor(o_totalprice / 1000)::BIGINT AS asset, o_orderstatus AS s, o_orderdate::DATE AS date FROM orders"
)
FAILED = f"SELECT id, task, asset FROM ({RUNS}) WHERE s = 'P' AND date BETWEEN DATE '2001-07-03' AND DATE '2001-08-01'"


@query(
    "dashboard_change_secret",
    union(
        cells(
            "cards",
            metric_map(
                RUNS,
                {
                    "tasks": "count(DISTINCT task)",
                    "periodic": "count(DISTINCT CASE WHEN task % 2 = 0 THEN task END)",
                    "assets": "count(DISTINCT asset)",
                    "executions": "count(*)",
                    "success": "count(*) FILTER (s = 'F')",
                    "failed": "count(*) FILTER (s = 'P')",
                    "ongoing": "count(*) FILTER (s = 'O')",
                },
            ),
            "metric",
            ["value"],
        ),
        cells(
            "trend",
            per_day(RUNS, ORDERS_AS_OF, {"success": "count(*) FILTER (s = 'F')", "failed": "count(*) FILTER (s = 'P')"}),
            "date",
            ["success", "failed"],
        ),
        cells("failed_runs", FAILED, "id", ["task", "asset"]),
    ),
)
def dashboard_change_secret(t):
    return reports.long_form(reports.change_secret_board(secret_runs(t), DAYS, ORDERS_AS_OF))


@query(
    "report_long",
    union(
        cells("series", per_day(LOGINS, EVENTS_AS_OF, {"success": SUCCESS, "failure": FAILURE}), "date", ["success", "failure"]),
        cells("sources", "SELECT c_mktsegment AS name, count(*) AS value FROM customer GROUP BY 1", "name", ["value"]),
        cells("user_stats", USER_STATS_SQL, "metric", ["value"]),
        cells(
            "category_types",
            "SELECT p_type AS __category, p_brand AS name, count(*) AS value FROM part GROUP BY ALL",
            "__category",
            ["name", "value"],
        ),
    ),
)
def report_long(t):
    """One table of each shape: date series, name and value, metric map, records per category."""
    login = reports.user_login(a.user(t.customer), a.login_log(t.events), choices.user_measures(), DAYS, EVENTS_AS_OF)
    by_category = t.part.groupBy(F.col("p_type").alias("__category"), F.col("p_brand").alias("name")).agg(F.count("*").alias("value"))
    return reports.long_form(
        {
            "series": login["login_trend"],
            "sources": login["user_by_source"],
            "user_stats": login["user_stats"],
            "category_types": by_category,
        }
    )


@query(
    "report_select",
    union(
        cells("user_stats", USER_STATS_SQL, "metric", ["value"]),
        cells("login_trend", per_day(LOGINS.replace("2024-01-01", "2024-01-24"), EVENTS_AS_OF, {"success": SUCCESS, "failure": FAILURE}, 7), "date", ["success", "failure"]),
    ),
)
def report_select(t):
    """A saved report of seven days with two of its tables visible."""
    login = reports.user_login(a.user(t.customer), a.login_log(t.events), choices.user_measures(), 7, EVENTS_AS_OF)
    return reports.long_form(reports.select_tables(login, " user_stats, ,login_trend "))
