"""Composite reports: named tables built from the metric operators, and their uniform long form.

Every report returns ``{table name: DataFrame}``. In each table the first column identifies the row and the others
are values, which is all ``long_form`` needs to bring series, distributions, records, metric maps and categories into
one schema. Parts of a report that read the same log first reduce it by the same keys, so that Spark runs the scan and
its shuffle once and reuses the exchange for the other parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from accesslake.functions.calendar import calendar, in_days
from accesslake.operators.metrics import (
    DAYPARTS,
    crosstab,
    series_by,
    daily,
    distribution,
    floor_share,
    metric_rows,
    ratio_pair,
    share_floor,
)
from accesslake.operators.ranking import top_k
from accesslake.operators.risks import RISKS, risk_totals

Report = dict[str, DataFrame]


#: The columns of a part whose series are values found in the data; it is in long form already.
LONG = ["row", "column", "value"]


def long_form(report: Report) -> DataFrame:
    """(table, row, column, value) of all tables; a missing value reads 0."""
    parts = []
    for name, df in report.items():
        if df.columns == LONG:
            cast = [F.col(c).cast("string").alias(c) for c in LONG]
            parts.append(df.select(F.lit(name).alias("table"), *cast))
            continue
        row, *values = df.columns
        cells = F.array(
            *[F.struct(F.lit(v).alias("column"), F.coalesce(F.col(v).cast("string"), F.lit("0")).alias("value")) for v in values]
        )
        parts.append(df.select(F.lit(name).alias("table"), F.col(row).cast("string").alias("row"), F.inline(cells)))
    return reduce(DataFrame.union, parts)


def names_of(value) -> list[str]:
    """A list, or text split at commas; trimmed, blanks dropped."""
    items = value if isinstance(value, (list, tuple)) else str(value or "").split(",")
    return [str(v).strip() for v in items if str(v).strip()]


def select_tables(report: Report, visible) -> Report:
    """A saved report's visible charts and tables; an empty choice shows all."""
    wanted = names_of(visible)
    return {k: v for k, v in report.items() if k in wanted} if wanted else report


def _counted(df: DataFrame, ts: str, as_of, days: int, *keys: str | Column) -> DataFrame:
    """Rows of the window reduced to counts ``n`` per date and keys: the frame all parts of a report start from.

    The parts must ask for the very same reduction, or Spark would run it once per part. So the date's null test, which
    the calendar join would add for some of them, is stated here, and parts that count distinct keys use ``_held``.
    """
    dated = in_days(df, ts, as_of, days).withColumn("date", F.to_date(ts)).where(F.col("date").isNotNull())
    return dated.groupBy("date", *keys).agg(F.count("*").alias("n"))


def _held(key: str) -> Column:
    """A key of a counted frame; naming ``n`` keeps the count in the part's plan, see ``_counted``."""
    return F.when(F.col("n") > 0, F.col(key))


def _summed(base: DataFrame, spark_days: tuple, measures: dict[str, Column]) -> DataFrame:
    """Zero-filled daily sums over a frame that is already reduced to counts ``n`` per date and keys."""
    as_of, days = spark_days
    per_day = base.groupBy("date").agg(*[F.sum(F.when(test, F.col("n")).otherwise(0)).alias(n) for n, test in measures.items()])
    return calendar(base.sparkSession, as_of, days).join(per_day, "date", "left").fillna(0, list(measures))


def _sums(base: DataFrame, measures: dict[str, Column]) -> DataFrame:
    row = base.agg(*[F.coalesce(F.sum(F.when(t, F.col("n")).otherwise(0)), F.lit(0)).alias(n) for n, t in measures.items()])
    return metric_rows(row)


def _by(base: DataFrame, key: str) -> DataFrame:
    return base.groupBy(F.col(key).alias("name")).agg(F.sum("n").alias("value"))


def _ranked(top: DataFrame, key: str, total: str = "total") -> DataFrame:
    return top.select("rank", key, total)


def _series(base: DataFrame, key: str, days: int, as_of) -> DataFrame:
    """Daily counts of every value of ``key`` that a counted frame has, in long form."""
    found = base.groupBy("date", F.col(key).alias("series")).agg(F.sum("n").alias("value"))
    return series_by(found, as_of, days).toDF(*LONG)


def user_login(users: DataFrame, logins: DataFrame, measures: dict[str, Column], days: int, as_of) -> Report:
    """Users: overview, sources, success and failure per day, visiting times and login methods."""
    daypart = F.floor(F.hour("datetime") / 6).alias("daypart")
    base = _counted(logins, "datetime", as_of, days, daypart, "method", "status")
    return {
        "user_stats": user_stats(users, measures),
        "user_by_source": distribution(users, "source"),
        "login_trend": _summed(base, (as_of, days), {"success": F.col("status"), "failure": ~F.col("status")}),
        "visit_time": _sums(base, {d: F.col("daypart") == i for i, d in enumerate(DAYPARTS)}),
        "login_methods": _series(base, "method", days, as_of),
    }


def overview(df: DataFrame, measures: dict[str, Column], hide_zero: tuple[str, ...] = ()) -> DataFrame:
    """(metric, value) rows of the caller's named aggregates, in one pass; metrics named in ``hide_zero`` vanish at zero."""
    return metric_rows(df.agg(*[m.alias(name) for name, m in measures.items()]), hide_zero)


def user_stats(users: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Overview of users; the row of face vectors is shown only if there are any."""
    return overview(users, measures, ("face_vector",))


def password_change(changes: DataFrame, days: int, as_of) -> Report:
    """Password changes: totals, per day, and the ten most active targets and operators."""
    base = _counted(changes, "datetime", as_of, days, "user", "change_by")
    totals = base.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_distinct(_held("user")).alias("targets"),
        F.count_distinct(_held("change_by")).alias("operators"),
    )
    return {
        "totals": metric_rows(totals),
        "per_day": _summed(base, (as_of, days), {"total": F.lit(True)}),
        "top_targets": _ranked(top_k(base, "user", F.sum("n")), "user"),
        "top_operators": _ranked(top_k(base, "change_by", F.sum("n")), "change_by"),
    }


def asset_statistic(assets: DataFrame, added: DataFrame, measures: dict[str, Column], days: int, as_of) -> Report:
    """Assets: overview, platform by category, and assets first seen per day. ``added`` has (asset, date_created)."""
    return {
        "asset_stats": overview(assets, measures),
        "platform_by_category": crosstab(assets, "platform", "category").toDF(*LONG),
        "assets_added": daily(added, "date_created", as_of, days, {"total": F.count("*")}),
    }


def asset_activity(sessions: DataFrame, days: int, as_of) -> Report:
    """Sessions of the window: totals, per day, active users and assets per day, and three distributions.

    The filtered join is reduced once by every key the parts need.
    """
    base = _counted(sessions, "date_start", as_of, days, "user_id", "asset_id", "protocol", "login_from", "is_finished")
    distinct = [F.count_distinct(_held("asset_id")).alias("assets"), F.count_distinct(_held("user_id")).alias("users")]
    totals = base.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"), *distinct)
    active = base.groupBy("date").agg(*distinct)
    return {
        "session_stats": metric_rows(totals),
        "session_trend": _summed(base, (as_of, days), {"total": F.lit(True)}),
        "active_trend": calendar(sessions.sparkSession, as_of, days).join(active, "date", "left").fillna(0, ["users", "assets"]),
        "by_protocol": _by(base, "protocol"),
        "by_login_from": _by(base, "login_from"),
        "by_finished": _by(base, "is_finished"),
    }


def account_statistic(accounts: DataFrame, versions: DataFrame, measures: dict[str, Column], days: int, as_of) -> Report:
    """Accounts: overview, created per day, by privilege and by user, assets with most accounts, highest versions."""
    return {
        "account_stats": overview(accounts, measures),
        "accounts_added": daily(accounts, "date_created", as_of, days, {"total": F.count("*")}),
        "by_privilege": distribution(accounts, "privileged"),
        "by_logins": distribution(accounts, "logins"),
        "top_assets": _ranked(top_k(accounts, "asset", F.count("*"), name="account_count"), "asset", "account_count"),
        "top_versions": _ranked(top_k(versions, "account", F.count("*"), name="version"), "account", "version"),
    }


def account_automation(jobs: DataFrame, kinds: list[str], found: DataFrame, days: int, as_of) -> Report:
    """Automations: per kind, executions per day and kind, risk totals, success and failure per day."""
    base = _counted(jobs, "date_start", as_of, days, "task", "is_success")
    return {
        "automations": _sums(base, {k: F.col("task") == k for k in kinds}),
        "executions": _summed(base, (as_of, days), {k: F.col("task") == k for k in kinds}),
        "outcome": _summed(base, (as_of, days), {"success": F.col("is_success"), "failed": ~F.col("is_success")}),
        "risks": metric_rows(risk_totals(found)),
    }


def audit_board(logs: DataFrame, sessions: DataFrame, kinds: dict[str, Column], success: Column, days: int, as_of) -> Report:
    """Audit: totals of every log kind, login success ratio, logins per day. ``logs`` is the raw event log.

    ``kinds`` tells by a test on ``event_type`` what counts for which log, ``success`` which logins succeeded.
    """
    base = _counted(logs, "ts", as_of, days, "event_type")
    totals = base.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("logins"),
        F.coalesce(F.sum(F.when(success, F.col("n"))), F.lit(0)).alias("login_success"),
    )
    ratios = totals.select(*ratio_pair(F.col("login_success"), F.col("logins"), "succeeded", "failed"))
    states = sessions.agg(
        F.count_if(~F.col("is_finished")).alias("online_sessions"), F.count_if(F.col("is_finished")).alias("history_sessions")
    )
    return {
        "log_totals": _sums(base, kinds),
        "session_totals": metric_rows(states),
        "login_ratio": ratios.select(F.lit("login").alias("name"), "succeeded", "failed"),
        "login_trend": _summed(base, (as_of, days), {"total": F.lit(True)}),
    }


def console_board(users: DataFrame, assets: DataFrame, logins: DataFrame, sessions: DataFrame, days: int, as_of, sessions_as_of) -> Report:
    """Console: login users of all users, active assets of all assets, platform shares, and the two top tens."""
    seen = in_days(logins, "datetime", as_of, days).groupBy("user_id").agg(F.count("*").alias("n"))
    used = in_days(sessions, "date_start", sessions_as_of, days).groupBy("asset_id").agg(F.count("*").alias("n"))
    user_ring = seen.agg(F.count("*").alias("active")).withColumn("total", users.select(F.count("*")).scalar())
    asset_ring = used.agg(F.count("*").alias("active")).withColumn("total", assets.select(F.count("*")).scalar())

    def ring(df, name):
        return df.select(F.lit(name).alias("name"), "active", "total", *ratio_pair(F.col("active"), F.col("total"), "percent", "rest"))

    return {
        "rings": ring(user_ring, "users").union(ring(asset_ring, "assets")),
        "platforms": share_floor(assets, "platform"),
        "top_users": _ranked(top_k(seen, "user_id", F.sum("n")), "user_id"),
        "top_assets": _ranked(top_k(used, "asset_id", F.sum("n")), "asset_id"),
    }


def pam_board(reconciled: DataFrame, privileged: Column, found: DataFrame, jobs: DataFrame, kinds: list[str], days: int, as_of) -> Report:
    """Accounts at a glance: privilege and presence counts, risks, risk shares, automations, riskiest assets."""
    per_asset = found.groupBy("asset", "risk").agg(F.count("*").alias("n"))
    # At most one row per risk name is left here, so one window over all of them is small.
    shares = per_asset.groupBy("risk").agg(F.sum("n").alias("value")).withColumn(
        "share", floor_share(F.col("value"), F.sum("value").over(Window.partitionBy()))
    )
    base = in_days(jobs, "date_start", as_of, days).groupBy("task").agg(F.count("*").alias("n"))
    return {
        "accounts": metric_rows(privilege_counts(reconciled, privileged)),
        "risks": _sums(per_asset, {f"total_{r}_accounts": F.col("risk") == r for r in RISKS}),
        "risk_shares": shares,
        "automations": _sums(base, {k: F.col("task") == k for k in kinds}),
        "top_assets": _ranked(top_k(per_asset, "asset", F.sum("n")), "asset"),
    }


def privilege_counts(reconciled: DataFrame, privileged: Column) -> DataFrame:
    """Privileged and ordinary managed accounts, accounts only on the host, and accounts gone from it."""
    return reconciled.agg(
        F.count_if(F.col("present") & privileged).alias("privileged"),
        F.count_if(F.col("present") & ~privileged).alias("ordinary"),
        F.count_if(~F.col("present")).alias("unmanaged"),
        F.count_if(~F.col("remote_present")).alias("unavailable"),
    )


def change_secret_summary(runs: DataFrame) -> DataFrame:
    """Cards of secret changes. ``runs`` has (task, periodic, asset, state) with state success, failed or ongoing."""
    return runs.agg(
        F.count_distinct("task").alias("tasks"),
        F.count_distinct(F.when(F.col("periodic"), F.col("task"))).alias("periodic"),
        F.count_distinct("asset").alias("assets"),
        F.count("*").alias("executions"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("success", "failed", "ongoing")],
    )


def change_secret_board(runs: DataFrame, days: int, as_of) -> Report:
    """Secret changes: cards, success and failure per day of the window, and the window's failed runs."""
    recent = in_days(runs, "date_start", as_of, days)
    trend = {"success": F.count_if(F.col("state") == "success"), "failed": F.count_if(F.col("state") == "failed")}
    return {
        "cards": metric_rows(change_secret_summary(runs)),
        "trend": daily(runs, "date_start", as_of, days, trend),
        "failed_runs": recent.where(F.col("state") == "failed").select("id", "task", "asset"),
    }
