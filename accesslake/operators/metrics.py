"""Counters, zero-filled series, distributions, ratios and cross tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.functions.calendar import as_date, at, calendar, in_days
from accesslake.operators.relations import attach_spread

# Quarters of the day of the visiting-time chart.
DAYPARTS = ["00:00-06:00", "06:00-12:00", "12:00-18:00", "18:00-24:00"]

# Keys of the bulk-create result in their order.
BULK_KEYS = ["total", "created", "updated", "skipped", "error"]

# Load states of a component.
LOAD_STATES = ["normal", "high", "critical", "offline"]


def counters(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Any set of named totals in one pass: one row, one column per predicate."""
    return df.agg(*[F.count_if(test).alias(name) for name, test in named.items()])


def metric_rows(one_row: DataFrame, hide_zero: tuple[str, ...] = (), metric: str = "metric", value: str = "value") -> DataFrame:
    """(metric, value) rows of a one-row frame; metrics named in ``hide_zero`` vanish at zero."""
    pairs = F.array(*[F.struct(F.lit(c).alias(metric), F.col(c).cast("bigint").alias(value)) for c in one_row.columns])
    rows = one_row.select(F.inline(pairs))
    return rows.where(~(F.col(metric).isin(*hide_zero) & (F.col(value) == 0))) if hide_zero else rows


def daily(df: DataFrame, ts: str, as_of, days: int, measures: dict[str, Column], name: str = "date") -> DataFrame:
    """Measures per calendar day, zero on days without rows.

    The day range is a literal filter that reaches the scan, and rows are reduced to one per day before they meet the
    calendar.
    """
    per_day = in_days(df, ts, as_of, days).groupBy(F.to_date(ts).alias(name)).agg(*[m.alias(n) for n, m in measures.items()])
    return calendar(df.sparkSession, as_of, days, name).join(per_day, name, "left").fillna(0, list(measures))


def series_by(found: DataFrame, as_of, days: int, name: str = "date") -> DataFrame:
    """``(date, series, value)`` counts filled with zeros on the days of the window, for every series there is (null too).

    The days are a literal list that each series' row is multiplied by, so nothing is paired but series and days.
    """
    last = F.lit(as_date(as_of))
    dates = F.sequence(F.date_sub(last, days - 1), last)
    # Naming the count keeps it in this reader's plan too, so both share what was counted.
    every = found.where(F.col("value") > 0).select(F.col("series").alias("_series")).distinct().select(F.explode(dates).alias("_date"), "_series")
    same = (F.col("_date") == F.col(name)) & F.col("_series").eqNullSafe(F.col("series"))
    return every.join(found, same, "left").select(F.col("_date").alias(name), F.col("_series").alias("series"), F.coalesce("value", F.lit(0)).alias("value"))


def daily_by(df: DataFrame, ts: str, by: str, as_of, days: int, name: str = "date") -> DataFrame:
    """``(date, series, value)``: one zero-filled series per value of ``by`` that the window's rows have."""
    found = in_days(df, ts, as_of, days).groupBy(F.to_date(ts).alias(name), F.col(by).alias("series")).agg(F.count("*").alias("value"))
    return series_by(found, as_of, days, name)


def dayparts(df: DataFrame, ts: str) -> DataFrame:
    """Counts of the four quarters of the day; an empty quarter counts 0."""
    quarter = F.floor(F.hour(ts) / 6)
    return metric_rows(counters(df, {label: quarter == i for i, label in enumerate(DAYPARTS)}), metric="daypart")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("value"))


def distribution_or_nothing(df: DataFrame, column: str) -> DataFrame:
    """The distribution, or the single row (``Nothing``, 0) when there is no row at all."""
    nothing = df.sparkSession.range(0, 1, 1, 1).select(F.lit("Nothing").alias("name"), F.lit(0).cast("bigint").alias("value"))
    return distribution(df, column).unionByName(nothing.where(~df.select(F.lit(1)).limit(1).exists()))


def floor_share(part: Column, whole: Column) -> Column:
    """Percent floored to two decimals, in whole numbers so that no float error moves the floor."""
    return F.floor(part * 10000 / whole).cast("bigint") / F.lit(100.0)


def share_floor(df: DataFrame, column: str) -> DataFrame:
    """Distribution with each value's floored share; the total is a scalar subquery, not a window over all rows."""
    return distribution(df, column).withColumn("share", floor_share(F.col("value"), df.select(F.count("*")).scalar()))


def ratio(part: Column, whole: Column) -> Column:
    """Percent with two decimals; 0 of 0 is 0."""
    return F.round(F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0)), 2)


def ratio_pair(part: Column, whole: Column, name: str, other: str) -> list[Column]:
    """The ratio and its complement to 100, both with two decimals."""
    r = ratio(part, whole)
    return [r.alias(name), F.round(F.lit(100.0) - r, 2).alias(other)]


def crosstab(df: DataFrame, row: str, column: str, measure: Column | None = None) -> DataFrame:
    """``(row, column, value)`` over the row and column values found (null too), 0 where a pair is missing.

    The column values are few, as they become a chart's series: their set goes to every row value as one scalar.
    """
    measure = F.count("*") if measure is None else measure
    found = df.groupBy(F.col(row).alias("_r"), F.col(column).alias("_c")).agg(measure.alias("_v"))
    columns = found.agg(F.collect_set(F.struct("_c"))).scalar()
    every = found.select(F.col("_r").alias(row)).distinct().withColumn("_all", columns).select(row, F.explode("_all").alias("_s")).select(row, F.col("_s._c").alias(column))
    same = F.col(row).eqNullSafe(F.col("_r")) & F.col(column).eqNullSafe(F.col("_c"))
    return every.join(found, same, "left").select(row, column, F.coalesce("_v", F.lit(0)).alias("value"))


def active_per_day(sessions: DataFrame, ts: str, user: str, asset: str, as_of, days: int, approximate: bool = False) -> DataFrame:
    """Distinct users and assets per day; the approximate form keeps one small sketch per day instead of all pairs."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return daily(sessions, ts, as_of, days, {"users": count(F.col(user)), "assets": count(F.col(asset))})


def label_values(bridge: DataFrame) -> DataFrame:
    """Distinct values per label name, sorted by both; rows rather than a list, so a name may have any number."""
    return bridge.select("name", "value").distinct().orderBy("name", "value")


def label_resource_count(labels: DataFrame, bridge: DataFrame) -> DataFrame:
    used = bridge.groupBy("name", "value").agg(F.count_distinct("res_id").alias("res_count"))
    return labels.join(used, ["name", "value"], "left").fillna(0, ["res_count"])


def tagged_union(kinds: dict[str, tuple[DataFrame, str, str]], keyword: str) -> DataFrame:
    """(model, id, name) of every entity whose name contains the keyword, whatever its kind."""
    result = None
    for model, (df, key, name) in kinds.items():
        hits = df.where(F.contains(F.lower(F.col(name)), F.lit(keyword.lower()))).select(
            F.lit(model).alias("model"), F.col(key).cast("string").alias("id"), F.col(name).alias("name")
        )
        result = hits if result is None else result.unionByName(hits)
    return result


def group_hits(hits: DataFrame, by: str, row_id: Column) -> DataFrame:
    """Search hits with the size of their group. Groups stay as rows, and a large one is spread over tasks."""
    return attach_spread(hits, hits.groupBy(by).agg(F.count("*").alias("group_size")), by, row_id, "group_size")


def import_summary(rows: DataFrame, status: str = "status") -> DataFrame:
    s = F.col(status)
    totals = rows.agg(
        F.count("*").alias("total"),
        F.count_if(s == "ok").alias("ok"),
        F.count_if(s == "error").alias("failed"),
        F.count_if(s == "pending").alias("pending"),
    )
    percent = F.round(F.coalesce(F.try_divide((F.col("total") - F.col("pending")) * 100.0, F.col("total")), F.lit(0.0)))
    return totals.withColumn("processed_percent", percent.cast("bigint"))


def job_summary(runs: DataFrame, execution: str, host: str, outcome: str) -> DataFrame:
    """Hosts per execution: ok, excluded, and failed or unreachable (a host that is both counts once)."""
    o = F.col(outcome)
    return runs.groupBy(execution).agg(
        F.count_distinct(F.when(o == "ok", F.col(host))).alias("ok"),
        F.count_distinct(F.when(o == "excludes", F.col(host))).alias("excludes"),
        F.count_distinct(F.when(o.isin("failures", "dark"), F.col(host))).alias("failed"),
    )


def task_ratio(runs: DataFrame, task: str, success: Column) -> DataFrame:
    return runs.groupBy(task).agg(F.count_if(success).alias("success"), F.count("*").alias("total"))


def component_load(df: DataFrame, kind: str, state: Column) -> DataFrame:
    """Per component kind: count and percent (two decimals) of each load state."""
    counted = df.groupBy(kind).agg(F.count("*").alias("total"), *[F.count_if(state == s).alias(s) for s in LOAD_STATES])
    return counted.withColumns({f"{s}_pct": ratio(F.col(s), F.col("total")) for s in LOAD_STATES})


def log_cards(lines: DataFrame, cards: dict[str, list[str]], component: str = "component") -> DataFrame:
    """Lines merged per card; a component named by several cards goes to each, and an empty card keeps one row.

    ``log_count`` orders the cards, largest first. Cards are a plan-time map: lines are tagged in place, and the sizes
    that are broadcast have exactly one row per card.
    """
    tags = F.array_compact(F.array(*[F.when(F.col(component).isin(*names), F.lit(card)) for card, names in cards.items()]))
    tagged = lines.withColumn("card", F.explode(tags))
    counts = tagged.groupBy("card").agg(F.count("*").alias("log_count"))
    order = lines.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(c) for c in cards])).alias("card"))
    sized = order.join(counts, "card", "left").fillna(0, ["log_count"])
    empty = sized.where(F.col("log_count") == 0)
    return tagged.join(F.broadcast(sized), "card").unionByName(empty, allowMissingColumns=True)


def bulk_result_counts(rows: DataFrame, error: str = "error", state: str = "state") -> DataFrame:
    """(position, key, value): an error outranks the state; besides ``total`` only keys above zero are shown."""
    failed = F.coalesce(F.col(error) != "", F.lit(False))
    outcome = F.when(failed, F.lit("error")).otherwise(F.col(state))
    totals = rows.select(outcome.alias("_o")).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("_o") == k).alias(k) for k in BULK_KEYS[1:]]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(k).alias("key"), F.col(k).alias("value"))
            for i, k in enumerate(BULK_KEYS)
        ]
    )
    return totals.select(F.inline(pairs)).where((F.col("key") == "total") | (F.col("value") > 0))


def group_catalog(df: DataFrame, key: str, category: str, type_: str | None = None, within: str | None = None) -> DataFrame:
    """Rows grouped by category, or by type inside one category, with the group's size; groups stay as rows."""
    rows = df.where(F.col(category) == within) if within is not None else df
    by = type_ if type_ is not None and within is not None else category
    keyed = rows.select(F.col(by).cast("string").alias("group"), key)
    return group_hits(keyed, "group", F.col(key))


def total_and_distinct(df: DataFrame, total: str, **distinct: str) -> DataFrame:
    return df.agg(F.count("*").alias(total), *[F.count_distinct(c).alias(n) for n, c in distinct.items()])




def week_added(df: DataFrame, created: str, as_of) -> DataFrame:
    """Total, and rows created since the Monday of the week of ``as_of`` up to that day; one pass."""
    last = as_date(as_of)
    monday = last - dt.timedelta(days=last.weekday())
    c = F.col(created)
    this_week = (c >= at(df, created, monday)) & (c < at(df, created, last + dt.timedelta(days=1)))
    return df.agg(F.count("*").alias("total"), F.count_if(this_week).alias("week_added"))
