"""Day ranges, zero-filled calendars and weekly time periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslake.functions.values import all_of, any_of

# The day counts a report may cover.
REPORT_DAYS = ["1", "7", "30"]

# Fixed value: separator between the ranges of one weekday.
RANGE_SEPARATOR = "、"


def normalize_days(value, fallback=7) -> int:
    """1, 7 or 30; anything else takes the fallback, which must itself be one of them, else 7."""
    backup = str(fallback) if str(fallback) in REPORT_DAYS else "7"
    text = str(value) if value not in (None, 0, False) else ""
    return int(text if text in REPORT_DAYS else backup)


def at(df: DataFrame, ts: str, moment: dt.date | dt.datetime | str) -> Column:
    """A literal of the column's own timestamp type, so that the comparison reaches the scan as a pushed filter."""
    return F.lit(str(moment)).cast(df.schema[ts].dataType)


def as_date(moment: dt.date | dt.datetime | str) -> dt.date:
    return dt.date.fromisoformat(str(moment)[:10])


def day_window(as_of, days: int) -> tuple[dt.date, dt.date]:
    """First day and the day after the last of the ``days`` calendar days ending on ``as_of``."""
    last = as_date(as_of)
    return last - dt.timedelta(days=days - 1), last + dt.timedelta(days=1)


def in_days(df: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    start, end = day_window(as_of, days)
    return df.where((F.col(ts) >= at(df, ts, start)) & (F.col(ts) < at(df, ts, end)))


def between(df: DataFrame, ts: str, date_from, date_to, snap: bool = False) -> DataFrame:
    """Rows of a date range, both ends included; ``snap`` widens it to whole days."""
    if snap:
        start, end = as_date(date_from), as_date(date_to) + dt.timedelta(days=1)
        return df.where((F.col(ts) >= at(df, ts, start)) & (F.col(ts) < at(df, ts, end)))
    return df.where((F.col(ts) >= at(df, ts, date_from)) & (F.col(ts) <= at(df, ts, date_to)))


def calendar(spark: SparkSession, as_of, days: int, name: str = "date") -> DataFrame:
    """One row per day of the window; at most a few hundred rows whatever the data."""
    start, _ = day_window(as_of, days)
    return spark.range(0, days, 1, 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias(name))


def latest(df: DataFrame, ts: str) -> Column:
    """The default ``as_of``: the newest timestamp of the input, as a scalar subquery."""
    return df.select(F.max(ts)).scalar()


def _minutes(text: str) -> int:
    hour, minute = text.split(":")
    return int(hour) * 60 + int(minute)


def parse_week_period(periods: list[dict]) -> dict[int, list[tuple[int, int]]]:
    """{weekday 0=Sunday: [(first minute, minute after the last)]}; an end of 00:00 means midnight."""
    parsed: dict[int, list[tuple[int, int]]] = {}
    for item in periods:
        for piece in filter(None, item["value"].split(RANGE_SEPARATOR)):
            begin, end = piece.split("~")
            parsed.setdefault(int(item["id"]), []).append((_minutes(begin), _minutes(end) or 1440))
    return parsed


def in_week_period(ts: Column, periods: list[dict]) -> Column:
    """True inside one of the weekly ranges; an empty list does not restrict."""
    parsed = parse_week_period(periods)
    if not periods:
        return F.lit(True)
    minute = F.hour(ts) * 60 + F.minute(ts)
    days = [
        all_of([F.dayofweek(ts) - 1 == day, any_of([(minute >= b) & (minute < e) for b, e in ranges])])
        for day, ranges in sorted(parsed.items())
    ]
    return any_of(days)
