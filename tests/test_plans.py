"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from accesslake.catalog.registry import EVENTS_AS_OF
from accesslake.functions import calendar as cal
from accesslake.operators import relations as r
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = [n for n in sorted(queries()) if not n.startswith(("stream", "export"))]


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_cross_products(spark, name):
    text = plan(queries()[name](spark, SMALL))
    assert not re.search(r"EvalPython|InPandas|PythonUDF|CartesianProduct|BroadcastNestedLoop", text)


def test_day_range_and_columns_reach_the_scan(tables):
    text = plan(cal.in_days(tables.events, "ts", EVENTS_AS_OF, 7).select("event_id"))
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in text and "LessThan(ts,2024-01-31T00:00)" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_recent_rows_are_limited_before_the_shuffle(spark):
    assert plan(queries()["recent_activity"](spark, SMALL)).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name, scans", [("report_user_login", {"events": 1}), ("report_asset_activity", {"orders": 1, "lineitem": 1})])
def test_report_parts_share_one_scan(spark, name, scans):
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        df = queries()[name](spark, SMALL)
        df.collect()
        text = plan(df).split("== Initial Plan ==")[0]
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
    for table, n in scans.items():
        assert len(re.findall(rf"FileScan parquet.*?/{table}\.parquet", text)) == n


def test_adaptive_execution_can_split_a_hot_key(spark):
    """With half of the rows on one key, the join back to an aggregated side is split although nothing is salted."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("row")
        )
        per_key = df.groupBy("k").agg(F.count("*").alias("n"))
        joined = r.attach_spread(df, per_key, "k", F.col("row"))
        assert joined.where("k = -1").agg(F.min("n"), F.count("*")).first() == (100_000, 100_000)
        summed = joined.agg(F.sum("n"), F.max("row"))
        summed.collect()
        assert "SortMergeJoin(skew=true)" in plan(summed)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_both_account_snapshots_are_one_aggregation(spark):
    text = plan(queries()["discovery_reconcile"](spark, SMALL))
    assert len(re.findall(r"FileScan parquet.*?/lineitem\.parquet", text)) == 1
    assert "Join" not in text
