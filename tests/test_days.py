"""Tables by day: other days' files stay untouched by a write, a patch and a retention."""

from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from accesslake.sources import days

SCHEMA = "id bigint, name string, ts timestamp_ntz"


def rows(spark, *values):
    return spark.createDataFrame(values, "id bigint, name string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def files(path):
    return {(str(f), f.stat().st_mtime_ns) for f in Path(path).glob("day=*/*.parquet")}


def read(spark, path):
    return sorted(((r.id, r.name) for r in days.read_days(spark, path, SCHEMA).collect()))


@pytest.fixture
def path(spark, tmp_path):
    out = str(tmp_path / "log")
    days.write_days(rows(spark, (1, "a", "2024-01-01 23:59:59"), (2, "b", "2024-01-02 00:00:00"), (3, "c", "2024-01-03 08:00:00"), (4, "d", None), (5, None, "2024-01-02 10:00:00")), out, "ts")
    return out


def test_a_write_replaces_only_its_days(spark, path):
    before = files(path)
    days.write_days(rows(spark, (9, "z", "2024-01-02 05:00:00")), path, "ts")
    assert read(spark, path) == [(1, "a"), (3, "c"), (4, "d"), (9, "z")]
    assert {f for f in before if "2024-01-02" not in f[0]} == {f for f in files(path) if "2024-01-02" not in f[0]}


def test_a_write_of_nothing_changes_nothing(spark, path):
    before = files(path)
    days.write_days(rows(spark, (9, "z", "2024-01-02 05:00:00")).where("id < 0"), path, "ts")
    assert files(path) == before


def test_a_patch_rewrites_only_the_days_it_touches(spark, path):
    before = files(path)
    batch = spark.createDataFrame([(2, "new"), (2, "newer"), (77, "absent"), (None, "nobody")], "id bigint, name string")
    assert days.patch_days(spark, path, SCHEMA, batch, "id", "ts") == [date(2024, 1, 2)]
    assert sorted(read(spark, path), key=str) == sorted([(1, "a"), (2, "new"), (3, "c"), (4, "d"), (5, None)], key=str)
    assert {f for f in before if "2024-01-02" not in f[0]} == {f for f in files(path) if "2024-01-02" not in f[0]}


def test_a_patch_of_rows_without_time_and_of_unknown_keys(spark, path):
    assert days.patch_days(spark, path, SCHEMA, spark.createDataFrame([(4, "e")], "id bigint, name string"), "id", "ts") == [None]
    before = files(path)
    assert days.patch_days(spark, path, SCHEMA, spark.createDataFrame([(99, "e")], "id bigint, name string"), "id", "ts") == []
    assert files(path) == before and (4, "e") in read(spark, path)


def test_retention_drops_whole_days(spark, path):
    before = files(path)
    assert days.drop_days(spark, path, 2, "2024-01-03") == [date(2024, 1, 1)]
    assert files(path) == {f for f in before if "2024-01-01" not in f[0]}
    assert days.drop_days(spark, path, 2, "2024-01-03") == []
    assert days.drop_days(spark, path + "-absent", 2, "2024-01-03") == []


def test_clashing_and_moving_columns_are_refused(spark, path):
    with pytest.raises(ValueError):
        days.write_days(rows(spark, (1, "a", None)).withColumn("day", F.lit(1)), path, "ts")
    with pytest.raises(ValueError):
        days.patch_days(spark, path, SCHEMA, rows(spark, (1, "a", None)), "id", "ts")
