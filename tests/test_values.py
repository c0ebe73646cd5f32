import datetime as dt

import pytest
from pyspark.sql import functions as F

from accesslake.functions import calendar as cal
from accesslake.functions import values as v
from accesslake.functions.network import ip_in, ip_to_long, merged


def one(spark, column, **data):
    return spark.createDataFrame([tuple(data.values())], list(data)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "seconds, text",
    [
        (86400, "24.0 h"),
        (86401, "1.0 d"),
        (3600, "60.0 m"),
        (3661, "1.0 h"),
        (60, "60.0 s"),
        (61, "1.0 m"),
        (0, "0.0 s"),
        (-1, ""),
        (129600, "1.5 d"),
    ],
)
def test_duration_unit_needs_more_than_one(spark, seconds, text):
    start = dt.datetime(2024, 1, 1)
    out = one(spark, v.readable_duration(F.col("a"), F.col("b")), a=start, b=start + dt.timedelta(seconds=seconds))
    assert out == text


@pytest.mark.parametrize("n, text", [(0, "0 Bytes"), (1023, "1023 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (1048576, "1 MB"), (5 * 1024**4, "5 TB")])
def test_format_bytes(spark, n, text):
    assert one(spark, v.format_bytes(F.col("n")), n=n) == text


def test_truncate_center_keeps_the_head_of_the_first_n(spark):
    text = "".join(chr(97 + i % 26) for i in range(60))
    n = 11
    assert one(spark, v.truncate_center(F.col("s"), n), s=text) == text[: 6 - 2] + "..." + text[6 + 1 : n]
    assert one(spark, v.truncate_center(F.col("s"), 60), s=text) == text
    assert one(spark, v.truncate_end(F.col("s"), 10), s=text) == text[:7] + "..."


@pytest.mark.parametrize(
    "text, day",
    [
        ("2024/01/02 03:04:05", "2024-01-02 03:04:05"),
        ("2024-01-02 03:04:05 +0800", "2024-01-02 03:04:05"),
        ("2024-01-02", "2024-01-02 00:00:00"),
        ("soon", None),
    ],
)
def test_safe_date(spark, text, day):
    assert one(spark, F.date_format(v.safe_date(F.col("s")), "yyyy-MM-dd HH:mm:ss"), s=text) == day


@pytest.mark.parametrize(
    "seconds, text",
    [(29, "just now"), (30, "1 minutes ago"), (61, "2 minutes ago"), (3600, "1 hours ago"), (86400, "1 day ago"), (2 * 86400, "2024-01-01 00:00")],
)
def test_age(spark, seconds, text):
    ts = dt.datetime(2024, 1, 1)
    assert one(spark, v.age_bucket(F.col("a"), F.col("b")), a=ts, b=ts + dt.timedelta(seconds=seconds)) == text


def test_display_value(spark):
    df = spark.sql(
        """SELECT named_struct('id', 7, 'name', '', 'label', 'L') AS blank_name, named_struct('k', array(1), 'x', 0) AS primitive,
                  named_struct('k', array(1)) AS json, array(named_struct('name', 'a'), NULL, named_struct('name', ''), named_struct('name', 'b')) AS list,
                  map('value', 'm', 'zz', 'n') AS table, map('zz', 'n') AS other, CAST(NULL AS STRING) AS none, named_struct('a', named_struct('b', 'deep')) AS dotted,
                  2.0D AS number"""
    )
    row = df.select(*[v.display_value(df, c, "a.b" if c == "dotted" else None).alias(c) for c in df.columns]).first()
    assert row.blank_name == "L"
    assert row.primitive == "0"
    assert row.json == '{"k":[1]}'
    assert row["list"] == 'a, {"name":""}, b'
    assert row["table"] == "m"
    assert row.other == "n"
    assert row.none == ""
    assert row.dotted == "deep"
    assert row.number == "2"


def test_small_expressions(spark):
    assert one(spark, v.split_values(F.col("s")), s=" a,b， a \n\nb,c ") == ["a", "b", "c"]
    assert one(spark, v.decode_flags(F.col("n"), {8: "copy", 16: "paste"}), n=24) == ["copy", "paste"]
    assert one(spark, v.decode_flags(F.col("n"), {8: "copy", 16: "paste"}), n=7) == []
    assert one(spark, v.blank_default(F.col("s")), s="") == "-"
    assert one(spark, v.actions_summary(F.col("l")), l=["Connect (all)", "Copy"]) == "Connect,Copy"
    assert one(spark, v.actions_summary(F.col("l")), l=list("abcdef")) == "All"
    assert one(spark, v.choice_label(F.col("s"), {"a": "A"}), s="z") == "z"
    assert one(spark, v.epoch_text(F.col("n")), n=86400) == "1970-01-02 00:00:00"


def test_redact_hides_named_fields_only(spark):
    row = v.redact(spark.createDataFrame([("u", "pw")], ["username", "password"])).first()
    assert row.username == "u" and len(row.password) == 64


def test_ip_groups(spark):
    df = spark.createDataFrame([("10.0.0.5",), ("10.0.0.16",), ("300.1.1.1",), ("x",), (None,)], ["ip"])
    inside = [r[0] for r in df.select(ip_in(F.col("ip"), ["10.0.0.0/28", "10.0.0.16-10.0.0.20"])).collect()]
    assert inside == [True, True, False, False, False]
    assert all(r[0] for r in df.select(ip_in(F.col("ip"), ["*"])).collect())
    assert df.select(ip_to_long(F.col("ip"))).first()[0] == 10 * 256**3 + 5
    assert merged([(5, 9), (1, 4), (20, 30), (25, 26)]) == [(1, 9), (20, 30)]


def test_days():
    assert [cal.normalize_days(x) for x in ("1", 7, "30", "12", None, "")] == [1, 7, 30, 7, 7, 7]
    assert cal.normalize_days("x", "30") == 30
    assert cal.day_window("2024-03-01", 2) == (dt.date(2024, 2, 29), dt.date(2024, 3, 2))


def test_week_period(spark):
    periods = [{"id": 0, "value": "22:00~00:00"}, {"id": 1, "value": "08:00~12:00、14:00~15:00"}]
    assert cal.parse_week_period(periods) == {0: [(1320, 1440)], 1: [(480, 720), (840, 900)]}
    stamps = ["2024-01-07 23:59:00", "2024-01-07 21:59:00", "2024-01-08 12:00:00", "2024-01-08 14:30:00", "2024-01-09 09:00:00"]
    df = spark.createDataFrame([(s,) for s in stamps], ["s"]).select(F.col("s").cast("timestamp_ntz").alias("ts"))
    assert [r[0] for r in df.select(cal.in_week_period(F.col("ts"), periods)).collect()] == [True, False, False, True, False]
    assert df.select(cal.in_week_period(F.col("ts"), [])).first()[0] is True
