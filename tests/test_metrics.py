from pyspark.sql import functions as F

from accesslake.operators import metrics as m
from accesslake.operators import ranking as k
from accesslake.plans import reports


def test_share_is_floored_and_ratio_rounded(spark):
    row = spark.range(1).select(
        m.floor_share(F.lit(2), F.lit(3)).alias("floor"), m.ratio(F.lit(2), F.lit(3)).alias("round"), m.ratio(F.lit(0), F.lit(0)).alias("none")
    ).first()
    assert (row["floor"], row["round"], row["none"]) == (66.66, 66.67, 0.0)
    pair = spark.range(1).select(*m.ratio_pair(F.lit(1), F.lit(3), "a", "b")).first()
    assert (pair.a, pair.b) == (33.33, 66.67)


def test_exact_hundredths_are_not_floored_down(spark):
    df = spark.range(1).select(m.floor_share(F.lit(29), F.lit(100)).alias("x"), m.floor_share(F.lit(57), F.lit(100)).alias("y")).first()
    assert (df.x, df.y) == (29.0, 57.0)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "s string, ts timestamp_ntz, status string, error string, state string")
    assert [tuple(r) for r in m.distribution_or_nothing(none, "s").collect()] == [("Nothing", 0)]
    series = m.daily(none, "ts", "2024-01-02", 3, {"n": F.count("*")}).orderBy("date").collect()
    assert [(str(r.date), r.n) for r in series] == [("2023-12-31", 0), ("2024-01-01", 0), ("2024-01-02", 0)]
    summary = m.import_summary(none).first()
    assert (summary.total, summary.processed_percent) == (0, 0)
    assert [r.key for r in m.bulk_result_counts(none).collect()] == ["total"]
    assert m.counters(none, {"n": F.lit(True)}).first().n == 0


def test_error_outranks_state(spark):
    rows = spark.createDataFrame([("", "created"), ("bad", "created"), (None, "skipped"), ("", None)], ["error", "state"])
    assert [(r.key, r.value) for r in m.bulk_result_counts(rows).orderBy("position").collect()] == [
        ("total", 4), ("created", 1), ("skipped", 1), ("error", 1),
    ]


def test_zero_face_vector_is_hidden(spark):
    row = spark.createDataFrame([(3, 0)], ["total", "face_vector"])
    assert [r.metric for r in m.metric_rows(row, ("face_vector",)).collect()] == ["total"]
    assert m.metric_rows(row.replace(0, 1), ("face_vector",)).count() == 2


def test_cards_keep_empty_and_repeat_shared_components(spark):
    lines = spark.createDataFrame([("a", 1), ("b", 2), ("x", 3)], ["component", "line"])
    got = {(r.card, r.line, r.log_count) for r in m.log_cards(lines, {"c": ["a", "b"], "d": ["b"], "e": ["q"]}).collect()}
    assert got == {("c", 1, 2), ("c", 2, 2), ("d", 2, 1), ("e", None, 0)}


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(2,), (1,), (3,), (3,)], ["u"])
    assert [(r.rank, r.u, r.total) for r in k.top_k(df, "u", F.count("*"), 2).orderBy("rank").collect()] == [(1, 3, 2), (2, 1, 1)]


def test_numbering_with_one_hot_group_and_equal_times(spark):
    """A third and more of the rows in one group, most of them at the same instants."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
        F.timestamp_add("HOUR", ((F.col("id") * 7919) % 5 * 7).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
        ((F.col("id") * 104729) % 3001).alias("tie"),
    )
    from pyspark.sql import Window

    plain = df.withColumn("v", F.row_number().over(Window.partitionBy("g").orderBy("ts", "tie")).cast("bigint"))
    for bucket, width in (("MINUTE", None), ("DAY", 64), ("MONTH", 16)):
        numbered = k.number_within(df, "g", "ts", "tie", "v", bucket, width).select(*plain.columns)
        assert numbered.exceptAll(plain).isEmpty() and numbered.count() == 3000


def test_merge_slots(spark):
    df = spark.createDataFrame([("a", h) for h in (0, 1, 2, 5, 23, 2)] + [("b", 7)], ["k", "h"])
    got = {(r.k, r.begin, r.end) for r in k.merge_slots(df, ["k"], "h").collect()}
    assert got == {("a", 0, 3), ("a", 5, 6), ("a", 23, 24), ("b", 7, 8)}


def test_report_names():
    report = {"a": 1, "b": 2}
    assert reports.names_of(" a, ,b ") == ["a", "b"] and reports.names_of(None) == []
    assert reports.select_tables(report, "b") == {"b": 2} and reports.select_tables(report, "") == report


def test_long_form_fills_missing_with_zero(spark):
    df = spark.createDataFrame([("r", None, 2)], "k string, a int, b int")
    assert {(r.column, r.value) for r in reports.long_form({"t": df}).collect()} == {("a", "0"), ("b", "2")}


def test_partition_count_does_not_matter(spark, tables):
    from accesslake.catalog.registry import EVENTS_AS_OF

    def run(events):
        rows = m.active_per_day(events, "ts", "user_id", "event_type", EVENTS_AS_OF, 30).collect()
        return sorted(tuple(r) for r in rows)

    assert run(tables.events) == run(tables.events.repartition(13)) == run(tables.events.coalesce(1))
