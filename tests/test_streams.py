"""Streams over several files agree with the batch, late rows are dropped, replays change nothing."""

import pytest
from pyspark.sql import functions as F

from accesslake.streaming import monitors as s


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")
    bounds = ["2024-01-01", "2024-01-10", "2024-01-20", "2024-02-01"]
    for n, (low, high) in enumerate(zip(bounds, bounds[1:])):
        rows = tables.events.where((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz")))
        rows.coalesce(1).write.parquet(str(base / "parts" / str(n)))
        file = next((base / "parts" / str(n)).glob("part-*.parquet"))
        (base / f"events-{n}.parquet").write_bytes(file.read_bytes())
    return str(base)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_daily_over_micro_batches_equals_batch(spark, tables, folder):
    stream = s.table_stream(spark, folder, "events", files_per_trigger=1)
    got = s.run_update(s.daily_logins(stream, "ts", F.col("event_type") != "error"), ["date"], "test-daily")
    ok = F.col("event_type") != "error"
    want = tables.events.groupBy(F.to_date("ts").alias("date")).agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failure"))
    assert rows_of(got) == rows_of(want)


def test_sessions_over_micro_batches_equal_closed_batch_sessions(spark, tables, folder):
    stream = s.table_stream(spark, folder, "events", files_per_trigger=1)
    got = s.run_append(s.sessions_stream(stream, "user_id", "ts"), "test-sessions")
    newest = tables.events.agg(F.max(F.col("ts").cast("timestamp")).alias("m")).select(F.col("m") - F.expr("INTERVAL 1 HOUR 30 MINUTES")).scalar()
    batch = s.sessions_batch(tables.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")
    want = batch.where(F.col("end") <= newest).select("user_id", "start", "end", "events")
    assert rows_of(got) == rows_of(want)


def test_sessions_split_at_the_gap(spark):
    times = ["10:00:00", "10:29:59", "10:59:58", "11:29:58", "12:30:00"]
    df = spark.createDataFrame([("u", f"2024-01-01 {x}") for x in times], ["u", "t"]).select("u", F.col("t").cast("timestamp").alias("ts"))
    got = [(str(r.start)[11:], str(r.end)[11:], r.events) for r in s.sessions_batch(df, "u", "ts").orderBy("start").collect()]
    assert got == [("10:00:00", "10:59:58", 3), ("11:29:58", "11:29:58", 1), ("12:30:00", "12:30:00", 1)]


def test_log_tail_without_choice_keeps_all(spark, tables):
    lines = tables.documents.select(F.col("source").alias("component"), F.col("text").alias("message"))
    assert s.log_tail(lines, []).count() == lines.count()
    assert s.log_tail(lines, ["src0"], "zzzz-nothing").count() == 0


def test_online_state_over_micro_batches(spark, tables, folder):
    kind = F.col("event_type")
    args = ("user_id", kind == "signup", kind == "error", kind == "error")
    stream = s.table_stream(spark, folder, "events", files_per_trigger=1)
    got = s.run_update(s.online_state(stream, *args), ["user_id"], "test-online")
    assert rows_of(got) == rows_of(s.online_state(tables.events, *args))
    assert s.online_card(got).first().failed_today == tables.events.where(kind == "error").count()


def test_a_table_may_be_a_directory(spark, tables, tmp_path):
    tables.events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = s.table_stream(spark, str(tmp_path), "events", files_per_trigger=1)
    assert s.run_append(stream.select("event_id"), "test-directory").count() == tables.events.count()


def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k long, n long"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    put([(1, 1), (2, 1)])
    for rows in ([(1, 2)], [(3, 5), (None, 1)], [(1, 3), (None, 2)], []):
        s.start_append(stream(), folder + "/append").awaitTermination()
        counted = stream().groupBy("k").agg(F.sum("n").alias("n"))
        query = s.start_update(counted, ["k"], folder + "/update", availableNow=True)
        query.awaitTermination()
        assert len(s.state_versions(spark, folder + "/update")) <= 2
        if rows:
            put(rows)
    everything = spark.read.schema(schema).parquet(source)
    assert sorted(map(str, spark.read.schema(schema).parquet(folder + "/append/table").collect())) == sorted(map(str, everything.collect()))
    state = {r.k: r.n for r in s.newest_state(spark, folder + "/update", counted.schema).collect()}
    assert state == {1: 6, 2: 1, 3: 5, None: 3}


def test_rules_added_between_batches_apply_and_replays_leave_no_duplicates(spark, tmp_path):
    source, folder, rules_at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "rules")
    schema = "id long, user_id long"

    def put(*ids):
        spark.createDataFrame([(i, i % 2) for i in ids], schema).coalesce(1).write.mode("append").parquet(source)

    def rule(number, priority, user):
        spark.createDataFrame([(number, priority, "reject", user)], "rule long, priority int, action string, value long").write.mode("append").parquet(rules_at)

    def read_rules(session):
        rows = session.read.parquet(rules_at)
        return rows.select("rule", "priority", "action"), {"user_id": rows.select("rule", "value")}

    def run():
        s.start_ruled(spark.readStream.schema(schema).parquet(source), "id", read_rules, folder).awaitTermination()
        found = s.decisions(spark, folder, "id long, user_id long, rule long, priority int, action string")
        return sorted((r.id, r.rule) for r in found.collect())

    assert s.decisions(spark, folder, schema).count() == 0
    rule(1, 50, 1)
    put(1, 2)
    assert run() == [(1, 1), (2, None)]
    rule(2, 10, 1)
    put(3, 4)
    assert run() == [(1, 1), (2, None), (3, 2), (4, None)]
    (tmp_path / "out" / "checkpoint" / "commits" / "1").unlink()
    (tmp_path / "out" / "checkpoint" / "commits" / ".1.crc").unlink()
    assert run() == [(1, 1), (2, None), (3, 2), (4, None)]


def test_session_pairs_over_restarts_equal_the_batch(spark, tmp_path):
    places = [str(tmp_path / n) for n in ("opens", "closes")]
    schemas = ["session long, user string, opened timestamp", "session long, closed timestamp"]
    folder = str(tmp_path / "out")

    def put(n, rows):
        frame = spark.createDataFrame(rows, schemas[n].replace("timestamp", "string"))
        frame.select(*[F.col(c).cast("timestamp") if c in ("opened", "closed") else F.col(c) for c in frame.columns]).coalesce(1).write.mode("append").parquet(places[n])

    def run():
        opens, closes = [spark.readStream.schema(schema).parquet(place) for schema, place in zip(schemas, places)]
        pairs = s.session_pairs(opens, closes, "session", "opened", "closed", "2 hours")
        s.start_append(pairs, folder).awaitTermination()
        table = spark.read.schema(pairs.schema).parquet(folder + "/table")
        states = s.session_states(spark.read.schema(schemas[0]).parquet(places[0]), table, "session", "opened", "closed")
        return sorted({(r.session, r.state) for r in states.where("session is not null").collect()}), table.count()

    day = "2024-01-01 "
    put(0, [(1, "a", day + "08:00:00"), (2, "a", day + "08:30:00"), (3, "b", day + "08:40:00"), (1, "a", day + "08:00:00"), (None, "c", day + "08:00:00")])
    put(1, [(1, day + "09:00:00"), (9, day + "09:00:00"), (None, day + "08:10:00")])
    assert run() == ([(1, "closed"), (2, "online"), (3, "online")], 1)
    put(0, [(4, "b", day + "09:10:00"), (9, "b", day + "09:30:00")])
    put(1, [(2, day + "10:30:00"), (4, day + "09:05:00")])
    assert run() == ([(1, "closed"), (2, "closed"), (3, "online"), (4, "online"), (9, "online")], 2)
    put(0, [(5, "c", day + "20:00:00")])
    put(1, [(5, day + "20:30:00")])
    assert run() == ([(1, "closed"), (2, "closed"), (3, "lapsed"), (4, "lapsed"), (5, "closed"), (9, "lapsed")], 6)
