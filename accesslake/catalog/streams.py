"""Queries that run a stream over the event or document files to the end and return its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.catalog.registry import EVENTS_AS_OF, query
from accesslake.catalog.relations import ACCESS_RULES, ACCESS_SQL, ACL_TABLE_SQL, supplier_rules
from accesslake.session import shared_dir
from accesslake.sources import adapters as a
from accesslake.streaming import monitors as s


@query(
    "stream_log_tail",
    """SELECT doc_id AS line_id, source AS component, md5(text) AS message FROM documents
       WHERE source IN ('src0', 'src1', 'src2', 'src3') AND (contains(lower(text), 'the') OR contains(lower(text), 'la'))""",
)
def stream_log_tail(t):
    lines = a.component_log(s.table_stream(t.spark, t.folder, "documents"))
    tail = s.log_tail(lines, ["src0", "src1", "src2", "src3"], "the|la")
    return s.run_append(tail.select("line_id", "component", F.md5("message").alias("message")), "log-tail")


@query(
    "stream_online",
    """WITH u AS (SELECT user_id, sum(CASE WHEN event_type IN ('signup', 'view') THEN 1 WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 0 END) AS open,
                         count(*) FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-30') AS failed FROM events GROUP BY 1)
       SELECT sum(greatest(open, 0))::BIGINT AS online_sessions, count(*) FILTER (open > 0) AS online_users, sum(failed)::BIGINT AS failed_today FROM u""",
)
def stream_online(t):
    kind = F.col("event_type")
    today = (kind == "error") & (F.to_date("ts") == F.lit(EVENTS_AS_OF).cast("date"))
    events = s.table_stream(t.spark, t.folder, "events")
    state = s.online_state(events, "user_id", kind.isin("signup", "view"), kind.isin("purchase", "error"), today)
    return s.online_card(s.run_update(state, ["user_id"], "online"))


@query(
    "stream_daily",
    """SELECT ts::DATE::VARCHAR AS date, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failure
       FROM events GROUP BY 1""",
)
def stream_daily(t):
    events = s.table_stream(t.spark, t.folder, "events")
    daily = s.daily_logins(events, "ts", F.col("event_type") != "error")
    return s.run_update(daily, ["date"], "daily").withColumn("date", F.col("date").cast("string"))


@query(
    "stream_acl",
    f"""WITH e AS (SELECT event_id AS id, user_id, event_type, json_extract_string(props, '$.k')::BIGINT AS resource FROM events),
             w AS (SELECT *, {ACCESS_SQL} AS rule FROM e)
        SELECT id, rule, CASE rule WHEN 1 THEN 'accept' WHEN 2 THEN 'reject' WHEN 3 THEN 'review' WHEN 4 THEN 'warn' END AS action FROM w""",
)
def stream_acl(t):
    events = s.table_stream(t.spark, t.folder, "events").select(
        F.col("event_id").alias("id"), "user_id", "event_type", a.props_key(F.col("props")).alias("resource")
    )
    decided = s.acl_stream(events, ACCESS_RULES, "user_id", asset_key="resource", account="event_type")
    return s.run_append(decided.select("id", "rule", "action"), "acl")


@query("stream_acl_table", ACL_TABLE_SQL)
def stream_acl_table(t):
    """The rules in tables of the shared folder, which every micro-batch reads again."""
    folder = shared_dir(t.spark, "acl-table")
    rules, scopes = supplier_rules(t)
    schemas = {f"{folder}/rules": rules.schema, **{f"{folder}/{n}": scope.schema for n, scope in scopes.items()}}
    for path, frame in zip(schemas, [rules, *scopes.values()]):
        frame.write.parquet(path)

    def read_rules(spark):
        first, *rest = [spark.read.schema(schema).parquet(path) for path, schema in schemas.items()]
        return first, dict(zip(scopes, rest))

    events = s.table_stream(t.spark, t.folder, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    s.start_ruled(events, "id", read_rules, folder).awaitTermination()
    decided = s.decisions(t.spark, folder, "id bigint, rule bigint, priority int, action string")
    return decided.select("id", "rule", "priority", "action")


@query(
    "stream_session_pairs",
    """WITH o AS (SELECT event_id // 2 AS session, user_id, ts AS opened FROM events WHERE event_id % 2 = 0),
            c AS (SELECT event_id // 2 AS session, ts AS closed FROM events WHERE event_id % 2 = 1),
            w AS (SELECT date_trunc('milliseconds', least((SELECT max(opened) FROM o), (SELECT max(closed) FROM c))) - INTERVAL 1 HOUR AS mark)
       SELECT session, user_id, CASE WHEN closed IS NOT NULL THEN 'closed' WHEN opened + INTERVAL 10 DAY < mark THEN 'lapsed' ELSE 'online' END AS state,
              strftime(closed, '%Y-%m-%d %H:%M:%S.%f') AS closed
       FROM o LEFT JOIN c USING (session) CROSS JOIN w WHERE closed IS NULL OR closed BETWEEN opened AND opened + INTERVAL 10 DAY
       UNION ALL
       SELECT session, user_id, CASE WHEN opened + INTERVAL 10 DAY < mark THEN 'lapsed' ELSE 'online' END, NULL
       FROM o JOIN c USING (session) CROSS JOIN w WHERE closed NOT BETWEEN opened AND opened + INTERVAL 10 DAY""",
)
def stream_session_pairs(t):
    """Two neighbouring events are a session's open and close; each session is closed, lapsed after ten days or online."""
    number, opens, closes = F.floor(F.col("event_id") / 2), F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1

    def opened(events):
        return events.where(opens).select(number.alias("session"), "user_id", F.col("ts").cast("timestamp").alias("opened"))

    ended = s.table_stream(t.spark, t.folder, "events").where(closes).select(number.alias("session"), F.col("ts").alias("closed"))
    pairs = s.session_pairs(opened(s.table_stream(t.spark, t.folder, "events")), ended, "session", "opened", "closed", "10 days")
    states = s.session_states(opened(t.events), s.run_append(pairs, "pairs"), "session", "opened", "closed")
    return states.select("session", "user_id", "state", F.date_format("closed", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("closed"))


SESSION_SQL = """
    g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g),
    s AS (SELECT user_id, min(ts) AS b, max(ts) AS e, count(*) AS events FROM n GROUP BY user_id, session)
"""


@query(
    "stream_sessionize",
    f"""WITH {SESSION_SQL} SELECT user_id, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(e, '%Y-%m-%d %H:%M:%S.%f') AS "end", events FROM s
        WHERE e + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR""",
)
def stream_sessionize(t):
    """Sessions closed by the watermark, which ends an hour before the newest event."""
    events = s.table_stream(t.spark, t.folder, "events")
    closed = s.run_append(s.sessions_stream(events, "user_id", "ts"), "sessions")
    layout = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return closed.select(
        "user_id", F.date_format("start", layout).alias("start"), F.date_format("end", layout).alias("end"), "events"
    )


@query(
    "sessionize",
    f"""WITH {SESSION_SQL} SELECT user_id, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(e, '%Y-%m-%d %H:%M:%S.%f') AS "end", events,
        (epoch_us(e) - epoch_us(b)) / 1000000 AS duration FROM s""",
)
def sessionize(t):
    """The same sessions over the finished log, the last ones included."""
    layout = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    found = s.sessions_batch(t.events, "user_id", "ts")
    return found.select(
        "user_id", F.date_format("start", layout).alias("start"), F.date_format("end", layout).alias("end"), "events", "duration"
    )
