"""Structured Streaming monitors over the event log.

The transformations are ordinary operators. Results land in tables in the shared folder, so nothing passes through the
driver and a lost executor or a restart only replays from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StreamingQuery

from accesslake.functions.values import all_of, seconds_between
from accesslake.operators.predicates import search_batches
from accesslake.operators.rule_tables import evaluate_table
from accesslake.operators.rules import evaluate
from accesslake.session import shared_dir
from accesslake.sources.tables import SCHEMAS


def table_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream, with the explicit schema. Wall-clock columns become TIMESTAMP for watermarks.

    The table is one file, a directory of files, or several of either named ``table-*``.
    """
    reader = spark.readStream.schema(SCHEMAS[table])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(f"{folder}/{table}{{,-*}}.parquet")
    ntz = [f.name for f in stream.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in ntz})


def start_append(stream: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Starts a query that appends to ``folder/table`` (exactly once per row); ``trigger`` is Spark's, say ``processingTime``.

    Started again with the same folder it goes on from its checkpoint.
    """
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def start_update(stream: DataFrame, keys: list[str], folder: str, **trigger) -> StreamingQuery:
    """Starts a query in update mode that keeps the newest row per key under ``folder/table``.

    Every micro-batch writes the whole state as a version of its own and drops all versions but the one it started from,
    so storage is bounded by two states. A replayed batch starts from the same version and leaves the same rows.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        older = [v for v in state_versions(spark, folder) if v < batch]
        rows.persist()
        state = rows
        if older:
            seen = rows.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
            same = all_of([F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
            state = rows.unionByName(spark.read.schema(rows.schema).parquet(_version(folder, older[-1])).join(seen, same, "left_anti"))
        state.write.mode("overwrite").parquet(_version(folder, batch))
        rows.unpersist()
        for version in older[:-1]:
            path, store = _store(spark, _version(folder, version))
            store.delete(path, True)

    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.outputMode("update").trigger(**(trigger or {"availableNow": True})).start()


def _version(folder: str, batch: int) -> str:
    return f"{folder}/table/version-{batch}"


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def state_versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions of an updated table, oldest first."""
    path, store = _store(spark, f"{folder}/table")
    if not store.exists(path):
        return []
    names = [(f.getPath().getName(), f.getPath()) for f in store.listStatus(path)]
    return sorted(int(n.partition("-")[2]) for n, p in names if n.startswith("version-") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def newest_state(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The newest complete version of an updated table; empty before the first."""
    versions = state_versions(spark, folder)
    return spark.read.schema(schema).parquet(_version(folder, versions[-1])) if versions else spark.createDataFrame([], schema)


def run_append(stream: DataFrame, purpose: str) -> DataFrame:
    """Runs over what is available and returns the table written."""
    folder = shared_dir(stream.sparkSession, purpose)
    start_append(stream, folder).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def run_update(stream: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """Runs in update mode over what is available and returns the newest row per key."""
    folder = shared_dir(stream.sparkSession, purpose)
    start_update(stream, keys, folder).awaitTermination()
    return newest_state(stream.sparkSession, folder, stream.schema)


def log_tail(lines: DataFrame, components: list[str], search: str = "", component: str = "component", message: str = "message") -> DataFrame:
    """Live lines of the chosen components (all when none is chosen) that match the search."""
    kept = lines.where(F.col(component).isin(*components)) if components else lines
    return kept.where(search_batches(search, [message])) if search.strip() else kept


def online_state(events: DataFrame, user: str, opens: Column, closes: Column, failed_today: Column) -> DataFrame:
    """Open sessions and today's failures per user; the state is one row per user."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    return events.groupBy(user).agg(F.sum(step).alias("open"), F.count_if(failed_today).alias("failed"))


def online_card(state: DataFrame) -> DataFrame:
    """Online sessions, online users, and failed sessions of the day, from the per-user state."""
    return state.agg(
        F.coalesce(F.sum(F.greatest("open", F.lit(0))), F.lit(0)).alias("online_sessions"),
        F.count_if(F.col("open") > 0).alias("online_users"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_today"),
    )


def daily_logins(events: DataFrame, ts: str, success: Column, lateness: str = "1 hour") -> DataFrame:
    """Success and failure per day, kept current; rows later than the watermark are dropped."""
    day = F.window(ts, "1 day")
    return (
        events.withWatermark(ts, lateness)
        .groupBy(day.alias("w"))
        .agg(F.count_if(success).alias("success"), F.count_if(~success).alias("failure"))
        .select(F.to_date("w.start").alias("date"), "success", "failure")
    )


def acl_stream(events: DataFrame, rules: list[dict], user_key: str, **scopes: str) -> DataFrame:
    """Winning rule per event. Rules are compiled into the row, so the stream keeps no state and needs no join."""
    return evaluate(events, rules, user_key, **scopes)


def start_ruled(events: DataFrame, key: str, read_rules: Callable[[SparkSession], tuple[DataFrame, dict[str, DataFrame]]], folder: str, **trigger) -> StreamingQuery:
    """Starts a query that appends every event with its winning rule to ``folder/table``; the rules are a table.

    ``read_rules`` gives the rules and scopes of ``rule_tables.evaluate_table`` and is called anew for each micro-batch, so a rule
    added in between counts from the next batch on. A micro-batch owns the folder ``batch=n`` and a replay overwrites it,
    so no event is decided twice in the table; a replayed batch takes the rules as they are by then.
    """

    def decide(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            decided = evaluate_table(rows, key, *read_rules(rows.sparkSession))
            decided.write.mode("overwrite").parquet(f"{folder}/table/batch={batch}")
        finally:
            rows.unpersist()

    writer = events.writeStream.foreachBatch(decide).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def decisions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The events decided so far, with the number of the micro-batch; empty before the first."""
    path, store = _store(spark, f"{folder}/table")
    schema = f"{schema}, batch bigint"
    return spark.read.schema(schema).parquet(f"{folder}/table") if store.exists(path) else spark.createDataFrame([], schema)


def session_pairs(opens: DataFrame, closes: DataFrame, session: str, opened: str, closed: str, longest: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Every session once: with its close when that arrives, or with none when ``longest`` has passed without one.

    ``opens`` has ``session``, ``opened`` and any other columns, ``closes`` ``session`` and ``closed``; a close counts if it lies
    between the open and ``longest`` later. Both wait for each other in state that the watermark clears, so what is kept is the
    sessions of the last ``longest`` and ``lateness``, not all users ever seen. The result is only appended to: nothing is
    rewritten. Rows without id or time take no part, nor do rows later than the watermark; a row delivered again within
    the lateness counts once.
    """
    known = opens.where(F.col(session).isNotNull() & F.col(opened).isNotNull())
    left = known.withWatermark(opened, lateness).dropDuplicatesWithinWatermark([session])
    ended = closes.where(F.col(session).isNotNull() & F.col(closed).isNotNull()).select(F.col(session).alias("_session"), closed)
    right = ended.withWatermark(closed, lateness).dropDuplicatesWithinWatermark(["_session"])
    inside = (F.col(closed) >= F.col(opened)) & (F.col(closed) <= F.col(opened) + F.expr(f"INTERVAL {longest}"))
    return left.join(right, (F.col(session) == F.col("_session")) & inside, "left").drop("_session")


def session_states(opens: DataFrame, pairs: DataFrame, session: str, opened: str, closed: str) -> DataFrame:
    """Adds ``state`` to every open: closed, lapsed (its time is over) or online, by the table that ``session_pairs`` wrote.

    For a live card ``opens`` is read from the days that ``longest`` reaches back to; older sessions are not online.
    """
    ended = pairs.select(F.col(session).alias("_session"), F.when(F.col(closed).isNull(), "lapsed").otherwise("closed").alias("_state"), closed)
    joined = opens.join(ended, F.col(session) == F.col("_session"), "left")
    return joined.withColumn("state", F.coalesce("_state", F.lit("online"))).drop("_session", "_state")


def sessions_stream(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Closed sessions: events of a user less than the gap apart. A session is emitted once the watermark passes it."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(user, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("events"), F.max(ts).alias("last"))
        .select(user, F.col("w.start").alias("start"), F.col("last").alias("end"), "events")
    )


def sessions_batch(events: DataFrame, user: str, ts: str, gap_seconds: int = 1800) -> DataFrame:
    """The same sessions over a finished log.

    Two events in one slot of the gap's length always share a session, so rows are first reduced to one per user and
    slot. What is ordered per user afterwards is bounded by the number of slots, however busy the user is.
    """
    slot = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / gap_seconds)
    slots = events.groupBy(user, slot.alias("_slot")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count("*").alias("_n")
    )
    order = Window.partitionBy(user).orderBy("_slot")
    idle = seconds_between(F.lag("_last").over(order), F.col("_first"))
    starts = slots.withColumn("_new", F.when(idle.isNull() | (idle >= gap_seconds), 1).otherwise(0))
    numbered = starts.withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "_session").agg(
        F.min("_first").alias("start"), F.max("_last").alias("end"), F.sum("_n").alias("events")
    ).drop("_session").withColumn("duration", seconds_between(F.col("start"), F.col("end")))
