"""Queries over rules, networks and patterns that are tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.catalog.registry import query
from accesslake.functions.network import dotted_quad
from accesslake.operators import patterns, rule_tables
from accesslake.sources import adapters as a


@query(
    "match_ip_ranges",
    """WITH g AS (SELECT s_suppkey AS "group", s_suppkey * 13 + 1 AS low, s_suppkey * 13 + 1 + s_nationkey * 3 AS high, s_suppkey % 50 = 7 AS every FROM supplier)
       SELECT p_partkey AS id, "group" FROM part JOIN g ON every OR p_partkey BETWEEN low AND high""",
)
def match_ip_ranges(t):
    """Assets and the address groups they belong to: a range of addresses a supplier, and ``*`` for a few."""
    low = F.col("s_suppkey") * 13 + 1
    span = F.concat(dotted_quad(low), F.lit(" - "), dotted_quad(low + F.col("s_nationkey") * 3))
    groups = t.supplier.select(F.col("s_suppkey").alias("group"), F.when(F.col("s_suppkey") % 50 == 7, "*").otherwise(span).alias("network"))
    return rule_tables.match_networks(a.asset(t.part).select("id", "address"), "address", groups).select("id", "group")


@query(
    "login_acl_table",
    """WITH r AS (SELECT s_suppkey AS rule, 1 + s_suppkey % 40 AS priority, CASE s_nationkey % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'review' ELSE 'accept' END AS action,
                         s_suppkey % 4 <> 3 AS by_user, s_suppkey % 3 = 0 AS by_place, s_suppkey % 5 <> 0 AS by_time, s_suppkey % 7 AS day, s_suppkey % 11 AS hour FROM supplier),
            u AS (SELECT DISTINCT l_suppkey AS rule, o_custkey AS user_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey % 4 <> 3),
            e AS (SELECT event_id, user_id, dayofweek(ts) AS day, hour(ts) * 60 + minute(ts) AS minute FROM events),
            m AS (SELECT event_id, r.priority, r.rule, r.action FROM e JOIN r ON
                    (NOT by_place OR user_id BETWEEN rule * 2 AND rule * 2 + 40)
                    AND (NOT by_time OR (e.day = r.day AND minute >= r.hour * 60 + 30 AND minute < r.hour * 60 + 540) OR (e.day = (r.day + 3) % 7 AND minute >= 1200))
                    AND (NOT by_user OR EXISTS (SELECT 1 FROM u WHERE u.rule = r.rule AND u.user_id = e.user_id))),
            b AS (SELECT event_id, min({'p': priority, 'r': rule, 'a': action}) AS best FROM m GROUP BY 1)
       SELECT event_id AS id, best.r AS rule, best.p::INT AS priority, best.a AS action FROM events LEFT JOIN b USING (event_id)""",
)
def login_acl_table(t):
    """Login rules as rows: one a supplier, by the users it sold to, a range of addresses and two periods of the week."""
    key = F.col("s_suppkey")
    action = F.when(F.col("s_nationkey") % 3 == 0, "reject").when(F.col("s_nationkey") % 3 == 1, "review").otherwise("accept")
    login_rules = t.supplier.select(key.alias("rule"), (1 + key % 40).cast("int").alias("priority"), action.alias("action"))
    sold = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).where("l_suppkey % 4 <> 3")
    users = sold.select(F.col("l_suppkey").alias("rule"), F.col("o_custkey").alias("value")).distinct()
    networks = t.supplier.where("s_suppkey % 3 = 0").select(key.alias("rule"), F.concat(dotted_quad(key * 2), F.lit("-"), dotted_quad(key * 2 + 40)).alias("network"))
    timed = t.supplier.where("s_suppkey % 5 <> 0")
    day, hour = (key % 7).cast("int"), key % 11
    at = lambda h: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":30"))
    periods = timed.select(key.alias("rule"), day.alias("weekday"), at(hour).alias("begin"), F.concat(F.lpad((hour + 9).cast("string"), 2, "0"), F.lit(":00")).alias("finish"))
    periods = periods.union(timed.select(key, (day + 3) % 7, F.lit("20:00"), F.lit("00:00")))
    decided = rule_tables.login_acl_table(a.login_log(t.events), "user_id", "remote_addr", "datetime", login_rules, users, networks, periods)
    return decided.select("id", "rule", "priority", "action")


PATTERN_SQL = r"""
    w AS (SELECT conv_id, regexp_extract_all(text, '[A-Za-z]{4,}') AS words FROM conversations WHERE turn = 0),
    g AS (SELECT conv_id AS "group", conv_id % 3 = 2 AS wild, conv_id % 2 = 0 AS folded, words[1] AS one, words[2] AS two FROM w WHERE len(words) > 1)
"""


@query(
    "command_filter_table",
    rf"""WITH {PATTERN_SQL},
            p AS (SELECT "group", CASE WHEN folded THEN '(?i)' ELSE '' END || unnest(CASE WHEN wild THEN [one || '.*' || two]
                    ELSE ['[^0-9A-Za-z_]' || one || '[^0-9A-Za-z_]', '[^0-9A-Za-z_]' || two || '-x[^0-9A-Za-z_]'] END) AS regex, wild FROM g)
         SELECT DISTINCT conv_id AS session, turn::BIGINT AS turn, "group" FROM conversations JOIN p ON regexp_matches(CASE WHEN wild THEN text ELSE ' ' || text || ' ' END, regex)""",
)
def command_filter_table(t):
    """Command groups as rows, one a conversation: its first words of four letters or more as commands, or as a regular expression."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))
    named = t.conversations.where("turn = 0").select(F.col("conv_id").alias("group"), words.alias("words")).where(F.size("words") > 1)
    one, two, wild = F.get("words", F.lit(0)), F.get("words", F.lit(1)), F.col("group") % 3 == 2  # a test may be made before the size is
    content = F.when(wild, F.concat(one, F.lit(".*"), two)).otherwise(F.concat(one, F.lit("\r\n"), two, F.lit("-x\n \n")))
    groups = named.select("group", F.when(wild, "regex").otherwise("command").alias("type"), content.alias("content"), (F.col("group") % 2 == 0).alias("ignore_case"))
    hits = patterns.match_command_table(a.command_log(t.conversations), ["session", "turn"], "input", groups)
    return hits.select("session", F.col("turn").cast("bigint").alias("turn"), "group")
