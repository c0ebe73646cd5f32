"""Queries over scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.catalog.registry import query
from accesslake.functions import values as v
from accesslake.sources import adapters as a


@query(
    "display_value",
    """SELECT n.n_nationkey::BIGINT AS id, n.n_name AS nation, coalesce(r.r_name, '') AS region,
              n.n_name || ', ' || coalesce(r.r_name, '') AS both_names, n.n_nationkey::VARCHAR AS plain,
              n.n_regionkey::VARCHAR AS first_primitive
       FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
)
def display_value(t):
    joined = t.nation.join(t.region, t.nation.n_regionkey == t.region.r_regionkey, "left")
    shaped = joined.select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("nation"),
        F.struct(F.col("r_regionkey").alias("id"), F.lit("").alias("name"), F.col("r_name").alias("title")).alias("region"),
        F.array(F.struct(F.col("n_name").alias("name")), F.struct(F.col("r_name").alias("name"))).alias("both_names"),
        F.col("n_nationkey").alias("plain"),
        F.struct(F.array(F.lit(1)).alias("deep"), F.col("n_regionkey").alias("other")).alias("first_primitive"),
    )
    return shaped.select("id", *[v.display_value(shaped, c).alias(c) for c in shaped.columns if c != "id"])


# Fixed on the fixtures: labels of the order states.
ORDER_LABELS = {"F": "Finished", "O": "Open", "P": "Pending"}


@query(
    "choice_label",
    """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Pending'
              ELSE o_orderstatus END AS status FROM orders""",
)
def choice_label(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), v.choice_label(F.col("o_orderstatus"), ORDER_LABELS).alias("status"))


@query(
    "blank_to_dash",
    """SELECT p_partkey AS id, coalesce(nullif(CASE WHEN p_size > 25 THEN p_brand WHEN p_size > 20 THEN '' WHEN p_size > 10 THEN '  ' END, ''), '-')
              AS brand FROM part""",
)
def blank_to_dash(t):
    partly = F.when(F.col("p_size") > 25, F.col("p_brand")).when(F.col("p_size") > 20, F.lit("")).when(F.col("p_size") > 10, F.lit("  "))
    return t.part.select(F.col("p_partkey").alias("id"), v.blank_default(partly).alias("brand"))


@query(
    "duration_readable",
    """WITH d AS (SELECT o_orderkey AS session, epoch(l_shipdate) - epoch(o_orderdate) AS s
                  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
       SELECT session, CASE WHEN s > 86400 THEN printf('%.1f d', round(s / 86400, 1))
                            WHEN s > 3600 THEN printf('%.1f h', round(s / 3600, 1))
                            WHEN s > 60 THEN printf('%.1f m', round(s / 60, 1))
                            WHEN s >= 0 THEN printf('%.1f s', round(s, 1)) ELSE '' END AS duration FROM d""",
)
def duration_readable(t):
    s = a.session(t.orders, t.lineitem)
    return s.select(
        F.col("session_id").alias("session"), v.readable_duration(F.col("date_start"), F.col("date_end")).alias("duration")
    )


@query(
    "safe_date",
    """SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS slashed, strftime(ts, '%Y-%m-%d %H:%M:%S') AS zoned,
              strftime(ts, '%Y-%m-%d 00:00:00') AS day FROM events""",
)
def safe_date(t):
    layout = "yyyy-MM-dd HH:mm:ss"
    text = t.events.select(
        F.col("event_id").alias("id"),
        F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("slashed"),
        F.concat(F.date_format("ts", layout), F.lit(" +0800")).alias("zoned"),
        F.date_format("ts", "yyyy/MM/dd").alias("day"),
    )
    return text.select("id", *[F.date_format(v.safe_date(F.col(c)), layout).alias(c) for c in ("slashed", "zoned", "day")])


@query(
    "relative_age_bucket",
    """WITH d AS (SELECT event_id AS id, ts, (epoch_us(TIMESTAMP '2024-01-30 23:00:00') - epoch_us(ts)) / 1e6 AS s FROM events)
       SELECT id, CASE WHEN s < 30 THEN 'just now' WHEN s < 3600 THEN ceil(s / 60)::BIGINT || ' minutes ago'
                       WHEN s < 86400 THEN ceil(s / 3600)::BIGINT || ' hours ago' WHEN s < 172800 THEN '1 day ago'
                       ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS age FROM d""",
)
def relative_age_bucket(t):
    as_of = F.lit("2024-01-30 23:00:00").cast("timestamp_ntz")
    return t.events.select(F.col("event_id").alias("id"), v.age_bucket(F.col("ts"), as_of).alias("age"))


@query(
    "file_size",
    """SELECT doc_id AS id, CASE WHEN n = 0 THEN '0 Bytes' WHEN n < 1024 THEN n || ' Bytes'
              WHEN n < 1048576 THEN regexp_replace(round(n / 1024, 2)::VARCHAR, '\\.0$', '') || ' KB'
              ELSE regexp_replace(round(n / 1048576, 2)::VARCHAR, '\\.0$', '') || ' MB' END AS size
       FROM (SELECT doc_id, n_chars * (doc_id % 100) AS n FROM documents)""",
)
def file_size(t):
    n = F.col("n_chars") * (F.col("doc_id") % 100)
    return t.documents.select(F.col("doc_id").alias("id"), v.format_bytes(n).alias("size"))


@query(
    "truncate_text",
    """SELECT doc_id AS id, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS at_end,
              CASE WHEN length(text) > 41 THEN substr(text, 1, 19) || '...' || substr(text, 23, 19) ELSE text END AS at_center
       FROM documents""",
)
def truncate_text(t):
    text = F.col("text")
    return t.documents.select(
        F.col("doc_id").alias("id"), v.truncate_end(text, 40).alias("at_end"), v.truncate_center(text, 41).alias("at_center")
    )


@query(
    "epoch_to_ts",
    """SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events""",
)
def epoch_to_ts(t):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t.events.select(F.col("event_id").alias("id"), v.epoch_text(seconds).alias("shown"))


@query(
    "decode_flags",
    """SELECT l_orderkey AS id, l_linenumber * 4 AS flags, concat_ws(',', CASE WHEN (l_linenumber * 4) & 8 <> 0 THEN 'copy' END,
              CASE WHEN (l_linenumber * 4) & 16 <> 0 THEN 'paste' END) AS operations FROM lineitem""",
)
def decode_flags(t):
    flags = F.col("l_linenumber") * 4
    names = v.decode_flags(flags, {8: "copy", 16: "paste"})
    return t.lineitem.select(F.col("l_orderkey").alias("id"), flags.alias("flags"), F.array_join(names, ",").alias("operations"))


@query(
    "split_values",
    r"""WITH pieces AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[,，\n]')) AS piece,
                              generate_subscripts(regexp_split_to_array(text, '[,，\n]'), 1) AS pos FROM documents),
            kept AS (SELECT doc_id, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS value, pos FROM pieces),
            firsts AS (SELECT doc_id, value, min(pos) AS pos FROM kept WHERE value <> '' GROUP BY ALL)
       SELECT d.doc_id AS id, count(f.value) AS amount, coalesce(string_agg(f.value, '|' ORDER BY f.pos), '') AS items
       FROM documents d LEFT JOIN firsts f ON d.doc_id = f.doc_id GROUP BY d.doc_id""",
)
def split_values(t):
    shown = t.documents.select(F.col("doc_id").alias("id"), v.split_values(F.col("text")).alias("items"))
    return shown.select("id", F.size("items").cast("bigint").alias("amount"), F.array_join("items", "|").alias("items"))


@query(
    "label_string",
    """SELECT p_partkey AS id, 'brand:' || p_brand || ', type:' || p_type AS labels FROM part""",
)
def label_string(t):
    pair = F.array(v.label_text(F.lit("brand"), F.col("p_brand")), v.label_text(F.lit("type"), F.col("p_type")))
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(pair, ", ").alias("labels"))


@query(
    "permission_actions",
    """SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 6 WHEN 5 THEN 'All' WHEN 0 THEN 'connect'
              WHEN 1 THEN 'connect,upload' WHEN 2 THEN 'connect,upload,download' WHEN 3 THEN 'connect,upload,download,copy'
              ELSE 'connect,upload,download,copy,paste' END AS actions FROM nation""",
)
def permission_actions(t):
    labels = F.transform("actions", lambda x: F.concat(x, F.lit(" (protocols)")))
    return a.permissions(t.nation).select(F.col("permission").cast("bigint").alias("id"), v.actions_summary(labels).alias("actions"))


@query(
    "list_amount",
    """SELECT p_partkey AS id, (CASE WHEN p_size > 25 THEN 2 ELSE 3 END)::BIGINT AS amount, 2::BIGINT AS map_amount FROM part""",
)
def list_amount(t):
    shaped = t.part.select(
        F.col("p_partkey").alias("id"),
        F.array(F.lit("@SPEC"), "p_brand", "p_brand", F.when(F.col("p_size") > 25, F.lit("@SPEC")).otherwise(F.col("p_type"))).alias("l"),
        F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_type")).alias("m"),
    )
    return shaped.select(
        "id",
        v.list_amount(F.col("l"), shaped.schema["l"].dataType).cast("bigint").alias("amount"),
        v.list_amount(F.col("m"), shaped.schema["m"].dataType).cast("bigint").alias("map_amount"),
    )
