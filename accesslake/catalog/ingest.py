"""Queries over listings, imports, exports and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.catalog.registry import EVENTS_AS_OF, query
from accesslake.functions.values import redact
from accesslake.operators import predicates as p
from accesslake.session import shared_dir
from accesslake.sources import adapters as a
from accesslake.sources import days as d
from accesslake.sources import ingest as i

USER_META = {
    "id": {"write_only": True},
    "username": {"primary": True, "label": "Username"},
    "balance": {"order": 1},
    "is_active": {"order": 0},
}


@query(
    "list_scan",
    "SELECT c_name AS username, c_acctbal >= 0 AS is_active, c_acctbal AS balance, c_mktsegment AS source FROM customer",
)
def list_scan(t):
    return i.listing(a.user(t.customer), USER_META, exclude=("org",))


def upload(t):
    """An upload as text: some prices read ``n/a`` and some dates are cut short."""
    price, day = F.col("o_totalprice").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(price).alias("price"),
        F.when(F.col("o_orderstatus") == "P", F.concat(day, F.lit("x"))).otherwise(day).alias("day"),
        F.col("o_orderstatus").alias("state"),
    )


@query(
    "import_validate",
    """WITH e AS (SELECT o_orderkey::VARCHAR AS id, concat_ws('; ', CASE WHEN o_orderpriority = '5-LOW' THEN 'price: not a valid double' END,
                         CASE WHEN o_orderstatus = 'P' THEN 'day: not a valid date' END,
                         CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'state: unknown choice' END) AS errors FROM orders)
       SELECT id, CASE WHEN errors = '' THEN 'ok' ELSE 'error' END AS status, errors FROM e""",
)
def import_validate(t):
    checked = i.validate_import(
        upload(t), {"id": "bigint", "price": "double", "day": "date"}, {"state": (F.col("state").isin("F", "O"), "unknown choice")}
    )
    return checked.select("id", "status", F.array_join("errors", "; ").alias("errors"))


@query(
    "import_create",
    """SELECT c_custkey AS id, c_name AS name FROM customer
       UNION ALL SELECT s_suppkey * 20, s_name FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)""",
)
def import_create(t):
    target = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    batch = t.supplier.select((F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("name"))
    return i.append_new(target, batch, "id")


@query(
    "import_update",
    """SELECT c_custkey AS id, c_name AS name, CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS balance
       FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey * 3""",
)
def import_update(t):
    target = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    batch = t.supplier.select((F.col("s_suppkey") * 3).alias("id"), F.col("s_acctbal").alias("balance"))
    return i.patch(target, batch, "id")


@query(
    "import_column_profile",
    """SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', 'nothing', 'flag']) AS "column",
              unnest([max(length(doc_id::VARCHAR)), max(length(text)), max(length(lang)), max(length(source)), max(length(n_chars::VARCHAR)), 0, 5])::BIGINT
              AS max_length FROM documents""",
)
def import_column_profile(t):
    wide = t.documents.select("*", F.lit("").alias("nothing"), (F.col("n_chars") > 100).alias("flag"))
    return i.column_profile(wide)


@query("import_drop_empty", "SELECT o_orderkey, o_orderstatus, o_totalprice > 200000 AS large FROM orders")
def import_drop_empty(t):
    """An upload with columns that no row fills: an empty text, a null and an empty list."""
    empty = [F.lit("").alias("note"), F.lit(None).cast("string").alias("extra"), F.array().cast("array<string>").alias("labels")]
    large = (F.col("o_totalprice") > 200000).alias("large")
    return i.drop_empty_columns(t.orders.select("o_orderkey", "o_orderstatus", *empty, large))


@query(
    "export_filtered",
    "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'P' AND contains(lower(o_orderpriority), 'high')",
)
def export_filtered(t):
    """Writes the filtered rows as CSV in the shared folder and reads them back."""
    predicate = p.compile_params({"o_orderstatus": "P", "o_orderpriority__icontains": "high"})
    path = shared_dir(t.spark, "export")
    i.export(t.orders.where(predicate).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), path)
    return t.spark.read.csv(path, schema="id bigint, price double", header=True)


@query(
    "export_selected",
    "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)",
)
def export_selected(t):
    ids = t.lineitem.where(F.col("l_quantity") >= 50).select(F.col("l_orderkey").alias("id"))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    path = shared_dir(t.spark, "export")
    i.export(i.selected(rows, ids, "id"), path)
    return t.spark.read.csv(path, schema="id bigint, price double", header=True)


@query("retention_keep", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16'")
def retention_keep(t):
    return i.retain(t.events, "ts", 15, EVENTS_AS_OF).select("event_id", "event_type")


@query("retention_days", "SELECT event_id, event_type, ts::DATE::VARCHAR AS day FROM events WHERE ts >= TIMESTAMP '2024-01-16'")
def retention_days(t):
    """The log kept in a folder a day, and the folders of older days dropped."""
    path = shared_dir(t.spark, "log-days")
    d.write_days(t.events.select("event_id", "event_type", "ts"), path, "ts")
    d.drop_days(t.spark, path, 15, EVENTS_AS_OF)
    kept = d.read_days(t.spark, path, "event_id bigint, event_type string, ts timestamp_ntz")
    return kept.select("event_id", "event_type", F.col("day").cast("string").alias("day"))


@query(
    "import_update_days",
    """SELECT event_id, ts::DATE::VARCHAR AS day, CASE WHEN event_type = 'error' AND ts >= TIMESTAMP '2024-01-20' THEN -value ELSE value END AS value,
              md5(props) AS props FROM events""",
)
def import_update_days(t):
    """A patch of one column, by id, on the log kept in a folder a day; days before the 20th are not rewritten."""
    path, schema = shared_dir(t.spark, "log-days"), "event_id bigint, ts timestamp_ntz, value double, props string"
    d.write_days(t.events.select("event_id", "ts", "value", "props"), path, "ts")
    late = t.events.where("event_type = 'error' AND ts >= TIMESTAMP_NTZ '2024-01-20'").select("event_id", (-F.col("value")).alias("value"))
    d.patch_days(t.spark, path, schema, late, "event_id", "ts")
    rows = d.read_days(t.spark, path, schema)
    return rows.select("event_id", F.col("day").cast("string").alias("day"), "value", F.md5("props").alias("props"))


@query("redact_columns", "SELECT c_custkey AS id, sha256(c_name) AS secret, sha256(c_mktsegment) AS password FROM customer")
def redact_columns(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("secret"), F.col("c_mktsegment").alias("password"))
    return redact(rows)
