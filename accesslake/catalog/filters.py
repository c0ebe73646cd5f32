"""Queries over filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.catalog.registry import EVENTS_AS_OF, LINES_AS_OF, ORDERS_AS_OF, query
from accesslake.functions import calendar as cal
from accesslake.functions.values import all_of
from accesslake.operators import metrics, ranking, risks
from accesslake.operators import predicates as p
from accesslake.sources import adapters as a


@query(
    "keyword_any_column",
    """SELECT * FROM supplier WHERE contains(s_suppkey::VARCHAR, '7') OR contains(s_name, '7')
              OR contains(s_nationkey::VARCHAR, '7') OR contains(s_acctbal::VARCHAR, '7')""",
)
def keyword_any_column(t):
    return p.search_any(t.supplier, "7")


@query("lookup_exact", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def lookup_exact(t):
    params = p.compose_conditions([("o_orderstatus", "exact", "F"), ("o_orderstatus", "exact", "P")])
    return t.orders.where(p.compile_params(params)).select("o_orderkey", "o_orderstatus")


@query(
    "lookup_icontains",
    """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'o')
              AND contains(lower(p_brand), 'brand#1')""",
)
def lookup_icontains(t):
    conditions = [("p_name", "icontains", "RED"), ("p_name", "icontains", "o"), ("p_brand", "icontains", "brand#1")]
    return t.part.where(p.compile_params(p.compose_conditions(conditions))).select("p_partkey", "p_name")


@query("lookup_startswith", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def lookup_startswith(t):
    return t.customer.where(p.compile_params({"c_name__startswith": "Customer#00000001"})).select("c_custkey", "c_name")


@query("lookup_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def lookup_in(t):
    return t.orders.where(p.compile_params({"o_orderpriority__in": "1-URGENT,5-LOW"})).select("o_orderkey", "o_orderpriority")


@query(
    "lookup_icontains_any",
    "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'bolt')",
)
def lookup_icontains_any(t):
    return t.part.where(p.compile_params({"p_name__icontains_any": "Red,bolt"})).select("p_partkey", "p_name")


@query(
    "lookup_icontains_all",
    "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')",
)
def lookup_icontains_all(t):
    return t.documents.where(p.compile_params({"text__icontains_all": ["the", "AND"]})).select("doc_id", "lang")


@query(
    "search_batches",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer
       WHERE (contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')
              OR contains(lower(c_name), 'mach') OR contains(lower(c_mktsegment), 'mach'))
         AND (contains(lower(c_name), '42') OR contains(lower(c_mktsegment), '42'))""",
)
def search_batches(t):
    params = p.compose_conditions([("search", "icontains_any", "build,mach"), ("search", "icontains_any", "42")])
    return t.customer.where(p.compile_params(params, ["c_name", "c_mktsegment"])).select("c_custkey", "c_name", "c_mktsegment")


@query("drop_blank_params", "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey = 0")
def drop_blank_params(t):
    params = {"s_name": "", "s_acctbal": None, "s_nationkey": 0, "search": "  "}
    return t.supplier.where(p.compile_params(params, ["s_name"])).select("s_suppkey", "s_name", "s_nationkey")


@query(
    "date_range",
    """SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'""",
)
def date_range(t):
    return cal.between(t.events, "ts", "2024-01-05 13:00:00", "2024-01-10 09:00:00", snap=True).select("event_id", "event_type")


@query(
    "recent_days",
    """SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31'""",
)
def recent_days(t):
    return cal.in_days(t.events, "ts", EVENTS_AS_OF, cal.normalize_days("12", "x")).select("event_id", "event_type")


@query(
    "quick_filter_merge",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 3",
)
def quick_filter_merge(t):
    active = p.merge_filters([{"c_mktsegment": "BUILDING"}, {"c_nationkey": 3}], {"c_mktsegment": "MACHINERY"})
    return t.customer.where(p.compile_params(p.combined(active))).select("c_custkey", "c_mktsegment")


@query(
    "label_filter",
    "SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#4', 'Brand#7') AND p_type IS NOT NULL AND p_size = 9",
)
def label_filter(t):
    labels = "brand:*,brand:Brand#4,brand:Brand#7,type:PROMO,type:*,size:9"
    return p.has_labels(t.part, a.label_bridge(t.part), labels, "p_partkey").select("p_partkey", "p_brand", "p_type")


@query(
    "attr_rules",
    """SELECT id, source FROM (SELECT c_custkey AS id, c_name AS username, c_mktsegment AS source FROM customer)
       WHERE source IN ('BUILDING', 'MACHINERY') AND ends_with(username, '7')""",
)
def attr_rules(t):
    rule = {
        "type": "attrs",
        "attrs": [
            {"name": "source", "match": "in", "value": ["HOUSEHOLD"]},
            {"name": "source", "match": "in", "value": ["BUILDING", "MACHINERY"]},
            {"name": "username", "match": "endswith", "value": "7"},
        ],
    }
    return p.match_rules(a.user(t.customer), rule, "id").select("id", "source")


@query(
    "match_exact_not",
    "SELECT c_custkey AS id, c_mktsegment AS source FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING'",
)
def match_exact_not(t):
    u = a.user(t.customer)
    tests = [p.match(F.col("is_active"), "exact", True), p.match(F.col("source"), "not", "BUILDING")]
    return u.where(all_of(tests)).select("id", "source")


@query("match_in", "SELECT p_partkey AS id, p_type AS category FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def match_in(t):
    return a.asset(t.part).where(p.match(F.col("category"), "in", ["PROMO", "SMALL"])).select("id", "category")


@query(
    "match_contains_exclude",
    "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(p_name, 'l') AND NOT contains(p_name, 'blue')",
)
def match_contains_exclude(t):
    tests = [p.match(F.col("name"), "contains", "l"), p.match(F.col("name"), "exclude", "blue")]
    return a.asset(t.part).where(all_of(tests)).select("id", "name")


@query(
    "match_starts_ends",
    "SELECT c_custkey AS id, c_name AS username FROM customer WHERE starts_with(c_name, 'Customer#0') AND ends_with(c_name, '3')",
)
def match_starts_ends(t):
    tests = [p.match(F.col("username"), "startswith", "Customer#0"), p.match(F.col("username"), "endswith", "3")]
    return a.user(t.customer).where(all_of(tests)).select("id", "username")


@query(
    "match_regex",
    r"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[Tt]h[a-z]+ and|[0-9]{3}')",
)
def match_regex(t):
    return t.documents.where(p.match(F.col("text"), "regex", "[Tt]h[a-z]+ and|[0-9]{3}")).select("doc_id", "lang")


@query(
    "match_m2m",
    """WITH o AS (SELECT l_orderkey AS id, bool_or(p_type = 'PROMO') AS promo, bool_or(p_type = 'SMALL') AS small
                  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
       SELECT id, promo AND small AS has_all FROM o WHERE promo OR small""",
)
def match_m2m(t):
    kinds = t.lineitem.join(t.part, t.lineitem.l_partkey == t.part.p_partkey).select(F.col("l_orderkey").alias("id"), "p_type")
    return p.match_members(kinds, "id", "p_type", ["PROMO", "SMALL"]).where("has_any").select("id", "has_all")


@query(
    "match_ip_in",
    """SELECT p_partkey AS id FROM part WHERE p_partkey BETWEEN 64 AND 79 OR p_partkey BETWEEN 300 AND 320 OR p_partkey = 77
              OR p_partkey BETWEEN 256 AND 259""",
)
def match_ip_in(t):
    group = ["10.0.0.64/28", "10.0.1.44-10.0.1.64", "10.0.0.77", "10.0.1.2/30"]
    return a.asset(t.part).where(p.match(F.col("address"), "ip_in", group)).select("id")


@query("match_gte_lte", "SELECT p_partkey AS id, p_size AS type FROM part WHERE p_size >= 10 AND p_size <= 20")
def match_gte_lte(t):
    tests = [p.match(F.col("type"), "gte", 10), p.match(F.col("type"), "lte", 20)]
    return a.asset(t.part).where(all_of(tests)).select("id", "type")


@query(
    "rule_and_or",
    """SELECT p_partkey AS id, contains(p_name, 'red') AND p_type = 'PROMO' AS both FROM part
       WHERE contains(p_name, 'red') OR p_type = 'PROMO'""",
)
def rule_and_or(t):
    rules = [{"name": "name", "match": "contains", "value": "red"}, {"name": "category", "match": "in", "value": ["PROMO"]}]
    return a.asset(t.part).where(p.combine_rules(rules, "or")).select("id", p.combine_rules(rules).alias("both"))


WORK_HOURS = [{"id": i, "value": "08:00~12:00、14:00~00:00"} for i in range(1, 6)] + [{"id": 0, "value": "00:00~06:00"}]


@query(
    "week_window",
    """SELECT event_id AS id FROM events WHERE
         (dayofweek(ts) BETWEEN 1 AND 5 AND (hour(ts) BETWEEN 8 AND 11 OR hour(ts) >= 14)) OR (dayofweek(ts) = 0 AND hour(ts) < 6)""",
)
def week_window(t):
    return t.events.where(cal.in_week_period(F.col("ts"), WORK_HOURS)).select(F.col("event_id").alias("id"))


@query(
    "week_period_merge",
    """WITH slots AS (SELECT user_id, dayofweek(ts) AS dow, hour(ts) AS h FROM events GROUP BY ALL),
            marked AS (SELECT *, h - row_number() OVER (PARTITION BY user_id, dow ORDER BY h) AS island FROM slots),
            ranges AS (SELECT user_id, dow, min(h) AS b, max(h) + 1 AS e FROM marked GROUP BY user_id, dow, island)
       SELECT user_id, dow::BIGINT AS dow, printf('%02d:00', b::INT) AS begin_time, printf('%02d:00', (e % 24)::INT) AS end_time
       FROM ranges""",
)
def week_period_merge(t):
    slots = t.events.select("user_id", (F.dayofweek("ts") - 1).cast("bigint").alias("dow"), F.hour("ts").alias("slot"))
    merged = ranking.merge_slots(slots, ["user_id", "dow"], "slot")

    def clock(hour):
        return F.format_string("%02d:00", hour % 24)

    return merged.select("user_id", "dow", clock(F.col("begin")).alias("begin_time"), clock(F.col("end")).alias("end_time"))


@query(
    "long_no_login",
    """WITH last AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY o_custkey)
       SELECT c_custkey AS id, strftime(d, '%Y-%m-%d') AS last_login FROM customer LEFT JOIN last ON c_custkey = o_custkey
       WHERE d IS NULL OR date_diff('day', d::DATE, DATE '2001-08-01') > 90""",
)
def long_no_login(t):
    idle = p.no_login_for(a.user(t.customer), t.orders, 90, ORDERS_AS_OF, "id", "o_custkey", "o_orderdate")
    return idle.select("id", F.date_format("last_login", "yyyy-MM-dd").alias("last_login"))


@query(
    "validity_flags",
    """WITH f AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS is_active, o_orderdate AS s, o_orderdate + INTERVAL 365 DAY AS e,
                         o_totalprice < 50000 AS is_no_resource FROM orders)
       SELECT id, is_active AND s <= TIMESTAMP '1999-06-01' AND NOT e <= TIMESTAMP '1999-06-01' AS is_valid,
              e <= TIMESTAMP '1999-06-01' AS is_expired, is_active, is_no_resource FROM f""",
)
def validity_flags(t):
    perms = t.orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") != "P").alias("is_active"),
        F.col("o_orderdate").alias("date_start"),
        (F.col("o_orderdate") + F.expr("INTERVAL 365 DAY")).alias("date_expired"),
        (F.col("o_totalprice") < 50000).alias("is_no_resource"),
    )
    return p.validity(perms, "1999-06-01").select("id", "is_valid", "is_expired", "is_active", "is_no_resource")


@query(
    "permission_expr",
    """SELECT n_nationkey::BIGINT AS id, n_nationkey % 6 >= 1 AS upload_or_share, n_nationkey % 6 >= 4 AS copy_and_paste,
              TRUE AS nothing FROM nation""",
)
def permission_expr(t):
    granted = F.col("actions")

    def needs(*items):
        return p.has_perms(F.array(*[F.lit(i) for i in items]), granted)

    return a.permissions(t.nation).select(
        F.col("permission").cast("bigint").alias("id"),
        needs("connect", "upload | share").alias("upload_or_share"),
        needs("copy", "paste").alias("copy_and_paste"),
        p.has_perms(F.array().cast("array<string>"), granted).alias("nothing"),
    )


@query(
    "dashboard_account_filters",
    """WITH a AS (SELECT l_suppkey AS username, l_partkey AS asset, max(l_shipdate) AS last, min(l_shipdate) AS created,
                         bool_or(l_linestatus = 'O' AND l_shipdate >= TIMESTAMP '2001-10-29') AS failed,
                         max(l_linenumber) AS has FROM lineitem GROUP BY 1, 2)
       SELECT count(*) AS total, count(*) FILTER (created >= TIMESTAMP '2001-10-29') AS latest_discovery,
              count(*) FILTER (last >= TIMESTAMP '2001-10-29') AS latest_accessed,
              count(*) FILTER (last >= TIMESTAMP '2001-10-29' AND last > created) AS latest_updated,
              count(*) FILTER (failed) AS latest_secret_change_failed,
              count(*) FILTER (last IS NULL OR date_diff('day', last::DATE, DATE '2001-11-04') > 90) AS long_time_no_login,
              count(*) FILTER (length(p_name) < 12 OR NOT regexp_matches(p_name, '[A-Za-z]') OR NOT regexp_matches(p_name, '[0-9]')
                               OR NOT regexp_matches(p_name, '[^A-Za-z0-9]')) AS weak_password,
              count(*) FILTER (has <= 1) AS no_secret,
              count(*) FILTER (date_diff('day', created::DATE, DATE '2001-11-04') > 180) AS long_time_no_change_secret
       FROM a LEFT JOIN part ON asset = p_partkey""",
)
def dashboard_account_filters(t):
    ship = F.col("l_shipdate")
    start, _ = cal.day_window(LINES_AS_OF, 7)
    recent = ship >= cal.at(t.lineitem, "l_shipdate", start)
    accounts = t.lineitem.groupBy(F.col("l_suppkey").alias("username"), F.col("l_partkey").alias("asset")).agg(
        F.max(ship).alias("last"),
        F.min(ship).alias("created"),
        F.bool_or((F.col("l_linestatus") == "O") & recent).alias("failed"),
        F.max("l_linenumber").alias("has"),
    )
    named = accounts.join(t.part.select(F.col("p_partkey").alias("asset"), F.col("p_name").alias("secret")), "asset", "left")
    named = named.withColumn("has_secret", F.col("has") > 1)
    tests = risks.account_filters(LINES_AS_OF, created="created", last_login="last", updated="last", secret_changed="created", failed="failed")
    return metrics.counters(named, {"total": F.lit(True)} | tests)


@query(
    "risky_commands",
    """SELECT event_id AS id, CASE event_type WHEN 'error' THEN 5 ELSE 4 END::BIGINT AS risk_level FROM events
       WHERE event_type IN ('error', 'purchase')""",
)
def risky_commands(t):
    level = F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "purchase", 4).otherwise(0)
    commands = t.events.select(
        F.col("event_id").alias("id"), F.struct(level.cast("bigint").alias("value"), F.col("event_type").alias("label")).alias("risk_level")
    )
    return commands.where(F.col("risk_level.value") != 0).select("id", F.col("risk_level.value").alias("risk_level"))
