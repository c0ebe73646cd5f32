"""Entity views over the input tables.

Each adapter is a plain projection (or one aggregation), so an entity costs no more than the columns that a
query finally reads from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.functions.network import dotted_quad
from accesslake.operators.relations import Snapshot


def props_key(props: Column) -> Column:
    return F.get_json_object(props, "$.k").try_cast("bigint")


def login_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("username"),
        "user_id",
        F.col("ts").alias("datetime"),
        (F.col("event_type") != "error").alias("status"),
        F.col("event_type").alias("method"),
        F.col("value").alias("duration_hint"),
        dotted_quad(F.col("user_id")).alias("remote_addr"),
    )


def operate_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("user"),
        F.col("event_type").alias("action"),
        props_key(F.col("props")).alias("resource"),
        F.col("ts").alias("datetime"),
    )


def password_change_log(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("user"),
        props_key(F.col("props")).alias("change_by"),
        F.col("ts").alias("datetime"),
    )


def job_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("execution"),
        F.col("event_type").alias("task"),
        props_key(F.col("props")).alias("host"),
        (F.col("event_type") != "view").alias("is_finished"),
        (F.col("event_type") != "error").alias("is_success"),
        F.col("value").alias("time_cost"),
        F.col("ts").alias("date_start"),
    )


def user(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("source"),
        F.col("c_nationkey").alias("org"),
        F.col("c_acctbal").alias("balance"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def asset(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("platform"),
        F.col("p_type").alias("category"),
        F.col("p_size").alias("type"),
        F.col("p_retailprice").alias("price"),
        dotted_quad(F.col("p_partkey")).alias("address"),
    )


def session(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One session per line item, of the user who placed the order."""
    return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("asset_id"),
        F.col("l_suppkey").alias("account"),
        F.col("l_linestatus").alias("protocol"),
        F.col("l_returnflag").alias("login_from"),
        F.col("o_orderdate").alias("date_start"),
        F.col("l_shipdate").alias("date_end"),
        (F.col("o_orderstatus") == "F").alias("is_finished"),
    )


def account(lineitem: DataFrame) -> DataFrame:
    """Distinct (username, asset) pairs with their first and last login."""
    return lineitem.groupBy(F.col("l_suppkey").alias("username"), F.col("l_partkey").alias("asset")).agg(
        F.max("l_shipdate").alias("date_last_login"),
        F.min("l_shipdate").alias("date_created"),
        F.count("*").alias("logins"),
    ).withColumn("privileged", F.col("username") % 5 == 0)


def account_secret(p_name: Column, p_size: Column, username: Column) -> Column:
    """The secret of an account: the part's name and size and the account's user; null if one is unknown."""
    return F.concat(p_name, F.lit("#"), p_size.cast("string"), F.lit("#"), username.cast("string"))


def _account_snapshot(lineitem: DataFrame, held: Column) -> Snapshot:
    values = {
        "date_last_login": (F.max, "l_shipdate"),
        "date_secret_changed": (F.min, "l_shipdate"),
        "groups": (F.max, "l_quantity"),
        "sudoers": (F.max, "l_discount"),
        "authorized_keys": (F.max, "l_tax"),
    }
    return Snapshot(lineitem, held, ["username", "asset"], values)


def account_lines(lineitem: DataFrame) -> DataFrame:
    """The lines with their account's keys (username, asset)."""
    return lineitem.withColumnsRenamed({"l_suppkey": "username", "l_partkey": "asset"})


def managed_snapshot(lines: DataFrame) -> Snapshot:
    return _account_snapshot(lines, F.col("l_linestatus") == "O")


def discovered_snapshot(lines: DataFrame) -> Snapshot:
    return _account_snapshot(lines, F.col("l_returnflag") != "R")


def managed_accounts(lineitem: DataFrame) -> DataFrame:
    """The managed snapshot: accounts with an open line."""
    return managed_snapshot(account_lines(lineitem)).frame()


def discovered_accounts(lineitem: DataFrame) -> DataFrame:
    """The snapshot found on hosts: accounts with a line that was not returned."""
    return discovered_snapshot(account_lines(lineitem)).frame()


def leak_list(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One ``password`` column: secrets behind the lines returned before 1996."""
    old = lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
    pairs = old.select("l_suppkey", "l_partkey").distinct()
    return pairs.join(part, pairs.l_partkey == part.p_partkey).select(
        account_secret(F.col("p_name"), F.col("p_size"), F.col("l_suppkey")).alias("password")
    ).distinct()


def user_snapshot_before(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def user_snapshot_after(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Users in debt left; rich furniture buyers changed segment; low nations gained one unit; suppliers joined."""
    kept = customer.where(F.col("c_acctbal") >= 0).select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(F.col("c_nationkey") < 5, F.round(F.col("c_acctbal") + 1, 2)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when((F.col("c_mktsegment") == "FURNITURE") & (F.col("c_acctbal") > 5000), F.lit("CHANGED"))
        .otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
    )
    joined = supplier.select(
        (F.col("s_suppkey") + F.lit(10_000_000_000)).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("NEW").alias("c_mktsegment"),
    )
    return kept.unionByName(joined)


def label_bridge(part: DataFrame) -> DataFrame:
    """One row per asset and label name; a narrow explode, no shuffle."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.col(column).cast("string").alias("value"))
            for name, column in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"))
        ]
    )
    return part.select(F.col("p_partkey").alias("res_id"), F.inline(pairs))


def node_tree(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """(id, parent_id, name): one root, regions, nations, customers."""
    root = region.sparkSession.range(0, 1, 1, 1).select(
        F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("Default").alias("name")
    )
    regions = region.select(
        F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name")
    )
    nations = nation.select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"),
        F.concat(F.lit("r"), "n_regionkey").alias("parent_id"),
        F.col("n_name").alias("name"),
    )
    customers = customer.select(
        F.concat(F.lit("c"), "c_custkey").alias("id"),
        F.concat(F.lit("n"), "c_nationkey").alias("parent_id"),
        F.col("c_name").alias("name"),
    )
    return root.unionByName(regions).unionByName(nations).unionByName(customers)


def organisation_nodes(region: DataFrame, nation: DataFrame) -> DataFrame:
    """The inner nodes only: root, regions, nations. Assets hang below the nations."""
    root = region.sparkSession.range(0, 1, 1, 1).select(
        F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("Default").alias("name")
    )
    regions = region.select(
        F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name")
    )
    nations = nation.select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"),
        F.concat(F.lit("r"), "n_regionkey").alias("parent_id"),
        F.col("n_name").alias("name"),
    )
    return root.unionByName(regions).unionByName(nations)


def asset_nodes(part: DataFrame) -> DataFrame:
    """(asset, node): an asset hangs below the nation its brand is numbered after."""
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int")
    return part.select(F.col("p_partkey").alias("asset"), F.concat(F.lit("n"), brand - 1).alias("node"))


# The six permission actions in their order.
ACTIONS = ["connect", "upload", "download", "copy", "paste", "share"]


def permissions(nation: DataFrame) -> DataFrame:
    """One permission per nation; its first ``1 + key % 6`` actions, and a validity around the order dates."""
    key = F.col("n_nationkey")
    return nation.select(
        key.alias("permission"),
        F.slice(F.array(*[F.lit(a) for a in ACTIONS]), F.lit(1), key % 6 + 1).alias("actions"),
        (key % 4 != 3).alias("is_active"),
        F.timestamp_add("DAY", key * 40, F.lit("1995-01-01").cast("timestamp_ntz")).cast("timestamp_ntz").alias("date_start"),
        F.timestamp_add("DAY", key * 60, F.lit("1999-01-01").cast("timestamp_ntz")).cast("timestamp_ntz").alias("date_expired"),
    )


def permission_groups(nation: DataFrame) -> DataFrame:
    """(permission, group): the group of users of the same nation."""
    return nation.select(F.col("n_nationkey").alias("permission"), F.col("n_nationkey").alias("group"))


def permission_users(nation: DataFrame, supplier: DataFrame) -> DataFrame:
    """(permission, user): users named one by one, here those numbered like a supplier of the nation."""
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_nationkey").alias("permission"), F.col("s_suppkey").alias("user")
    )


def group_members(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("user"))


def permission_nodes(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_nationkey").alias("permission"), F.concat(F.lit("r"), "n_regionkey").alias("node"))


def permission_assets(nation: DataFrame, part: DataFrame) -> DataFrame:
    """(permission, asset): assets named one by one, here those whose size is the permission's number plus one."""
    return part.join(nation, F.col("p_size") == F.col("n_nationkey") + 1).select(
        F.col("n_nationkey").alias("permission"), F.col("p_partkey").alias("asset")
    )


def command_log(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").alias("session"),
        F.col("turn"),
        F.col("text").alias("input"),
        F.col("role").alias("user"),
    )


def component_log(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("line_id"), F.col("source").alias("component"), F.col("text").alias("message"))
