"""Hierarchies given as (id, parent_id, ...).

Every node is first given the list of its ancestors, nearest first; lists are joined to lists, so each round doubles them. Questions about
ancestors then need no further join: each row can answer them from its own list. Lists are as long as the tree is
deep, never as long as it is wide, so a root above everything is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.session import cut_lineage


def with_ancestors(nodes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``ancestors``: an array of (id, carried columns), nearest ancestor first.

    Only nodes that occur as a parent are climbed through. Each round joins the nodes still climbing with the node their list
    ends below and takes over that node's whole list, so lists double and a chain of 1,000 nodes takes 10 rounds; each round
    is checkpointed. Every node then takes its parent and the parent's ancestors by one join. A node that meets itself or
    one of its ancestors again stops there, so cycles end.
    """
    fields = ("id", *carry)
    named = nodes.select(F.struct(*fields).alias("_up"), F.col("id").alias("_at"), F.col("parent_id").alias("_next"))
    used = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("_at")).distinct()
    empty = F.array().cast(f"array<{nodes.select(F.struct(*fields).alias('s')).schema['s'].dataType.simpleString()}>")
    state = named.join(used, "_at", "left_semi").select(F.col("_at").alias("_id"), F.col("_up").alias("_self"), empty.alias("_above"), F.col("_next").alias("_cursor"))
    state = cut_lineage(state)
    while True:
        climbing = state.where(F.col("_cursor").isNotNull())
        if climbing.isEmpty():
            break
        ends = state.select(F.col("_id").alias("_at"), F.concat(F.array("_self"), F.col("_above")).alias("_chain"), F.col("_cursor").alias("_then"))
        met = climbing.join(ends, F.col("_cursor") == F.col("_at"), "left")
        met = met.select("_id", "_self", "_then", F.concat("_above", F.coalesce("_chain", empty)).alias("_above"))
        ids = F.concat(F.array("_id"), F.transform("_above", lambda a: a["id"]))
        met = met.withColumn("_ids", ids).withColumn("_clean", F.size(F.array_distinct("_ids")) == F.size("_ids"))
        again = F.transform("_ids", lambda x, i: F.array_position("_ids", x) <= i)
        upto = F.slice("_above", F.lit(1), F.array_position(again, F.lit(True)).cast("int") - 2)
        stepped = met.select("_id", "_self", F.when(F.col("_clean"), F.col("_above")).otherwise(upto).alias("_above"), F.when(F.col("_clean"), F.col("_then")).alias("_cursor"))
        state = cut_lineage(state.where(F.col("_cursor").isNull()).union(stepped))
    climbed = state.select("_id", F.concat(F.array("_self"), F.col("_above")).alias("_chain"))
    own = F.coalesce(F.filter("_chain", lambda a: a["id"] != F.col("id")), empty)
    return nodes.join(climbed, F.col("parent_id") == F.col("_id"), "left").select(*nodes.columns, own.alias("ancestors"))


def flatten(nodes: DataFrame, sort_key: str = "id") -> DataFrame:
    """Rows with ``_level`` (root 0) and ``path`` (root first); ordering by ``path`` walks the tree depth first."""
    carry = () if sort_key == "id" else (sort_key,)
    up = with_ancestors(nodes, carry)
    keys = F.transform(F.reverse("ancestors"), lambda a: a[sort_key])
    return up.withColumn("_level", F.size("ancestors").cast("bigint")).withColumn(
        "path", F.array_append(keys, F.col(sort_key))
    ).drop("ancestors")


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance), every node being its own ancestor at distance 0."""
    up = with_ancestors(nodes.select("id", "parent_id"))
    chain = F.concat(F.array(F.struct(F.col("id").alias("id"))), F.col("ancestors"))
    return up.select(F.posexplode(chain).alias("distance", "_a"), F.col("id").alias("descendant")).select(
        F.col("_a.id").alias("ancestor"), "descendant", F.col("distance").cast("bigint").alias("distance")
    )


def search(nodes: DataFrame, keyword: str) -> DataFrame:
    """Ids of the nodes whose lower-cased name contains the keyword, with all their ancestors and descendants."""
    up = with_ancestors(nodes.select("id", "parent_id", "name"), ("name",))

    def hit(name: Column) -> Column:
        return F.contains(F.lower(name), F.lit(keyword.lower()))

    below = F.exists("ancestors", lambda a: hit(a["name"]))
    above = F.when(hit(F.col("name")), F.transform("ancestors", lambda a: a["id"])).otherwise(F.array().cast("array<string>"))
    own = F.when(hit(F.col("name")) | below, F.array("id")).otherwise(F.array().cast("array<string>"))
    return up.select(F.explode(F.concat(own, above)).alias("id")).distinct()


def visible(nodes: DataFrame, expanded: str = "expanded") -> DataFrame:
    """Nodes all of whose ancestors are expanded."""
    up = with_ancestors(nodes.select("id", "parent_id", expanded), (expanded,))
    return up.where(F.forall("ancestors", lambda a: a[expanded])).select("id")


def leaves(checked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Checked nodes that are nobody's parent."""
    parents = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct()
    return checked.join(parents, "id", "left_anti")


def subtree_counts(nodes: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct assets at or below every node. Pairs are made unique in their own shuffle, so a root is no hot task."""
    up = with_ancestors(nodes.select("id", "parent_id"))
    chain = F.transform(F.concat(F.array(F.struct(F.col("id").alias("id"))), F.col("ancestors")), lambda a: a["id"])
    held = assets.join(up.select(F.col("id").alias("node"), chain.alias("_chain")), "node")
    counts = held.select("asset", F.explode("_chain").alias("id")).groupBy("id").agg(F.count_distinct("asset").alias("assets"))
    return nodes.select("id").join(counts, "id", "left").fillna(0, ["assets"])


def expand_dependencies(selected: DataFrame, deps: DataFrame, known: DataFrame) -> DataFrame:
    """Selected ids and, one hop on, the known ids they depend on. ``deps`` has (id, depends_on)."""
    added = (
        deps.join(selected.select("id"), "id", "left_semi")
        .select(F.col("depends_on").alias("id"))
        .distinct()
        .join(known.select("id"), "id", "left_semi")
    )
    return selected.select("id").union(added).distinct()
