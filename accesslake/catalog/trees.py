"""Queries over hierarchies. The tree on the fixtures: root, regions, nations, customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.catalog.registry import query
from accesslake.operators import tree
from accesslake.sources import adapters as a

TREE_SQL = """
    nodes AS (SELECT 'root' AS id, NULL AS parent_id, 'Default' AS name UNION ALL SELECT 'r' || r_regionkey, 'root', r_name FROM region
              UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
              UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
    closure AS (SELECT id AS descendant, id AS ancestor, 0 AS distance, parent_id AS up FROM nodes
                UNION ALL SELECT c.descendant, n.id, c.distance + 1, n.parent_id FROM closure c JOIN nodes n ON c.up = n.id)
"""


def nodes(t):
    return a.node_tree(t.region, t.nation, t.customer)


@query(
    "tree_flatten",
    f"""WITH RECURSIVE {TREE_SQL}
        SELECT descendant AS id, max(distance)::BIGINT AS _level, string_agg(ancestor, '/' ORDER BY distance DESC) AS path FROM closure GROUP BY 1""",
)
def tree_flatten(t):
    flat = tree.flatten(nodes(t))
    return flat.orderBy("path").select("id", "_level", F.array_join("path", "/").alias("path"))


@query("tree_closure", f"WITH RECURSIVE {TREE_SQL} SELECT ancestor, descendant, distance::BIGINT AS distance FROM closure")
def tree_closure(t):
    return tree.closure(nodes(t))


@query(
    "tree_search",
    f"""WITH RECURSIVE {TREE_SQL}, hit AS (SELECT id FROM nodes WHERE contains(lower(name), 'n_1'))
        SELECT descendant AS id FROM closure WHERE ancestor IN (SELECT id FROM hit)
        UNION SELECT ancestor FROM closure WHERE descendant IN (SELECT id FROM hit)""",
)
def tree_search(t):
    return tree.search(nodes(t), "N_1")


@query(
    "tree_visible",
    f"""WITH RECURSIVE {TREE_SQL}
        SELECT id FROM nodes WHERE NOT EXISTS (SELECT 1 FROM closure JOIN nodes a ON a.id = ancestor
               WHERE descendant = nodes.id AND distance > 0 AND a.name IN ('ASIA', 'NATION_3', 'NATION_5'))""",
)
def tree_visible(t):
    expanded = ~F.col("name").isin("ASIA", "NATION_3", "NATION_5")
    return tree.visible(nodes(t).withColumn("expanded", expanded), "expanded")


@query(
    "tree_leaf_selection",
    f"WITH RECURSIVE {TREE_SQL} SELECT id FROM nodes WHERE contains(name, '1') AND id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)",
)
def tree_leaf_selection(t):
    everything = nodes(t)
    return tree.leaves(everything.where(F.contains("name", F.lit("1"))).select("id"), everything)


@query(
    "tree_subtree_count",
    f"""WITH RECURSIVE {TREE_SQL}, held AS (SELECT DISTINCT o_orderkey AS asset, 'c' || o_custkey AS node FROM orders)
        SELECT n.id, count(DISTINCT asset) AS assets FROM nodes n LEFT JOIN closure ON ancestor = n.id LEFT JOIN held ON descendant = node GROUP BY 1""",
)
def tree_subtree_count(t):
    assets = t.orders.select(F.col("o_orderkey").alias("asset"), F.concat(F.lit("c"), F.col("o_custkey")).alias("node"))
    return tree.subtree_counts(nodes(t), assets)


@query(
    "dependency_expand",
    """WITH sel AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
            dep AS (SELECT o_custkey AS id, o_orderkey AS depends_on FROM orders)
       SELECT id FROM sel UNION SELECT depends_on FROM dep JOIN sel USING (id) WHERE depends_on IN (SELECT c_custkey FROM customer)""",
)
def dependency_expand(t):
    chosen = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id"))
    deps = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("depends_on"))
    return tree.expand_dependencies(chosen, deps, t.customer.select(F.col("c_custkey").alias("id")))
