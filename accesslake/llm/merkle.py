"""A Merkle tree over rows whose upper proofs come from a butterfly exchange, in column expressions only.

A node is the SHA-256, in lowercase hexadecimal, of its children's texts joined; up to ``FANOUT`` neighbours make a node.
A proof lists, from the leaf up, ``(place, siblings)``: the leaf's or ancestor's place in its run and the run's others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslake.llm.common import partitions, written

FANOUT = 8
#: A block, the unit that takes part in the exchange, has ``FANOUT ** LEVELS`` leaves at most.
LEVELS = 3
STEP = "struct<place:int,siblings:array<string>>"


def digest(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row's values: ``-`` for null, otherwise the length in UTF-8 bytes, a colon and the value."""
    framed = []
    for value in values:
        text = value.cast("string")
        framed.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*framed), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def up(node, step):
        before, after = F.slice(step["siblings"], 1, step["place"]), F.slice(step["siblings"], step["place"] + 1, F.size(step["siblings"]))
        return F.sha2(F.concat(F.array_join(before, ""), node, F.array_join(after, "")), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return digest(F.flatten(F.transform(proof, lambda step: step["siblings"])))


def _upper(nodes: Column, fanout: int) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / fanout).cast("int") - 1)
    return F.transform(runs, lambda i: digest(F.slice(nodes, i * fanout + 1, F.lit(fanout))))


def _step(nodes: Column, at: Column, fanout: int) -> Column:
    """The step of the node at index ``at`` among neighbours ``nodes`` that begin a run."""
    place = at % fanout
    siblings = F.concat(F.slice(nodes, at - place + 1, place), F.slice(nodes, at + 2, F.lit(fanout - 1) - place))
    return F.array(F.struct(place.cast("int").alias("place"), siblings.alias("siblings")))


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, at, leaf, kept) with ``pos``, the place among its tree's leaves by (at, leaf), and their number ``n``.

    Rows are dealt to ranges of (tree, at, leaf) and written with the number of their range, so a tree of any size, or
    one key of any number of rows, is spread; ranges are numbered inside and their counts added up before.
    """
    spark = leaves.sparkSession
    keys = [F.col("tree").asc_nulls_first(), F.col("at").asc_nulls_first(), F.col("leaf")]
    ranged = written(leaves.repartitionByRange(partitions(spark), *keys).withColumn("range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("tree", "range").agg(F.count("*").alias("own"))
    tree = Window.partitionBy("tree")
    before = F.sum("own").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")
    starts = counts.select(F.col("tree").alias("_tree"), F.col("range").alias("_range"), before.alias("before"), F.sum("own").over(tree).alias("n"))
    inside = Window.partitionBy("tree", "range").orderBy(*keys[1:])
    numbered = ranged.withColumn("inside", F.row_number().over(inside))
    joined = numbered.join(starts, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("range") == F.col("_range")))
    return joined.select("tree", "leaf", "kept", (F.col("before") + F.col("inside") - 1).alias("pos"), "n")


def blocks_of(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per aligned block of ``fanout ** levels`` leaves: its ``rows`` in order, the nodes of each level and ``root``.

    A tree of one block ends where one node is left; all blocks of a larger tree end ``levels`` above the leaves.
    """
    size = fanout**levels
    rows = placed(leaves).withColumn("block", F.floor(F.col("pos") / size)).groupBy("tree", "n", "block")
    blocks = rows.agg(F.sort_array(F.collect_list(F.struct("pos", "leaf", "kept"))).alias("rows"))  # ``size`` rows at most
    blocks = blocks.withColumn("nodes_0", F.transform("rows", lambda r: r["leaf"]))
    for k in range(levels):
        below = F.col(f"nodes_{k}")
        blocks = blocks.withColumn(f"nodes_{k + 1}", F.when(F.col("n") > fanout**k, _upper(below, fanout)).otherwise(below))
    return blocks.select("tree", "n", "block", "rows", *(f"nodes_{k}" for k in range(1, levels)), F.get(f"nodes_{levels}", F.lit(0)).alias("root"))


def butterfly(state: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Each member's proof from its own ``root`` to its tree's, by exchange among members alone: ``tree, block, root, proof``.

    ``state`` has ``tree``, ``block`` (0 to ``count - 1`` in each tree), ``count`` and ``root``. In round r, members whose
    numbers differ in the digit r only (to the base ``fanout``) meet, at most ``fanout`` of them, one from each subtree of
    an aligned group. They swap the roots of their subtrees and each hashes the common ancestor for itself, so after the
    last round every member holds the root and has seen all siblings on its way: nothing is handed down. In a tree's last,
    incomplete subtree members are missing; those there stand in for them, each for every missing number that is equal
    to its own modulo the members there.
    """
    rounds, most = 0, state.agg(F.max("count")).first()[0] or 0
    while fanout**rounds < most:
        rounds += 1
    now = state.select("tree", "block", "count", "root", F.array().cast(f"array<{STEP}>").alias("proof"))
    for r in range(rounds):
        part = fanout**r  # members of a complete subtree
        block, count = F.col("block"), F.col("count")
        active = F.lit(part) < count
        low, group = block % part, F.floor(block / (part * fanout))
        there = F.least(F.lit(part), count - (block - low))
        wanted = F.least(F.lit(part), count - group * part * fanout)
        to = F.when(active, F.sequence(low, wanted - 1, there)).otherwise(F.array(F.lit(0).cast("bigint")))
        sent = now.select("tree", "count", F.when(active, group).otherwise(-1 - block).alias("group"), F.explode(to).alias("to"), block.alias("block"), (~active | (F.col("to") == low)).alias("home"), "root", "proof")
        sent = sent.withColumn("proof", F.when(F.col("home"), F.col("proof")))
        met = sent.groupBy("tree", "count", "group", "to").agg(F.sort_array(F.collect_list(F.struct("block", "home", "root", "proof"))).alias("met"))
        met = met.withColumn("roots", F.transform("met", lambda m: m["root"]))
        met = met.withColumn("up", F.when(active, digest(F.col("roots"))).otherwise(F.get("roots", F.lit(0))))
        own = F.transform("met", lambda m, i: F.struct(m["block"].alias("block"), m["home"].alias("home"), F.when(active, F.concat(m["proof"], _step(F.col("roots"), i, fanout))).otherwise(m["proof"]).alias("proof")))
        now = met.select("tree", "count", "up", F.inline(F.filter(own, lambda m: m["home"]))).select("tree", "block", "count", F.col("up").alias("root"), "proof")
    return now.select("tree", "block", "root", "proof")


def prove(rows: DataFrame, leaf: Column, tree: Column, order: Column, keep: dict[str, Column], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``keep``'s columns (one at least) of every row with its ``leaf``, its tree's ``subroot``, the ``root`` over all and the ``proof``.

    Leaves of one ``tree`` ascend by ``order`` (null first), equal ones by the leaf itself. While several nodes remain,
    every ``fanout`` neighbours make one, the last run fewer; a lone leaf is its own subroot. The subroots, by tree (null
    first, then bytewise), make the root in the same way.

    Null trees are a tree and null orders come first; repeated rows are leaves of their own; texts may be of any length, as
    only their digests move; an empty table gives no rows; names in ``rows`` don't matter, as only ``keep``'s are carried.
    One row a tree, never one a leaf, passes through one task to number the trees.
    """
    leaves = rows.select(tree.alias("tree"), order.alias("at"), leaf.alias("leaf"), F.struct(*(c.alias(k) for k, c in keep.items())).alias("kept"))
    blocks = written(blocks_of(written(leaves, "leaves"), fanout, levels), "blocks")
    size = fanout**levels
    lower = blocks.select("tree", "block", F.ceil(F.col("n") / size).alias("count"), "root")
    lower = written(butterfly(lower, fanout), "exchanged")
    trees = lower.where("block = 0").select(F.col("tree").alias("name"), "root", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("tree").asc_nulls_first())) - 1).cast("bigint").alias("block"))
    trees = written(trees, "trees")
    upper = butterfly(trees.select(F.lit(0).alias("tree"), "block", F.lit(trees.count()).cast("bigint").alias("count"), "root"), fanout)
    upper = written(trees.select("name", "block").join(upper.select("block", F.col("root").alias("_root"), F.col("proof").alias("_top")), "block"), "upper")

    lower = lower.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), F.col("root").alias("subroot"), F.col("proof").alias("_proof"))
    joined = blocks.join(lower, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    joined = joined.join(upper.select("name", "_root", "_top"), F.col("tree").eqNullSafe(F.col("name")))
    joined = joined.withColumn("nodes_0", F.transform("rows", lambda r: r["leaf"]))

    def local(i):
        none = F.array().cast(f"array<{STEP}>")
        at, steps = i, []
        for k in range(levels):
            steps.append(F.when(F.col("n") > fanout**k, _step(F.col(f"nodes_{k}"), at, fanout)).otherwise(none))
            at = ((at - at % fanout) / fanout).cast("int")
        return F.concat(*steps)

    found = F.transform("rows", lambda r, i: F.struct(r["kept"].alias("kept"), r["leaf"].alias("leaf"), local(i).alias("_local")))
    each = joined.select("subroot", F.col("_root").alias("root"), F.concat("_proof", "_top").alias("_above"), F.inline(found))
    return each.select(*(F.col(f"kept.`{k}`").alias(k) for k in keep), "leaf", "subroot", "root", F.concat("_local", "_above").alias("proof"))
