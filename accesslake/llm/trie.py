"""A trie of conversations' turns, and sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns. The tree is cut at centroids, nodes whose removal leaves no piece with more
than half of a component, until a component fits into one task, where the same goes on in numpy. A centroid's total inside
its component is added to it and to all nodes on its way to the component's top; the sums of these are the rollups.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslake.llm.common import partitions, written
from accesslake.operators.relations import attach_spread

#: Turns of one conversation that a task numbers or sums at once, and ids of one node's conversations that become one text.
RANGE = 4096
#: Nodes of a component that is finished in one task.
COMPONENT = 4096
#: Ways in which a component's rows are spread when they meet its centroid.
SALT = 64
WORD = r"[^\x20\x09-\x0D]+"


def _before(rows: DataFrame, key: str, order: list[Column], of: Column, totals: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums of ``totals`` over each ``key``'s rows up to and including a row, ordered by ``order``.

    ``of`` is a coarse value that rises with ``order``: a window runs inside one such range of a key, and the ranges' sums
    are added up before, so a key of any number of rows is spread over many tasks.
    """
    rows = rows.withColumn("_range", F.coalesce(of, F.lit(-(1 << 62))).cast("long"))
    sums = rows.groupBy(key, "_range").agg(*(F.sum(c).alias(f"_sum_{k}") for k, c in totals.items()))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), *((F.sum(f"_sum_{k}").over(earlier) - F.col(f"_sum_{k}")).alias(f"_start_{k}") for k in totals))
    inside = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("*", *(F.sum(c).over(inside).alias(f"_in_{k}") for k, c in totals.items()))
    joined = within.join(starts, (F.col(key) == F.col("_key")) & (F.col("_range") == F.col("_at")))
    keep = [c for c in rows.columns if c != "_range"]
    return joined.select(*keep, *((F.col(f"_start_{k}") + F.col(f"_in_{k}")).alias(k) for k in totals))


def turns_of(messages: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 1), ``said`` (two hashes of role and text) and ``words`` of every message, by turn.

    Null turns come first; messages of one turn follow one another by their hashes. Texts are read once and only hashed;
    null roles and texts are empty. Messages without a conversation belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.array(*(F.xxhash64(F.lit(k), role, text) for k in range(2)))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said.alias("said"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).where("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), F.col("said")[0], F.col("said")[1]]
    return _before(rows, "conv_id", order, F.floor(F.col("turn") / RANGE), {"place": F.lit(1)}).drop("turn")


def grafted(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id, length``) and their turns (``conv_id, depth, said, words``) after each is rebuilt.

    Of conversation ``base`` (a column of ``conv_id``) the first ``taken`` turns, ``most`` at most, come first; the own turns
    after the first ``taken`` follow. An absent base gives none.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = sizes.select("conv_id", "own", base.cast("long").alias("base"), taken.cast("long").alias("taken"))
    lent = sizes.select(F.col("conv_id").alias("_base"), F.col("own").alias("lent"))
    convs = convs.join(lent, F.col("base") == F.col("_base"), "left")
    convs = convs.select("conv_id", "base", "taken", F.least(F.coalesce("lent", F.lit(0)), "taken").alias("lent"), F.greatest(F.col("own") - F.col("taken"), F.lit(0)).alias("left"))
    convs = written(convs, "conversations")
    heads = turns.where(F.col("place") <= most).select(F.col("conv_id").alias("_base"), "place", "said", "words")
    first = convs.join(heads, (F.col("base") == F.col("_base")) & (F.col("place") <= F.col("lent"))).select("conv_id", F.col("place").alias("depth"), "said", "words")
    own = turns.join(convs.select("conv_id", "taken", "lent"), "conv_id").where("place > taken").select("conv_id", (F.col("place") - F.col("taken") + F.col("lent")).alias("depth"), "said", "words")
    return convs.select("conv_id", (F.col("lent") + F.col("left")).alias("length")), first.union(own)


def paths_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, words, last`` for each first part of each conversation, the empty one included.

    ``node`` is a 128-bit digest of the part: sums over its turns of 32-bit pieces of hashes of depth and turn, which can be
    added up over ranges in any order, and the depth.
    """
    pieces = [F.shiftrightunsigned(F.xxhash64("depth", F.col("said")[k]), s).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(2) for s in (0, 32)]
    summed = _before(turns, "conv_id", [F.col("depth")], F.floor(F.col("depth") / RANGE), {f"s{i}": p for i, p in enumerate(pieces)})

    def node(depth, sums):
        return F.unhex(F.md5(F.concat_ws(",", *(c.cast("string") for c in (depth, *sums))).cast("binary")))

    sums = [F.col(f"s{i}") for i in range(len(pieces))]
    above = node(F.col("depth") - 1, [s - p for s, p in zip(sums, pieces)])
    rows = summed.select("conv_id", "depth", node(F.col("depth"), sums).alias("node"), above.alias("parent"), "words")
    root = node(F.lit(0), [F.lit(0)] * len(pieces))
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"))
    both = rows.unionByName(tops).join(convs.select(F.col("conv_id").alias("_id"), "length"), F.col("conv_id") == F.col("_id"))
    return both.select("conv_id", "depth", "node", "parent", "words", (F.col("depth") == F.col("length")).alias("last"))


def ends_of(paths: DataFrame) -> DataFrame:
    """``node, ends_sha256``: the digest of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are joined in ranges of ``RANGE`` first; SHA-256 has to read a node's ranges in order, which one task does as a
    stream, holding one range at a time.
    """
    pieces = paths.where("last").groupBy("node", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == node:
                    digest.update(b"," + ids.encode())
                else:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
            yield _pairs(done)
        if node is not None:
            yield _pairs([(node, digest.hexdigest())])

    def _pairs(done):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([v for _, v in done], pa.string())], names=["node", "ends_sha256"])

    dealt = pieces.repartition(partitions(paths.sparkSession), "node").sortWithinPartitions("node", "range").select("node", "ids")
    return dealt.mapInArrow(run, "node binary, ends_sha256 string")


# In one task: arrays of the nodes of whole components, parents by index, -1 at a top.


def doubled(parent: np.ndarray, start: np.ndarray, upwards: bool) -> np.ndarray:
    """Sums of ``start`` over each node's descendants (``upwards``) or ancestors, itself included, in log-depth rounds."""
    total, far = start.copy(), parent.copy()
    while (far >= 0).any():
        here = far >= 0
        if upwards:
            total = total + np.bincount(far[here], total[here], len(total)).astype(total.dtype)
        else:
            total = np.where(here, total + total[far], total)
        far = np.where(here, far[far], -1)
    return total


def decomposed(parent: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the columns of ``values`` over the subtrees of a forest, and the round in which each node was a centroid.

    All components of a round are cut at once. Of a component of n nodes, those with at least half below them are the
    way from its top to its centroid, the lowest of them; after the cut they have the centroid's nodes less.
    """
    count = len(parent)
    size = doubled(parent, np.ones(count, np.int64), True)
    # Places in an order in which every subtree is a range: 1 and the sizes of elder siblings from parent to child.
    order = np.lexsort((np.arange(count), parent))
    run = np.cumsum(size[order]) - size[order]
    first = np.concatenate([[True], parent[order][1:] != parent[order][:-1]])
    step = np.empty(count, np.int64)
    step[order] = run - np.maximum.accumulate(np.where(first, run, 0)) + (parent[order] >= 0)
    place = doubled(parent, step, False)
    order = np.argsort(place)  # from here on nodes are numbered by place
    number = np.empty(count, np.int64)
    number[order] = np.arange(count)
    up = np.where(parent[order] >= 0, number[parent[order]], -1)
    end = np.arange(count) + size[order]
    below, own, top = size[order].copy(), values[order], np.arange(count)
    top = np.maximum.accumulate(np.where(up < 0, top, 0))
    out, when = np.zeros_like(own), np.zeros(count, np.int64)
    live, turn = np.arange(count), 0
    while len(live):
        turn += 1
        tops = top[live]
        way = live[2 * below[live] >= below[tops]]
        centroid = np.zeros(count, np.int64)
        centroid[top[way]] = way  # in order of place the last one, the lowest, stays
        c = centroid[tops]
        under = (live >= c) & (live < end[c])
        total = np.zeros_like(own)
        np.add.at(total, c[under], own[live[under]])
        out[way] += total[centroid[top[way]]]
        lost = below[centroid[top[way]]]
        below[way] -= np.where(way == centroid[top[way]], 0, lost)
        inner = live[under]
        inner = inner[np.argsort(top[inner], kind="stable")]  # of one component in a row: ranges of others lie inside its own
        heads = np.where(up[inner] == centroid[top[inner]], np.arange(len(inner)), 0)
        top[inner] = inner[np.maximum.accumulate(heads)]
        when[live[live == c]] = turn
        live = live[live != c]
    back = np.empty_like(out)
    back[order] = out
    turns = np.empty_like(when)
    turns[order] = when
    return back, turns


def _finish(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``node`` and its sums inside its component, for components that fit into a task."""

    def run(batches):
        held = None
        for batch in (*batches, None):
            if batch is not None:
                if not batch.num_rows:
                    continue
                keys = [np.array(batch.column(i).to_pylist(), dtype=object) for i in range(3)]
                now = (*keys, np.column_stack([batch.column(3 + i).to_numpy() for i in range(len(names))]))
                held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
                change = np.flatnonzero(held[0] != held[0][-1])
                end = change[-1] + 1 if len(change) else 0
            elif held is None:
                return
            else:
                end = len(held[0])
            if end:
                comp, node, parent, values = (x[:end] for x in held)
                held = tuple(x[end:] for x in held)
                at = {(c, n): i for i, (c, n) in enumerate(zip(comp, node))}
                parents = np.array([at.get((c, p), -1) for c, p in zip(comp, parent)], np.int64)
                sums, _ = decomposed(parents, values)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), *(pa.array(sums[:, i], pa.int64()) for i in range(len(names)))], names=["node", *names])

    dealt = nodes.repartition(partitions(nodes.sparkSession), "comp").sortWithinPartitions("comp", "depth")
    return dealt.select("comp", "node", "parent", *names).mapInArrow(run, ", ".join(["node binary", *(f"{n} long" for n in names)]))


def _salted(rows: DataFrame, per_comp: DataFrame) -> DataFrame:
    """Rows of components with what is known of each, a component's rows spread ``SALT`` ways."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALT)))
    right = per_comp.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    return left.join(right, ["comp", "_salt"]).drop("_salt")


def _sizes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``nodes`` with ``size``, the nodes of each subtree, in rounds that double the distance a node's count has gone up."""
    rounds = int(nodes.agg(F.max("depth")).first()[0] or 0).bit_length()
    now = nodes.withColumn("size", F.lit(1).cast("long"))
    at = paths.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), F.col("node").alias("_far"))
    for k in range(rounds):
        far = now.where(F.col("depth") >= 1 << k).join(at, (F.col("conv_id") == F.col("_conv")) & (F.col("depth") - (1 << k) == F.col("_depth")))
        gained = far.groupBy("_far").agg(F.sum("size").alias("_gained"))
        now = now.join(gained, F.col("node") == F.col("_far"), "left").select(*nodes.columns, (F.col("size") + F.coalesce("_gained", F.lit(0))).alias("size"))
        now = written(now, "sizes")
    return now


def rollup(nodes: DataFrame, paths: DataFrame, names: list[str], room: int = COMPONENT) -> DataFrame:
    """``node`` and the sum of each of ``names`` (longs) over its subtree, for every node of a forest.

    ``nodes`` has ``node, parent, conv_id, depth`` and ``names``; ``paths`` tells each conversation's node and its parent at
    each depth, so a node's ancestor is looked up by its conversation. Components above ``room`` nodes are cut by joins, all
    in a round at once; a round leaves no piece above half, so there are as many rounds as doublings from ``room`` to the
    largest. A component's rows, a third of the table say, are spread over ``SALT`` tasks when they meet its centroid.
    """
    tops = paths.where("depth = 0").select(F.col("conv_id").alias("_conv"), F.col("node").alias("comp"))
    state = nodes.select("node", "parent", "conv_id", "depth", *names).join(tops, F.col("conv_id") == F.col("_conv")).drop("_conv")
    state = written(state, "components")
    look = paths.where("depth > 0").select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), F.col("parent").alias("_above"), F.col("node").alias("_piece"))
    small, gains, turn = [], [], 0
    while True:
        counts = written(state.groupBy("comp").agg(F.count("*").alias("n")), "counts")
        large = counts.where(F.col("n") > room)
        if large.isEmpty():
            small.append(state)
            break
        if not turn:
            state = _sizes(state, paths)
        turn += 1
        known = written(_salted(state, counts), "known")
        small.append(known.where(F.col("n") <= room))
        rows = known.where(F.col("n") > room).withColumn("way", 2 * F.col("size") >= F.col("n"))
        centroids = rows.where("way").groupBy("comp").agg(F.max_by(F.struct("node", "depth", "size"), "depth").alias("c"))
        met = _salted(rows, centroids)
        met = met.join(look, (F.col("conv_id") == F.col("_conv")) & (F.col("c.depth") + 1 == F.col("_depth")) & (F.col("depth") > F.col("c.depth")), "left")
        under = F.coalesce(F.col("_above") == F.col("c.node"), F.lit(False)) | (F.col("node") == F.col("c.node"))
        cut = met.select("node", "parent", "conv_id", "depth", *names, "size", "comp", "way", "c", under.alias("under"), "_piece")
        cut = written(cut, "cut")
        totals = cut.where("under").groupBy("comp").agg(*(F.sum(n).alias(n) for n in names))
        gains.append(_salted(cut.where("way").select("node", "comp"), totals).select("node", *names))
        less = F.when(F.col("way"), F.col("c.size")).otherwise(F.lit(0))
        rest = cut.where("node != c.node").select("node", "parent", "conv_id", "depth", *names, (F.col("size") - less).alias("size"), F.when(F.col("under"), F.col("_piece")).otherwise(F.col("comp")).alias("comp"))
        state = written(rest, "components")
    every = ["comp", "depth", "node", "parent", *names]
    whole = small[0].select(*every)
    for part in small[1:]:
        whole = whole.union(part.select(*every))
    found = _finish(whole, names)
    for gain in gains:
        found = found.unionByName(gain)
    return found.groupBy("node").agg(*(F.sum(n).alias(n) for n in names))


def prefix_trie(messages: DataFrame, base: Column | None = None, taken: Column | None = None, most: int = 0, room: int = COMPONENT) -> DataFrame:
    """Every node of the trie of the conversations' turns, the textless root at depth 0 included.

    ``messages`` has ``conv_id, turn, role, text``. With ``base`` and ``taken``, columns of ``conv_id``, each conversation is
    first rebuilt (see ``grafted``). Columns: ``node`` and ``parent`` (digests, the root's null), ``conv_id`` (the smallest of its
    conversations), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` over its subtree (words of
    a node's last text for each of its conversations but one), and ``ends_sha256`` (see ``ends_of``).

    Null turns come first, null roles and texts are empty, rows with a null ``conv_id`` take no part; repeated rows are turns of
    their own; an empty text has no words, and texts of any length are only hashed and counted; an empty table has no
    conversation and gives no rows; other columns are not read.
    """
    turns = written(turns_of(messages), "turns")
    none = F.lit(0).cast("long")
    convs, rebuilt = grafted(turns, base if base is not None else F.col("conv_id"), taken if taken is not None else none, most)
    paths = written(paths_of(convs, rebuilt), "paths")
    grouped = paths.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.first(c).alias(c) for c in ("depth", "parent", "words")))
    grouped = written(grouped, "nodes")
    children = grouped.where("parent is not null").groupBy(F.col("parent").alias("_node")).agg(F.count("*").alias("n_children"))
    nodes = grouped.join(children, F.col("node") == F.col("_node"), "left").drop("_node").withColumn("n_children", F.coalesce("n_children", none))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    nodes = written(nodes, "trie")
    sums = rollup(nodes, paths, ["n_leaves", "saved_tokens"], room)
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_rows"))
    placed = attach_spread(nodes.drop("n_leaves", "saved_tokens", "words"), parents, "parent", F.col("node"), "_rows") if turns.head(1) else nodes.withColumn("parent_conv_id", none)
    ends = ends_of(paths)
    result = placed.drop("_rows", "n_leaves", "saved_tokens").join(sums, "node").join(ends, "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return result.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
