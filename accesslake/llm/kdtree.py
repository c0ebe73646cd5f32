"""Shards of near equal size by a k-d tree over metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.llm.common import running, written

#: Histogram cells a node and round.
CELLS = 2048
_VALUES = (1 << 30) - 1


@dataclass
class Node:
    shards: int
    first: int
    rows: int = 0
    size: int = 0
    dim: int = 0
    low: int = 0
    high: int = 0
    before: int = 0
    cut: int | None = None


def _pick(values: list, node: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), node + 1)


def assign(rows: DataFrame, dims: list[str], size: str, tie: Column, shards: int) -> DataFrame:
    """``rows`` with ``shard``: leaves of a tree that halves its nodes at weighted medians.

    A node that is to hold ``k`` shards is split along the dimension that is widest in it (its range over that of the
    whole table) where ``k // 2`` of ``k`` parts of the node's bytes lie below. The median is found by histograms: each
    round counts bytes in at most ``CELLS`` cells a node and looks closer at the cell that holds the cut, so only cell
    sums come to the driver. A value that many rows share is cut by ``tie``, so hot values don't unbalance the shards.
    Null metadata counts as the smallest value. ``rows`` is read about four times a level and should be written.
    """
    spans = rows.agg(*(f(F.col(d)).cast("double").alias(f"{n}_{d}") for d in dims for n, f in (("low", F.min), ("high", F.max)))).first()
    keys = []
    for d in dims:
        low, high = spans[f"low_{d}"], spans[f"high_{d}"]
        value = F.coalesce((F.col(d).cast("double") - low) / (high - low), F.lit(0.0)) if low is not None and high > low else F.lit(0.0)
        keys.append(F.shiftleft(F.floor(value * _VALUES).cast("long"), 32) + tie.bitwiseAND(F.lit(0xFFFFFFFF)))
    state = rows.select("*", *(k.alias(f"_key{i}") for i, k in enumerate(keys))).withColumn("_node", F.lit(0))
    nodes = [Node(shards, 0)]
    while any(n.shards > 1 for n in nodes):
        _measure(state, nodes, len(dims), size)
        _cut(state, nodes, size)
        state, nodes = _descend(state, nodes)
    return state.select(*(F.col(c) for c in rows.columns), _pick([n.first for n in nodes], F.col("_node")).cast("int").alias("shard"))


def _measure(state: DataFrame, nodes: list[Node], dims: int, size: str) -> None:
    ranges = [f(F.col(f"_key{i}")).alias(f"{n}{i}") for i in range(dims) for n, f in (("low", F.min), ("high", F.max))]
    for r in state.groupBy("_node").agg(F.count("*").alias("rows"), F.sum(size).alias("size"), *ranges).collect():
        node = nodes[r["_node"]]
        node.rows, node.size = r["rows"], r["size"]
        node.dim = max(range(dims), key=lambda i: ((r[f"high{i}"] >> 32) - (r[f"low{i}"] >> 32), -i))
        node.low, node.high = r[f"low{node.dim}"], r[f"high{node.dim}"]


def _cut(state: DataFrame, nodes: list[Node], size: str) -> None:
    """Finds each node's cut: rows with a key up to it go to the lower child."""
    node = F.col("_node")
    key = _pick([n.dim for n in nodes], node)
    key = F.element_at(F.array(*(F.col(c) for c in state.columns if c.startswith("_key"))), key + 1)
    open_ = [i for i, n in enumerate(nodes) if n.shards > 1 and n.rows]
    while open_:
        step = [max(1, -(-(n.high - n.low + 1) // CELLS)) for n in nodes]
        cell = F.floor((key - _pick([n.low for n in nodes], node)) / _pick(step, node))
        inside = F.array_contains(F.array(*map(F.lit, open_)), node) & key.between(_pick([n.low for n in nodes], node), _pick([n.high for n in nodes], node))
        cells = state.where(inside).groupBy("_node", cell.alias("cell")).agg(F.sum(size).alias("size"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        still = []
        for i in open_:
            n = nodes[i]
            goal, done = n.size * (n.shards // 2) / n.shards, n.before
            for r in sorted((r for r in cells if r["_node"] == i), key=lambda r: r["low"]):
                if done + r["size"] >= goal:
                    break
                done += r["size"]
            if r["low"] == r["high"] or r["size"] <= 1:
                n.cut = r["high"] if done + r["size"] - goal <= goal - done else r["low"] - 1
            else:
                n.low, n.high, n.before = r["low"], r["high"], done
                still.append(i)
        open_ = still


def _descend(state: DataFrame, nodes: list[Node]) -> tuple[DataFrame, list[Node]]:
    below, children, place = [], [], []
    for n in nodes:
        place.append(len(children))
        if n.shards == 1:
            children.append(n)
        else:
            half = n.shards // 2
            children += [Node(half, n.first), Node(n.shards - half, n.first + half)]
        below.append(n.cut if n.cut is not None else (1 << 62))
    node = F.col("_node")
    keys = F.array(*(F.col(c) for c in state.columns if c.startswith("_key")))
    key = F.element_at(keys, _pick([n.dim for n in nodes], node) + 1)
    return written(state.withColumn("_node", _pick(place, node) + (key > _pick(below, node)).cast("int")), "tree"), children


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row: shards of near equal bytes, slots gapless in id order.

    ``dims`` are the metadata columns the tree splits by; by default the language, the source and the length. A row
    weighs its text's UTF-8 bytes plus one. To reach a target size, ask for the total over the target shards.

    Null text weighs one and has the checksum of the empty text; a null id sorts first and ties as any value; rows with
    one id follow one another; an empty table gives no rows; other columns than those of ``dims`` are not read. Only
    ids, sizes, checksums and metadata are written and shuffled, never the texts.
    """
    place = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")).cast("double")
    if dims is None:
        dims = {c: place(c) for c in ("lang", "source") if c in docs.columns} | {"length": F.log2(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(1))}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *(c.alias(f"_dim_{i}") for i, c in enumerate(dims.values())),
    )
    rows = written(rows, "shard-rows")
    placed = assign(rows, [f"_dim_{i}" for i in range(len(dims))], "size", F.xxhash64("doc_id", "text_crc32"), shards)
    numbered = running(placed.select("doc_id", "size", "text_crc32", "shard"), ["doc_id", "text_crc32"], {"slot": F.lit(1)}, group=["shard"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot")
