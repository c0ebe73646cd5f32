"""Links between bit fingerprints by tiles, and the components the links make."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.llm.common import partitions, written

TILE = 512
#: Fingerprints of one key that meet in one task; a larger group is dealt out as pairs of parts of this size.
GROUP = 4096
#: Runs of one key up to this size are compared all at once.
SMALL = 16


def agreeing_blocks(words: list[Column], radius: int, blocks: int | None = None, agree: int = 2) -> list[Column]:
    """Keys of which two fingerprints share at least one if they differ in ``radius`` bits at most.

    The bits are cut into ``blocks`` blocks (``radius + agree`` unless given); as ``radius`` differing bits touch
    ``radius`` blocks at most, ``agree`` whole blocks are equal, so each choice of ``agree`` blocks is a key.
    """
    blocks = blocks or radius + agree
    if blocks < radius + agree:
        raise ValueError("too few blocks to keep every link")
    cuts = [round(i * 64 * len(words) / blocks) for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), agree)):
        masks = [0] * len(words)
        for b in chosen:
            for bit in range(cuts[b], cuts[b + 1]):
                masks[bit // 64] |= 1 << bit % 64
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        keys.append(F.xxhash64(F.lit(k), *(w.bitwiseAND(F.lit(m)) for w, m in zip(words, signed) if m)))
    return keys


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links ``a`` to ``b``."""
    labels = np.arange(n)
    while len(a):
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while not np.array_equal(labels, jumped := labels[labels]):
            labels = jumped
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]
    return labels


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int):
    """Pairs of rows, tile by tile, whose fingerprints (rows of unsigned 64-bit words) differ in ``radius`` bits at most.

    Rows are taken in order of their bit counts and a pair of tiles whose counts lie further apart than ``radius`` is
    passed over: each differing bit moves the count by one at most. ``right`` None compares ``left`` with itself.
    """

    def ordered(x):
        count = np.bitwise_count(x).sum(axis=1, dtype=np.int32)
        order = np.argsort(count, kind="stable")
        return order, x[order], count[order]

    own = right is None
    at, x, cx = ordered(left)
    bt, y, cy = (at, x, cx) if own else ordered(right)
    for i in range(0, len(x), TILE):
        for j in range(i if own else 0, len(y), TILE):
            if cy[j] - cx[min(i + TILE, len(x)) - 1] > radius:
                break
            if cx[i] - cy[min(j + TILE, len(y)) - 1] > radius:
                continue
            a, b = x[i : i + TILE], y[j : j + TILE]
            apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
            for w in range(1, x.shape[1]):
                apart = apart.astype(np.uint16) + np.bitwise_count(a[:, None, w] ^ b[None, :, w])
            p, q = np.nonzero(apart <= radius)
            if own and i == j:
                p, q = p[p < q], q[p < q]
            if len(p):
                yield at[p + i], bt[q + j]


def _group_edges(ids: np.ndarray, words: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked row to the smallest id it reaches inside the group."""
    n, order = len(ids), np.argsort(ids)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    labels = np.arange(n)
    if other.any():
        one, two = np.flatnonzero(~other), np.flatnonzero(other)
        found = ((one[a], two[b]) for a, b in tile_links(words[one], words[two], radius)) if len(one) and len(two) else ()
    else:
        found = tile_links(words, None, radius)
    for a, b in found:
        a, b = labels[place[a]], labels[place[b]]
        new = a != b
        if new.any():
            labels = labels_of(n, a[new], b[new])[labels]
    sorted_ids = ids[order]
    linked = labels != np.arange(n)
    return sorted_ids[linked], sorted_ids[labels[linked]]


def _edges(key: np.ndarray, ids: np.ndarray, words: np.ndarray, other: np.ndarray, radius: int, keep=None, group=None) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside each run of equal keys (rows of several columns), small runs all at once.

    Of small runs, all near pairs that ``keep`` accepts; of a larger one, what ``group`` makes of it.
    """
    group = group or (lambda part: _group_edges(ids[part], words[part], other[part], radius))
    cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
    bounds = np.concatenate([[0], cut, [len(ids)]])
    size = np.diff(bounds)
    out_a, out_b = [], []
    small = (size > 1) & (size <= SMALL)
    rows = np.concatenate([np.arange(a, b) for a, b in zip(bounds[:-1][small], bounds[1:][small])] or [np.empty(0, np.int64)]).astype(np.int64)
    run = np.repeat(np.flatnonzero(small), size[small])
    for step in range(1, SMALL):
        a, b = rows[:-step], rows[step:]
        same = run[:-step] == run[step:]
        if not same.any():
            break
        a, b = a[same], b[same]
        near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int32) <= radius
        cross = (key[a, 1] == key[a, 2]) | (other[a] != other[b])
        a, b = a[near & cross], b[near & cross]
        if keep is not None:
            kept = keep(a, b)
            a, b = a[kept], b[kept]
        out_a.append(np.maximum(ids[a], ids[b]))
        out_b.append(np.minimum(ids[a], ids[b]))
    for k in np.flatnonzero(size > SMALL):
        a, b = group(slice(bounds[k], bounds[k + 1]))
        out_a.append(a)
        out_b.append(b)
    return np.concatenate(out_a or [np.empty(0, np.int64)]), np.concatenate(out_b or [np.empty(0, np.int64)])


def keys_of(nodes: DataFrame, keys: list[Column]) -> DataFrame:
    return nodes.select("id", "words", F.explode(F.array(*keys)).alias("key"))


def links(nodes: DataFrame, keys: list[Column], radius: int, edges=_edges, only: DataFrame | None = None) -> DataFrame:
    """Edges ``(a, b)``, ``a > b``, that join the same components as all links between ``nodes``.

    ``nodes`` has ``id`` (long, distinct) and ``words`` (array of longs). Two nodes are compared if they share one of
    ``keys``. Each group of a key is compared exactly, tile by tile, and gives one edge a linked node at most, not all
    pairs. A group of more than ``GROUP`` nodes is dealt out by hash to parts that meet in pairs, so no task holds it.
    ``edges`` chooses what a run of rows gives (see ``near_pairs``); ``only`` has the keys to look at, if not all.
    """
    spark = nodes.sparkSession
    keyed = keys_of(nodes, keys)
    if only is not None:
        keyed = keyed.join(only, "key", "left_semi")
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
    parts = F.ceil(F.coalesce("n", F.lit(1)) / GROUP).cast("int")
    dealt = keyed.join(large, "key", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    meet = dealt.select("key", "id", "words", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    rows = meet.select("key", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "id", "words", (F.col("own") > F.col("with")).alias("other"))

    def run(batches):
        held = None
        for batch in (*batches, None):
            if batch is not None:
                if not batch.num_rows:
                    continue
                words = batch.column(4).flatten().to_numpy().astype(np.int64).view(np.uint64).reshape(batch.num_rows, -1)
                now = (np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)]), batch.column(3).to_numpy(), words, batch.column(5).to_numpy(zero_copy_only=False))
                held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
                change = np.flatnonzero((held[0] != held[0][-1]).any(axis=1))
                end = change[-1] + 1 if len(change) else 0
            elif held is None:
                return
            else:
                end = len(held[1])
            if end:
                a, b = edges(*(x[:end] for x in held), radius)
                held = tuple(x[end:] for x in held)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt_out = rows.repartition(partitions(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt_out.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for each id that has an edge, root the smallest id it reaches, itself excluded.

    Alternates the two star steps of connected components: each node hands its larger, then its smaller neighbours to
    the smallest it knows, until nothing changes. Each round is a written table.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        state = now
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", "m"))
        edges = written(small.where("u != v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
