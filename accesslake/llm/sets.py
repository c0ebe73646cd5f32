"""Sets of word shingles, and links between them verified where they meet, so that only edges leave a group.

Groups of candidates are named by keys. A group's sets are shipped to one task once, however many of its keys name the
same members; the task compares them and gives a spanning forest of the links it confirmed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslake.llm.common import partitions, written
from accesslake.llm.links import components, tile_links

#: Set members that meet in one task (8 bytes each); larger groups are dealt out.
ROOM = 1 << 20
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """XXH64 of words, remembered; ``most`` words at once."""

    def __init__(self, most: int = 1 << 16):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, shingle: int, known: WordHashes) -> np.ndarray:
    """Hashes of the different runs of ``shingle`` words, ascending; of all words if they are fewer; none without words.

    A-Z are lower-cased and words are what white space U+0020 and U+0009 to U+000D leaves.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(shingle, len(words))
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        total = total * np.uint64(_STEP) + h[j : len(h) - size + 1 + j]
    return np.unique(mixed(total))


def sized_pairs(sizes: np.ndarray, percent: int):
    """Each row, by size, with the later ones whose size alone doesn't rule the link out."""
    order = np.argsort(sizes, kind="stable")
    ends = np.searchsorted(sizes[order] * percent, sizes[order] * 100, side="right")
    for i, end in enumerate(ends):
        if end > i + 1:
            yield order[i], order[i + 1 : end]


def tiled_pairs(words: np.ndarray, radius: int):
    """Each row with later ones whose fingerprints differ in ``radius`` bits at most, tile by tile."""
    for a, b in tile_links(words, None, radius):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cut = np.flatnonzero(np.diff(a)) + 1
        for low, high in zip([0, *cut], [*cut, len(a)]):
            yield a[low], b[low:high]


def confirmed(roots: np.ndarray, values: np.ndarray, ends: np.ndarray, percent: int, pairs) -> tuple[list[int], list[int]]:
    """Indices of linked rows that join all that the links among ``pairs`` join beyond ``roots``.

    Row i's set is ``values[ends[i]:ends[i + 1]]``. Sets are linked if ``percent`` of their union is common.
    """
    sizes = np.diff(ends)
    _, at = np.unique(values, return_inverse=True)
    mark = np.zeros(len(at), dtype=bool)
    _, labels = np.unique(roots, return_inverse=True)
    out_a, out_b = [], []
    for i, others in pairs:
        js = others[labels[others] != labels[i]]
        js = js[np.minimum(sizes[js], sizes[i]) * 100 >= np.maximum(sizes[js], sizes[i]) * percent]
        if not len(js):
            continue
        own = at[ends[i] : ends[i + 1]]
        mark[own] = True
        taken = np.concatenate([at[ends[j] : ends[j + 1]] for j in js])
        shared = np.add.reduceat(mark[taken], np.concatenate([[0], np.cumsum(sizes[js])[:-1]]), dtype=np.int64)
        mark[own] = False
        linked = js[shared * 100 >= percent * (sizes[js] + sizes[i] - shared)]
        for j in linked:
            if labels[j] != labels[i]:
                labels[labels == labels[j]] = labels[i]
                out_a.append(i)
                out_b.append(j)
    return out_a, out_b


def _verified(groups: DataFrame, percent: int, radius: int | None) -> DataFrame:
    """Edges ``(a, b)`` confirmed in each group of ``key, part, other, node, root, words, hashes``."""

    def edges(key_nodes):
        nodes, roots, words, values, ends = key_nodes
        if len(nodes) < 2 or (roots == roots[0]).all():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = sized_pairs(np.diff(ends), percent) if radius is None else tiled_pairs(words, radius)
        a, b = confirmed(roots, values, ends, percent, pairs)
        return nodes[a], nodes[b]

    def run(batches):
        held = None
        for batch in (*batches, None):
            if batch is not None:
                if not batch.num_rows:
                    continue
                lists = batch.column(6)
                words = batch.column(5)
                width = len(words.flatten()) // batch.num_rows
                keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
                now = (keys, batch.column(3).to_numpy(), batch.column(4).to_numpy(), words.flatten().to_numpy().view(np.uint64).reshape(-1, width), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))
                held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
                change = np.flatnonzero((held[0] != held[0][-1]).any(axis=1))
                end = change[-1] + 1 if len(change) else 0
            elif held is None:
                return
            else:
                end = len(held[1])
            if end:
                keys, nodes, roots, words, values, sizes = held
                ends = np.concatenate([[0], np.cumsum(sizes)])
                cut = np.concatenate([[0], np.flatnonzero((keys[1:end] != keys[: end - 1]).any(axis=1)) + 1, [end]])
                found = [edges((nodes[x:y], roots[x:y], words[x:y], values[ends[x] : ends[y]], ends[x : y + 1] - ends[x])) for x, y in zip(cut[:-1], cut[1:])]
                held = (keys[end:], nodes[end:], roots[end:], words[end:], values[ends[end] :], sizes[end:])
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], names=["a", "b"])

    dealt = groups.repartition(partitions(groups.sparkSession), "key", "part", "other").sortWithinPartitions("key", "part", "other", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _open_groups(members: DataFrame) -> DataFrame:
    """One key of each set of members: ``key``, its ``total`` of set members and its ``pivot``."""
    seal = [F.bit_xor(F.xxhash64(F.lit(k), F.col("node"))).alias(f"seal_{k}") for k in range(2)]
    groups = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("node").alias("pivot"), *seal)
    return groups.groupBy("n", "total", "pivot", "seal_0", "seal_1").agg(F.min("key").alias("key")).select("key", "total", "pivot")


def _rooted(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    """``rows`` with each node's ``root``, the smallest node that it reaches over ``edges``."""
    if edges is None:
        return rows.withColumn("root", F.col("node"))
    roots = components(edges).select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    return rows.join(roots, F.col("node") == F.col("_id"), "left").select(*rows.columns, F.coalesce("_root", "node").alias("root"))


def linked(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, rounds: list[int], radius: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` that join what all links join, between nodes that share one of their ``keys``.

    ``nodes`` has ``node`` (long, distinct), ``size`` of its set (1 at least), ``keys`` (array of longs) and ``words`` (a
    fingerprint, or one zero). ``sets_of(named)`` adds the ``hashes`` to the rows of ``named``, one a ``node``. Sets are linked
    if ``percent`` of their union is common; with ``radius``, only those whose fingerprints lie so near are compared.

    ``rounds`` says how many keys are taken at once: after each, groups whose members are all joined are left out, so a
    group of copies is compared once and not once a key. A group with more than ``ROOM`` set members is dealt to parts by
    hash, which meet one common pivot; of those still not joined, the members outside the group's largest component
    then meet all its parts. Nothing is capped, and no pairs are written, only confirmed edges of forests.
    """
    found, low = None, 0
    for count in rounds:
        rooted = _rooted(nodes.select("node", "size", F.slice("keys", low + 1, count).alias("keys")), found)
        low += count
        keyed = written(rooted.select("node", "size", "root", F.explode("keys").alias("key")), "keyed")
        many = written(keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "many")
        members = written(keyed.join(many, "key"), "unjoined")
        members = written(members.join(_open_groups(members), "key"), "members")
        parts = F.ceil(F.col("total") / ROOM).cast("int")
        own = F.pmod(F.xxhash64("node"), parts).cast("int")
        whole = members.withColumn("part", F.explode(F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own)))).withColumn("other", F.lit(0))
        shipped = _shipped(whole, nodes, sets_of)
        edges = written(_verified(shipped, percent, radius), "links")
        found = edges if found is None else written(found.union(edges), "links")
        large = members.where(F.col("total") > ROOM).drop("root")
        if not large.isEmpty():
            found = written(found.union(_across(written(_rooted(large, found), "large"), nodes, sets_of, percent, radius)), "links")
    return found


def _shipped(rows: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The sets of the ``node`` of ``rows`` at each ``key, part, other`` that ``rows`` name for it.

    Where a node is wanted is listed first, a few numbers a key, so that its set goes there straight from where it is made.
    """
    meets = rows.groupBy("node", "root").agg(F.collect_list(F.struct("key", "part", "other")).alias("meets"))
    sets = sets_of(nodes.select("node", "words").join(meets, "node"))
    return sets.select("node", "root", "words", "hashes", F.explode("meets").alias("at")).select("at.key", "at.part", "at.other", "node", "root", "words", "hashes")


def _across(large: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, radius: int | None) -> DataFrame:
    """Edges between parts of groups too large for one task, where not all members are joined."""
    by_root = large.groupBy("key", "root").agg(F.sum("size").alias("weight"))
    most = by_root.groupBy("key").agg(F.max(F.struct("weight", "root")).alias("most"), F.sum("weight").alias("all"))
    most = most.where("most.weight < all").select("key", F.col("most.root").alias("main"), F.greatest(F.lit(1), F.ceil(F.col("most.weight") / ROOM)).cast("int").alias("inside"), F.ceil((F.col("all") - F.col("most.weight")) / ROOM).cast("int").alias("outside"))
    rows = large.join(most, "key").withColumn("main", F.col("root") == F.col("main"))
    hashed = F.xxhash64("node")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # Parts of outsiders are numbered from 0, those of the largest component follow; a task has one part of each, or two of outsiders.
    at = F.when(F.col("main"), F.col("outside") + F.pmod(hashed, "inside")).otherwise(F.pmod(hashed, "outside")).cast("int")
    rows = rows.withColumn("at", at)
    meets = F.when(F.col("main"), every(F.col("outside"))).otherwise(every(F.col("outside") + F.col("inside")))
    dealt = rows.withColumn("with", F.explode(meets)).select("key", F.least("at", "with").alias("part"), F.greatest("at", "with").alias("other"), "node", "root")
    return _verified(_shipped(dealt, nodes, sets_of), percent, radius)
