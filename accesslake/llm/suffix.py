"""Removal of long repeated byte strings by suffix arrays in shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslake.llm.common import partitions, slices, unused_name, written

#: Bytes of one suffix array; a key's text beyond that is put into several, merged by binary search.
SHARD = 1 << 20
#: Distinct text of one key beyond which its strings are compared by digests over all tasks instead.
KEY_BYTES = 2 << 20
#: Up to so many large keys are broadcast; more are joined.
BROADCAST_KEYS = 100_000
GRAM = 64
LANES = 2048


def _table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_HASH = _table()


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on, by doubling: long hashes are made of two shorter ones."""
    h, done, out, at = BYTE_HASH[data], 1, None, 0
    while True:
        if size & done:
            part = h[at:]
            if out is None:
                out, at = part, done
            else:
                n = min(len(out), len(part))
                out = out[:n] * np.uint64(0xD6E8FEB86659FD93) + part[:n]
                out ^= out >> np.uint64(32)
                at += done
        if 2 * done > size:
            return out[: max(0, len(data) - size + 1)]
        low = h[:-done] * np.uint64(0xA0761D6478BD642F) if len(h) > done else h[:0]
        h = low + h[done:]
        h ^= h >> np.uint64(29)
        done *= 2


def sliding(pick, x: np.ndarray, size: int) -> np.ndarray:
    """The least or greatest (``pick``) of each ``size`` numbers in a row, by doubling."""
    width, full = 1, len(x) - size + 1
    while 2 * width <= size:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[:full], x[size - width : size - width + full])


def windows(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, first start, starts, inner)``: the strings of ``length`` bytes by runs of one key.

    A string's key is the smallest hash of a gram in it, so equal strings have equal keys wherever they stand. ``inner``
    tells runs that may hold a string twice: their smallest gram occurs again.
    """
    gram = min(GRAM, length)
    grams = length - gram + 1
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    h = gram_hashes(data, gram)
    least = sliding(np.minimum, h, grams)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    n = np.diff(np.concatenate([first, [len(least)]]))
    edge = np.zeros(grams - 1, least.dtype)
    chosen = np.flatnonzero(h == sliding(np.maximum, np.concatenate([edge, least, edge]), grams))  # smallest of some window
    again = (h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) <= grams)
    pairs = np.concatenate([[0], np.cumsum(again)])
    low = np.searchsorted(chosen, first)
    high = np.searchsorted(chosen, first + n + grams - 2, side="right") - 1
    return least[first], first, n, pairs[np.maximum(high, low)] > pairs[low]


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order and each one's rank, by Larsson and Sadakane's refinement.

    Suffixes are first sorted by eight bytes. Then each group of equals is sorted by the ranks of what follows its
    sorted depth, which doubles every round; groups of one take no further part.
    """
    n = len(data)
    word = words(data)
    short = np.minimum(n - np.arange(n), 8).astype(np.int64)  # a suffix that ends comes before its extensions
    order = np.lexsort((short[max(0, n - 8) :], word[max(0, n - 8) :])) if n <= 8 else np.argsort(word, kind="stable")
    if n > 8:  # among equal words, those that ran over the end first, shortest first
        tail = np.arange(n - 7, n)
        equal = np.isin(word[order], word[tail])
        part = order[equal]
        order[equal] = part[np.lexsort((short[part], word[part]))]
    new = np.ones(n, dtype=bool)
    a, b = order[1:], order[:-1]
    new[1:] = (word[a] != word[b]) | (short[a] != short[b])
    rank = np.empty(n, dtype=np.int64)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    alone = new & np.append(new[1:], True)
    active, depth = np.flatnonzero(~alone), 8
    while len(active):
        rows = order[active]
        follow = rows + depth
        key = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        group = rank[rows]
        by = np.argsort(group * (n + 1) + key, kind="stable")
        rows, key, group = rows[by], key[by], group[by]
        order[active] = rows
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        rank[rows] = active[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        active = active[~(new & np.append(new[1:], True))]
        depth *= 2
    return order, rank


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n, x = len(data), padded
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    return x[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, cap: int) -> np.ndarray:
    """For each place of the suffix array, the bytes shared with the place before, ``cap`` at most.

    Kasai's walk through the text, in many lanes at once: each lane owns a stretch of the text, goes on from a suffix to
    the next with one byte less and compares eight bytes a step.
    """
    n = len(data)
    before = np.empty(n, dtype=np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n
    word, out = np.append(words(data), np.uint64(0)), np.zeros(n, dtype=np.int64)
    lanes = max(1, min(LANES, n // 64))
    bounds = np.linspace(0, n, lanes + 1).astype(np.int64)
    at, end, h = bounds[:-1].copy(), bounds[1:], np.zeros(lanes, dtype=np.int64)
    live = at < end
    at, end, h = at[live], end[live], h[live]
    while len(at):
        other = before[at]
        differ = word[np.minimum(at + h, n)] ^ word[np.minimum(other + h, n)]
        top = np.frexp((differ & ~(differ >> np.uint64(1))).astype(np.float64))[1]  # the length in bits
        h += (64 - top) >> 3
        stop = (differ != 0) | (h >= cap) | (np.maximum(at, other) + h >= n)
        ended = np.flatnonzero(stop)
        shared = np.maximum(np.minimum(np.minimum(h[ended], cap), n - np.maximum(at[ended], other[ended])), 0)
        out[rank[at[ended]]] = shared
        at[ended] += 1
        h[ended] = np.maximum(shared - 1, 0)
        live = at < end
        if not live.all():
            at, end, h = at[live], end[live], h[live]
    return out


class Shard:
    """Contexts laid end to end with their suffix array; ``starts`` are the strings of ``length`` bytes inside contexts."""

    def __init__(self, contexts: list[bytes], counts: np.ndarray, length: int):
        self.data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
        sizes = np.array([len(c) for c in contexts], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        inside = sizes - length + 1
        self.starts = np.repeat(self.first, inside) + (np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside))
        self.length, self.inside = length, inside
        order, rank = suffix_array(self.data)
        shared = common_prefixes(self.data, order, rank, length)
        kind = np.cumsum(shared < length)
        own = kind[rank[self.starts]]
        _, self.kind = np.unique(own, return_inverse=True)
        self.total = np.bincount(self.kind, np.repeat(counts, inside)).astype(np.int64)
        by_rank = np.argsort(rank[self.starts])
        _, pick = np.unique(self.kind[by_rank], return_index=True)
        self.sorted = self.starts[by_rank][np.sort(pick)]  # one start a kind, in order of the strings
        self.sorted_kind = self.kind[by_rank][np.sort(pick)]

    def strings(self, starts: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.data, self.length)[starts]

    def merge(self, other: Shard) -> None:
        """Adds up the counts of strings that both shards have; each of the other's is searched in this one's order."""
        mine, theirs = self.total.copy(), other.total.copy()
        for low in range(0, len(other.sorted), 4096):
            wanted = other.strings(other.sorted[low : low + 4096])
            left, right = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.sorted))
            while (left < right).any():
                middle = np.minimum((left + right) // 2, len(self.sorted) - 1)
                found = self.strings(self.sorted[middle])
                differ = found != wanted
                at = differ.argmax(axis=1)
                row = np.arange(len(wanted))
                less = differ.any(axis=1) & (found[row, at] < wanted[row, at]) & (left < right)
                right = np.where(less | (left >= right), right, middle)
                left = np.where(less, middle + 1, left)
            hit = left < len(self.sorted)
            hit[hit] = (self.strings(self.sorted[left[hit]]) == wanted[hit]).all(axis=1)
            a, b = self.sorted_kind[left[hit]], other.sorted_kind[low : low + 4096][hit]
            self.total[a] += theirs[b]
            other.total[b] += mine[a]

    def repeated(self):
        """For each context the runs of starts whose string occurs more than once, as ``(from, to)`` arrays, to excluded."""
        twice = self.total[self.kind] > 1
        cut = np.cumsum(self.inside)
        for first, end in zip(cut - self.inside, cut):
            yield runs_of(twice[first:end])


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_FOUND = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("froms", pa.list_(pa.int64())), ("tos", pa.list_(pa.int64()))])


def _by_shards(length: int):
    """Contexts sorted by key, shard by shard: keys share a suffix array, a key larger than one has several, merged."""

    def solve(held: list[tuple]):
        shards, part, size = [], [], 0
        for row in held:
            if part and size + len(row[3]) > SHARD:
                shards.append(part)
                part, size = [], 0
            part.append(row)
            size += len(row[3])
        shards.append(part)
        built = [Shard([r[3] for r in p], np.array([r[4] for r in p]), length) for p in shards]
        for i, one in enumerate(built):
            for other in built[:i]:
                other.merge(one)
        for p, one in zip(shards, built):
            rows = [(r[1], r[2], a, b) for r, (a, b) in zip(p, one.repeated()) if len(a)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _FOUND)], schema=_FOUND)

    def run(batches):
        held, size, key_at = [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and row[0] != held[-1][0]:
                    if size >= SHARD // 2:
                        yield from solve(held)
                        held, size = [], 0
                    key_at = len(held)
                elif size + len(row[3]) > SHARD and key_at:
                    # the key that grows goes on alone, so that only its own shards are merged
                    yield from solve(held[:key_at])
                    held, key_at = held[key_at:], 0
                    size = sum(len(r[3]) for r in held)
                held.append(row)
                size += len(row[3])
        if held:
            yield from solve(held)

    return run


def _digests(length: int):
    """Every string of the contexts as a digest of 128 bits, with its place."""

    def run(batches):
        import xxhash

        for batch in batches:
            for c1, c2, text, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                count = len(text) - length + 1
                for low in range(0, count, 1 << 14):
                    high = min(count, low + (1 << 14))
                    d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[s : s + length]) for s in range(low, high)]), dtype=np.int64).reshape(-1, 2)
                    m = high - low
                    yield pa.RecordBatch.from_arrays([pa.array([c1] * m), pa.array([c2] * m), pa.array(np.arange(low, high)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array([n] * m, pa.int64())], names=["c1", "c2", "start", "d1", "d2", "n"])

    return run


SPANS = "array<struct<from:long,to:long>>"


def _same():
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))


def _renamed(spans: DataFrame) -> DataFrame:
    return spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), *spans.columns[2:])


def _repeats(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The spans of ``repeated_spans``, and the written texts that may have any.

    1. Each text is cut into runs of strings with one key (the smallest gram hash in the string); only keys, ids and
       places leave the task. Keys of a single run, if nothing repeats inside it, are dropped: their strings occur once.
    2. The texts that keep keys give the runs' bytes. Equal contexts are counted, not copied, which takes the weight out
       of copies and of passages that many texts share.
    3. Contexts are dealt out by key to shards. A shard's suffix array and common prefixes give the strings it has more
       than once; a key of several shards has them merged by binary search; a key beyond ``KEY_BYTES`` of different
       contexts is compared by 128-bit digests of its strings over all tasks, so no key has to fit into one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= length)

    def keys(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [windows(np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8), length) for x in part.column(2).to_pylist()]
                times = np.array([len(f[0]) for f in found])
                take = pa.array(np.repeat(np.arange(len(found)), times))
                cat = [np.concatenate([f[i] for f in found]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(cat[0].view(np.int64)), *map(pa.array, cat[1:])], names=["doc_id", "text_hash", "key", "first", "n", "inner"])

    runs = written(rows.mapInArrow(keys, "doc_id long, text_hash long, key long, first long, n long, inner boolean"), "runs")
    often = runs.groupBy("key").agg(F.count("*").alias("times"), F.max("inner").alias("inner")).where("times > 1 or inner").select("key")
    chosen = runs.join(often, "key", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("key", "first", "n")).alias("runs"))  # a set: repeated rows give their runs once
    texts = written(rows.join(_renamed(chosen), _same()).select("doc_id", "text_hash", "text", "runs"), "texts")

    def cut(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                out = [[] for _ in range(5)]
                for row in batch.slice(low, 64).to_pylist():
                    data = row["text"].encode("utf-8", "surrogatepass")
                    for r in row["runs"]:
                        for column, value in zip(out, (row["doc_id"], row["text_hash"], r["first"], r["key"], data[r["first"] : r["first"] + r["n"] - 1 + length])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.binary()])], names=["doc_id", "text_hash", "first", "key", "context"])

    places = texts.select("doc_id", "text_hash", "text", "runs").mapInArrow(cut, "doc_id long, text_hash long, first long, key long, context binary")
    named = lambda df: df.withColumn("c1", F.xxhash64("key", "context")).withColumn("c2", F.xxhash64(F.lit(1), "context"))
    contexts = written(named(places).groupBy("key", "c1", "c2", "context").agg(F.count("*").alias("n")), "contexts")
    sizes = contexts.groupBy("key").agg(F.sum(F.octet_length("context")).alias("bytes"), F.sum("n").alias("times"))
    large = written(sizes.where(F.col("bytes") > KEY_BYTES).select("key"), "large-keys")
    many = large.count()
    fields = ["key", "c1", "c2", "context", "n"]
    usual, spread = contexts.select(*fields), contexts.limit(0).select(*fields)
    if many:  # without large keys no context has to be dealt out for this
        side = F.broadcast(large) if many <= BROADCAST_KEYS else large
        usual, spread = usual.join(side, "key", "left_anti").select(*fields), usual.join(side, "key", "left_semi").select(*fields)
    parts = partitions(docs.sparkSession)
    found = usual.repartition(parts, "key").sortWithinPartitions("key", "c1").mapInArrow(_by_shards(length), "c1 long, c2 long, froms array<long>, tos array<long>")
    spread = spread.repartition(parts, "c1")
    strings = spread.mapInArrow(_digests(length), "c1 long, c2 long, start long, d1 long, d2 long, n long")
    twice = strings.groupBy("d1", "d2").agg(F.sum("n").alias("times")).where("times > 1").select("d1", "d2")
    single = strings.join(twice, ["d1", "d2"], "left_semi").groupBy("c1", "c2").agg(F.collect_list("start").alias("froms"))
    single = single.select("c1", "c2", "froms", F.transform("froms", lambda x: x + 1).alias("tos"))
    found = written(found.unionByName(single), "repeats")
    hits = named(places).select("doc_id", "text_hash", "first", "c1", "c2").join(found, ["c1", "c2"])
    pieces = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "froms", "tos")).alias("pieces"))  # a set, for repeated rows

    def join(batches):
        for batch in batches:
            out = []
            for found_in in batch.column(2).to_pylist():
                a = np.concatenate([np.add(p["froms"], p["first"]) for p in found_in])
                b = np.concatenate([np.add(p["tos"], p["first"]) for p in found_in]) - 1 + length
                by = np.argsort(a)
                a, b = a[by], np.maximum.accumulate(b[by])
                new = np.concatenate([[True], a[1:] > b[:-1]])
                out.append([{"from": int(x), "to": int(y)} for x, y in zip(a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], names=["doc_id", "text_hash", "spans"])

    return pieces.mapInArrow(join, f"doc_id long, text_hash long, spans {SPANS}"), texts


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash`` and ``spans`` (sorted, disjoint byte ranges, ``to`` excluded) of each text with repeated strings.

    A byte is covered by a string of ``length`` bytes that starts anywhere else as well, in the same text or another;
    strings never cross texts. ``text_hash`` is ``xxhash64`` of the text; rows that agree in id and hash are given once.

    Null and shorter texts repeat nothing; null ids are ids as any other; repeated rows repeat each other; runs of one
    byte are one context; an empty table gives no rows; other columns are not read.
    """
    return _repeats(docs, length, id_col, text_col)[0]


def cut_texts(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_removed, n_spans, kept`` (bytes) of each text that loses something, given once.

    Rows, nulls and lengths as in ``repeated_spans``; a text that is lost whole has no bytes in ``kept``.
    """
    spans, texts = _repeats(docs, length, id_col, text_col)
    joined = texts.select("doc_id", "text_hash", "text").join(_renamed(spans), _same()).select("doc_id", "text_hash", "text", "spans")

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                spans = part.column(3).to_pylist()
                kept = [without(x.encode("utf-8", "surrogatepass"), s) for x, s in zip(part.column(2).to_pylist(), spans)]
                removed = [sum(x["to"] - x["from"] for x in s) for s in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "text_hash", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, text_hash long, n_removed long, n_spans long, kept binary").dropDuplicates(["doc_id", "text_hash"])


def without(data: bytes, spans: list[dict], whole_characters: bool = False) -> bytes:
    """``data`` without the spans; with ``whole_characters`` a character that a span cuts stays."""
    out, at = [], 0
    for span in spans:
        low, high = span["from"], span["to"]
        if whole_characters:
            while low < high and low < len(data) and data[low] & 0xC0 == 0x80:
                low += 1
            while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
                high -= 1
        out.append(data[at:low])
        at = high
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated spans taken out of the text; all rows and columns stay, and so do characters cut in two.

    Null texts stay null, shorter ones as they are; rows with null ids are cut as any other; repeated rows repeat each
    other and lose all of a text that is long enough; columns may have any names; an empty table gives no rows.
    """
    spans = repeated_spans(docs, length, id_col, text_col).select("doc_id", "text_hash", F.col("spans").alias(unused_name(docs, "spans"))).alias("found")
    rows = docs.alias("rows")
    of, text = F.col(f"rows.`{id_col}`"), F.col(f"rows.`{text_col}`")
    same = of.cast("long").eqNullSafe(F.col("found.doc_id")) & (F.xxhash64(text) == F.col("found.text_hash"))
    joined = rows.join(spans, same, "left").select(*(F.col(f"rows.`{c}`") for c in docs.columns), spans.columns[-1])
    at, fields = docs.columns.index(text_col), docs.schema

    def run(batches):
        for batch in slices(batches):
            texts = [x if not s else without(x.encode("utf-8", "surrogatepass"), s, True).decode("utf-8", "surrogatepass") for x, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = [batch.column(i) if i != at else pa.array(texts, batch.column(at).type) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return joined.mapInArrow(run, fields)
