"""Exact top-k inner products by columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslake.llm.common import partitions, written

QUERY_BLOCK, ROW_BLOCK, DIM_BLOCK = 512, 4096, 8
_BLOCK = pa.schema([("ids", pa.binary()), ("data", pa.binary()), ("dims", pa.int32())])


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component, x as double; null for a null vector and for null or non-finite components."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _vertical(rows: int):
    """Packs rows into blocks, each the ids and one run of values per dimension."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                ids = batch.column(0).slice(low, rows).to_numpy()
                lists = batch.column(1).slice(low, rows)
                lengths = np.diff(lists.offsets.to_numpy())
                dims = int(lengths.max(initial=0))
                flat, data = lists.flatten().to_numpy(), np.zeros((dims, len(ids)), dtype=np.int64)
                where = np.repeat(np.arange(len(ids)), lengths)
                data[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), where] = flat
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([data.tobytes()]), pa.array([dims], pa.int32())], schema=_BLOCK)

    return run


def _unpacked(ids: bytes, data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids_ = np.frombuffer(ids, dtype=np.int64)
    return ids_, np.frombuffer(data, dtype=np.int64).reshape(dims, len(ids_))


def _mass(x: np.ndarray) -> np.ndarray:
    """For each dimension block, the length of what follows of every vector, a little above its true value."""
    square = np.cumsum((x.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
    starts = list(range(DIM_BLOCK, x.shape[0], DIM_BLOCK))
    return np.sqrt(square[starts]) * (1 + 1e-12) + 1e-9 if starts else np.empty((0, x.shape[1]))


def best_of(query: np.ndarray, query_mass: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, mass: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (scores, ids) of ``best`` and a block of rows.

    Products are summed dimension block by block. After each, a row stays only if its sum and the most that the
    dimensions left can add (the product of both remaining lengths) reach the score to beat; survivors are compacted.
    """
    scores, found = best
    beat = scores[k - 1] if len(scores) >= k else None
    alive = np.flatnonzero(ids != own)
    total = np.zeros(len(alive), dtype=np.int64)
    for b, low in enumerate(range(0, rows.shape[0], DIM_BLOCK)):
        part = rows[low : low + DIM_BLOCK]
        part = part if len(alive) == rows.shape[1] else part[:, alive]
        for d in range(part.shape[0]):
            total += part[d] * query[low + d]
        if b < len(mass) and len(alive) > k:
            room = query_mass[b] * mass[b, alive]
            floor = total - room
            least = np.partition(floor, len(floor) - k)[len(floor) - k]  # k rows reach this at least
            least = least if beat is None else max(least, beat)
            keep = total + room >= least
            alive, total = alive[keep], total[keep]
    scores, found = np.concatenate([scores, total]), np.concatenate([found, ids[alive]])
    order = np.lexsort((found, -scores))[:k]
    return scores[order], found[order]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the ``k`` other rows of highest integer inner product, exactly.

    Rows are packed into vertical blocks, each block of queries meets each block of rows once, and a task keeps the best
    so far of the queries it has seen, so bounds tighten from block to block; tasks' bests are merged at the end. Ties go
    to the smaller id.

    Null ids, null vectors and vectors with a null or non-finite component take no part; shorter vectors count as
    filled up with zeros; rows with the query's id are no candidates; other ids that repeat are candidates once a row,
    and of query rows with one id the smallest vector asks; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask")).where("vec_id is not null and v is not null")
    block = "ids binary, data binary, dims int"
    asked = rows.where("ask").groupBy("vec_id").agg(F.min("v").alias("v"))
    # Written and numbered once: a task that runs again may pack other rows into its blocks.
    number = F.monotonically_increasing_id()
    queries = written(asked.mapInArrow(_vertical(QUERY_BLOCK), block).select(F.struct("ids", "data", "dims").alias("q"), number.alias("block")), "queries")
    # Every block of rows goes to every block of queries: the query set is stated, and both sides are blocks, not rows.
    numbers = [r["block"] for r in queries.select("block").collect()]  # one number for QUERY_BLOCK queries
    if not numbers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = written(rows.select("vec_id", "v").repartition(partitions(spark)).mapInArrow(_vertical(ROW_BLOCK), block).withColumn("row_block", number), "blocks")
    pairs = blocks.withColumn("block", F.explode(F.array(*map(F.lit, numbers)))).join(queries, "block").select("block", "q", "ids", "data", "dims", "row_block")

    def run(batches):
        now, best = None, {}

        def done():
            if now is None:
                return
            ids = [i for i, (s, _) in best.items() for _ in s]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([f for _, f in best.values()] or [np.empty(0, np.int64)]), pa.int64()), pa.array(np.concatenate([s for s, _ in best.values()] or [np.empty(0, np.int64)]), pa.int64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now:
                    yield from done()
                    now, best = row["block"], {}
                    q_ids, q = _unpacked(**row["q"])
                ids, data = _unpacked(row["ids"], row["data"], row["dims"])
                dims = min(len(q), len(data))
                part, mass, q_mass = data[:dims], _mass(data[:dims]), _mass(q[:dims])
                for n, own in enumerate(q_ids.tolist()):
                    best[own] = best_of(q[:dims, n], q_mass[:, n], own, ids, part, mass, k, best.get(own, (np.empty(0, np.int64), np.empty(0, np.int64))))
        yield from done()

    found = pairs.repartition(partitions(spark), "block", "row_block").sortWithinPartitions("block").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # at most k rows a task
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
