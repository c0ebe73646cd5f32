"""Helpers the operators of this package share: written tables, row order over many partitions, registration."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import accesslake
from accesslake.session import shared_dir
from accesslake.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``build(tables)`` under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(shipped(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """``spark`` with this package sent to its executors, once a context, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(accesslake.__file__).parent
        path = Path(tempfile.mkdtemp(prefix="ship-")) / "accesslake.zip"
        with zipfile.ZipFile(path, "w") as packed:
            for file in sorted(root.rglob("*.py")):
                packed.write(file, str(file.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the folder the cluster shares, read back; it outlives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows whose texts a worker has as Python objects at once; Arrow hands it up to ten thousand.
ROWS = 256


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches``, in order and ``rows`` at most at once, without copies."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(df: DataFrame, key: Column, parts: int) -> Column:
    """The ordinal of the quantile range of ``key`` that a row falls in, 0 to ``parts - 1``; null keys come first.

    The bounds are approximate quantiles over all rows, so they only decide how even the buckets are. At most
    ``parts`` numbers come to the driver.
    """
    shares = [i / parts for i in range(1, parts)]
    bounds = df.agg(F.percentile_approx(key, shares, 10000).alias("at")).first()["at"] if shares else None
    if not bounds:
        return F.lit(0)
    array = F.array(*map(F.lit, sorted(set(bounds))))
    return F.when(key.isNull(), F.lit(0)).otherwise(F.size(F.filter(array, lambda at: at < key)))


def running(df: DataFrame, order: Sequence[str], totals: dict[str, Column], group: Sequence[str] = (), parts: int = 0) -> DataFrame:
    """``df`` with, for each entry of ``totals``, the sum over all rows before a row in ``order`` (within ``group``).

    No partition holds more than one quantile range of ``order[0]`` of one group: each range is summed first, the
    sums (at most ``parts`` a group) are added up, and a window runs inside each range only. ``df`` is read three times,
    so it should be narrow or written. Rows that agree in all of ``order`` are in any order among themselves.
    """
    spark, group = df.sparkSession, list(group)
    parts = parts or 2 * partitions(spark)
    df = df.withColumn("_bucket", bucket_of(df, F.col(order[0]), parts))
    sums = df.groupBy(*group, "_bucket").agg(*(F.sum(c).alias(f"_{k}") for k, c in totals.items()))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(g).alias(f"_of_{g}") for g in group), F.col("_bucket").alias("_at"), *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in totals))
    same = F.col("_bucket") == F.col("_at")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{k}") for k, c in totals.items()))
    joined = within.join(F.broadcast(starts), same)  # at most ``parts`` rows a group
    keep = [F.col(c) for c in df.columns if c != "_bucket"]
    return joined.select(*keep, *((F.col(f"_{k}") + F.col(f"_in_{k}")).alias(k) for k in totals))
