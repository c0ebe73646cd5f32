"""Tables with one folder a day: a write replaces the days it has rows of, retention drops whole days.

Sources are read before anything is replaced: tasks write to a staging folder and the days are swapped when all are done, so
a lost executor costs a retry and never a row. A table has one writer at a time.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslake.functions.calendar import day_window
from accesslake.sources.ingest import patch

DAY = "day"


def write_days(df: DataFrame, path: str, ts: str) -> None:
    """Replaces the days that ``df`` has rows of and leaves the files of other days as they are.

    Rows without a time are a day of their own, the null one. Rows of a day are brought together so that a day gets few
    files, and a day that holds much of the rows is split by its size at run time. ``df`` has no column ``day`` yet.
    """
    if DAY in df.columns:
        raise ValueError(f"the rows have a column {DAY} already")
    _replace(df.withColumn(DAY, F.to_date(ts)), path)


def _replace(rows: DataFrame, path: str) -> None:
    placed = rows.hint("rebalance", F.col(DAY))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def read_days(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table with its ``day``; a condition on ``day`` skips folders."""
    return spark.read.schema(f"{schema}, {DAY} date").parquet(path)


def drop_days(spark: SparkSession, path: str, keep_days: int, as_of) -> list[date]:
    """Deletes the folders of days before the last ``keep_days`` ones that end on ``as_of``, and returns these days.

    No row is read. Rows without a time stay, as nothing tells their age. Deleting twice changes nothing.
    """
    start, _ = day_window(as_of, keep_days)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    gone = []
    for found in store.listStatus(folder):
        name, _, value = found.getPath().getName().partition("=")
        if name == DAY and value[:1].isdigit() and date.fromisoformat(value) < start:
            store.delete(found.getPath(), True)
            gone.append(date.fromisoformat(value))
    return sorted(gone)


def patch_days(spark: SparkSession, path: str, schema: str, batch: DataFrame, key: str, ts: str) -> list[date | None]:
    """``patch`` on a table by day that rewrites only the days holding a key of the batch, and returns these days.

    Which days these are is read from the keys alone; one row a day comes to the driver. The batch can't change ``ts``, since a row
    would have to change its folder. Keys that the table lacks change nothing.
    """
    if {ts, DAY} & set(batch.columns):
        raise ValueError(f"a patch can't move rows between days by {ts} or {DAY}")
    rows = read_days(spark, path, schema)
    touched = [r[DAY] for r in rows.select(key, DAY).join(batch.select(key), key, "left_semi").select(DAY).distinct().collect()]
    if touched:
        dated = [d for d in touched if d is not None]
        inside = F.col(DAY).isin(dated) if dated else F.lit(False)
        _replace(patch(rows.where(inside | F.col(DAY).isNull() if None in touched else inside), batch, key), path)
    return sorted(touched, key=lambda d: (d is not None, d))
