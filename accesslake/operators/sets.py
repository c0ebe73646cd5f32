"""Set operations on ids, members and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minus(available: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return available.join(chosen.select(key), key, "left_anti")


def unique_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key in the given order, by aggregation (not whichever row arrives first)."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_first")).select(key, "_first.*")


def missing_paths(base: DataFrame, target: DataFrame, path: str = "path") -> DataFrame:
    """(path, value) leaves of the base that the target lacks; only text values count."""
    return base.where(F.col("value").isNotNull()).join(target.select(path), path, "left_anti")


def apply_paths(target: DataFrame, patch: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """Write values back by path: a present path is overwritten, an absent one is added."""
    new = patch.select(path, F.col(value).alias("_new"), F.lit(True).alias("_patched"))
    merged = target.select(path, value).join(new, path, "full_outer")
    return merged.select(path, F.when(F.col("_patched"), F.col("_new")).otherwise(F.col(value)).alias(value))


def toggle_page(selected: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """Selection after toggling a page: if any shown row was unselected all are added, else all are removed."""
    s = selected.select(key).distinct().withColumn("_selected", F.lit(True))
    p = shown.select(key).distinct().withColumn("_shown", F.lit(True))
    adds = minus(p, selected, key).exists()
    both = s.join(p, key, "full_outer")
    keep = F.when(adds, F.lit(True)).otherwise(F.col("_selected").isNotNull() & F.col("_shown").isNull())
    return both.where(keep).select(key)


def member_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): ``add`` for new - old, ``remove`` for old - new; one pass over both by a full join."""
    o = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    n = new.select(*keys).distinct().withColumn("_new", F.lit(True))
    return (
        o.join(n, keys, "full_outer")
        .where(F.col("_old").isNull() | F.col("_new").isNull())
        .select(*keys, F.when(F.col("_old").isNull(), "add").otherwise("remove").alias("change"))
    )


def common_values(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
