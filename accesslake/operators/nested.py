"""Objects whose keys are only known from the data: leaves, differences and missing keys, over Spark's VARIANT type.

Rules: an object that has keys is opened; an array, an empty object and a JSON null are values like texts and numbers. A
path is the keys joined by ``.``. Values compare as JSON, so ``1`` and ``"1"`` differ and arrays are equal as a whole or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.session import cut_lineage


def from_json_text(text: Column) -> Column:
    """The object of a JSON text; null where the text is no JSON."""
    return F.try_parse_json(text)


def from_map(entries: Column) -> Column:
    """The object of a map with text keys, nested maps, structs and arrays included."""
    return F.to_variant_object(entries)


def leaves(objects: DataFrame, column: str) -> DataFrame:
    """``objects`` without ``column``, one row per leaf of it: ``path``, the ``value`` as JSON and whether it is ``text``.

    All rows are opened by one level at a time, by a generator inside the scan's own tasks: no shuffle, and as many rounds as
    the deepest object has levels. A row whose object is null has no leaf. A value that is no object has the path ``""``.
    """
    names = [c for c in objects.columns if c != column]
    carried = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)))
    level = objects.select(carried.alias("row"), F.lit("").alias("path"), F.col(f"`{column}`").alias("value")).where("value is not null")
    whole = None
    while True:
        kind = F.schema_of_variant("value")
        opened = F.startswith(kind, F.lit("OBJECT<")) & (kind != "OBJECT<>")
        ended = level.where(~opened).select("row", "path", F.to_json("value").alias("value"), F.coalesce(kind == "STRING", F.lit(False)).alias("text"))
        whole = ended if whole is None else whole.union(ended)
        rest = level.where(opened)
        if rest.isEmpty():
            break
        inner = objects.sparkSession.tvf.variant_explode(F.col("value").outer()).select(F.col("key").alias("_key"), F.col("value").alias("_value"))
        path = F.when(F.col("path") == "", F.col("_key")).otherwise(F.concat_ws(".", "path", "_key"))
        level = cut_lineage(rest.lateralJoin(inner).select("row", path.alias("path"), F.col("_value").alias("value")))
    return whole.select(*(F.col(f"row.k{i}").alias(c) for i, c in enumerate(names)), "path", "value", "text")


def object_diff(objects: DataFrame, bases: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of the leaves of each object that its base lacks or has otherwise; what only the base has is left out.

    ``key`` is unique in both. An object without a base differs in all its leaves.
    """
    new = leaves(objects.select(key, column), column).select(key, "path", "value")
    old = leaves(bases.select(key, column), column).select(F.col(key).alias("_key"), F.col("path").alias("_path"), F.col("value").alias("_value"))
    same = (F.col(key) == F.col("_key")) & (F.col("path") == F.col("_path")) & F.col("value").eqNullSafe(F.col("_value"))
    return new.join(old, same, "left_anti")


def missing_keys(objects: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    """(path, value) of each path that some object has with a text and no target has at all; the least text of a path.

    Paths are reduced to one row each before they meet, so a path that every object has moves once a task.
    """
    texts = leaves(objects.select(column), column).where("text").groupBy("path").agg(F.min("value").alias("value"))
    known = leaves(targets.select(column), column).select("path").distinct().withColumn("_known", F.lit(True))
    # An anti join would be pushed below the reduction, and there meet the paths of the first level, which are one literal, as a product.
    return texts.join(known, "path", "left").where("_known is null").select("path", "value")
