"""Field-level differences between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) of every changed field; added and removed rows show nulls on one side.

    One full join on the key; fields are compared and unpivoted inside the row, so the join is not repeated per field.
    """

    def side(df, name):
        return df.select(F.col(key), F.struct(*[F.col(f) for f in fields]).alias(name))

    changed = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"_b.{f}").eqNullSafe(F.col(f"_a.{f}")),
                    F.struct(
                        F.lit(f).alias("field"),
                        F.col(f"_b.{f}").cast("string").alias("before"),
                        F.col(f"_a.{f}").cast("string").alias("after"),
                    ),
                )
                for f in fields
            ]
        )
    )
    return side(before, "_b").join(side(after, "_a"), key, "full_outer").select(key, F.inline(changed))


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    paths = []
    for f in schema.fields:
        here = f"{prefix}{f.name}"
        paths += leaf_paths(f.dataType, f"{here}.") if isinstance(f.dataType, T.StructType) else [here]
    return paths


def nested_diff(objects: DataFrame, bases: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of the leaves of a nested object that differ from the base's; what only the base has is left out."""
    paths = leaf_paths(objects.schema[column].dataType)
    base_paths = set(leaf_paths(bases.schema[column].dataType))

    def difference(path: str) -> Column:
        value = F.col(f"_o.{path}")
        test = ~value.eqNullSafe(F.col(f"_b.{path}")) if path in base_paths else F.lit(True)
        return F.when(test, F.struct(F.lit(path).alias("path"), value.cast("string").alias("value")))

    joined = objects.select(key, F.col(column).alias("_o")).join(bases.select(key, F.col(column).alias("_b")), key, "left")
    return joined.select(key, F.inline(F.array_compact(F.array(*[difference(p) for p in paths]))))
