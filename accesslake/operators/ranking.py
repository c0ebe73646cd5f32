"""Top-k, latest rows per group, numbering inside groups, sorting and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Fixed value: rows of a page unless told otherwise.
DEFAULT_PAGE_SIZE = 15


def top_k(df: DataFrame, key: str, measure: Column, k: int = 10, name: str = "total") -> DataFrame:
    """The ``k`` largest groups with a 1-based rank; ties go to the smaller key.

    The sort keeps ``k`` rows per task; the ranking window sees only the final ``k``.
    """
    best = df.groupBy(key).agg(measure.alias(name)).orderBy(F.desc(name), F.asc(key)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(name), F.asc(key))).cast("bigint"))


def recent_per_group(df: DataFrame, group: str, ts: str, tie: str, n: int = 30) -> DataFrame:
    """The latest ``n`` rows per group.

    Up to Spark's window group limit (``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 by default) each task
    keeps at most ``n`` rows per group before anything is shuffled; a larger ``n`` needs that setting raised.
    """
    w = Window.partitionBy(group).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def number_within(
    df: DataFrame, group: str, ts: str, tie: str, name: str = "version", bucket: str = "MINUTE", tie_width: int | None = None, total: str | None = None
) -> DataFrame:
    """1-based position of every row in its group, by (ts, tie), for groups of any size.

    Rows are numbered inside (group, time bucket), and a bucket starts after the count of the group's earlier
    buckets. So a group with a large part of all rows is spread over its buckets; only one count per bucket is
    brought together per group. Logs that know only the day put many rows on the bucket's first instant: with
    ``tie_width`` those are split again by ranges of the (integer) tie key, which keeps the order since among equal
    timestamps it decides. Rows without a time come first in their group, rows without a group are a group.
    ``total`` names a column for the group's number of rows, which the offsets know without another pass.
    """
    slot = F.date_trunc(bucket, F.col(ts))
    sub = F.lit(0).cast("bigint")
    if tie_width:
        at_start = F.col(ts).cast("timestamp") == slot.cast("timestamp")
        sub = F.when(at_start | slot.isNull(), F.floor(F.col(tie) / tie_width)).otherwise(F.lit(2**62))
    cells = [group, "_bucket", "_sub"]
    bucketed = df.withColumn("_bucket", slot).withColumn("_sub", sub)
    earlier = Window.partitionBy(group).orderBy("_bucket", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_n").over(Window.partitionBy(group)).alias(total)] if total else []
    offsets = (
        bucketed.groupBy(*cells)
        .agg(F.count("*").alias("_n"))
        .select(*(F.col(c).alias(f"_of_{i}") for i, c in enumerate(cells)), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), *whole)
    )
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(cells)])
    inside = F.row_number().over(Window.partitionBy(*cells).orderBy(ts, tie))
    return (
        bucketed.withColumn("_inside", inside)
        .join(offsets, same)
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_bucket", "_sub", "_inside", "_before", *(f"_of_{i}" for i in range(len(cells))))
    )


def newest_per_group(df: DataFrame, group: str, ts: str, tie: str) -> DataFrame:
    """The newest row per group by aggregation, which reduces every task's rows to one per group first."""
    rest = [c for c in df.columns if c not in (group, ts, tie)]
    return df.groupBy(group).agg(F.max(F.struct(ts, tie, *rest)).alias("_newest")).select(group, "_newest.*")


def order_terms(order: str | None, tie: str) -> list[Column]:
    """``name`` or ``-name`` to sort terms, with a key that makes the order total; no order sorts by the key."""
    if not order:
        return [F.asc(tie)]
    return [F.desc(order[1:]) if order.startswith("-") else F.asc(order), F.asc(tie)]


def sort_parameter(prop: str | None, direction: str | None) -> str | None:
    """A column's sort state to an order text: ascending, descending, or nothing once the sort is cleared."""
    if not prop or not direction:
        return None
    return f"-{prop}" if direction.startswith("desc") else prop


def sort_by(df: DataFrame, order: str | None, tie: str) -> DataFrame:
    return df.orderBy(*order_terms(order, tie))


def page(df: DataFrame, number: int, size: int = DEFAULT_PAGE_SIZE, order: str | None = None, tie: str = "id") -> DataFrame:
    """One page of a sorted listing. For pages far down, ``page_after`` avoids sorting what was already shown."""
    return df.orderBy(*order_terms(order, tie)).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, key: str, last_seen, size: int = DEFAULT_PAGE_SIZE, order: str | None = None, last_order=None) -> DataFrame:
    """The page after a row already shown: a filter the source can use, then a top-k.

    ``order`` is ``name`` or ``-name`` as in ``sort_by``, and ``last_order`` that row's value of it; rows of equal value
    follow by the key. Null values come first in ascending order and last in descending order, as Spark sorts them.
    """
    after_key = F.col(key) > F.lit(last_seen)
    if not order:
        return df.where(after_key).orderBy(F.asc(key)).limit(size)
    value, down = F.col(order.lstrip("-")), order.startswith("-")
    if last_order is None:
        beyond = (value.isNull() & after_key) | (F.lit(False) if down else value.isNotNull())
    else:
        last = F.lit(last_order)
        beyond = (value < last) | value.isNull() if down else value > last
        beyond = beyond | ((value == last) & after_key)
    return df.where(beyond).orderBy(*order_terms(order, key)).limit(size)


def page_at(df: DataFrame, number: int, size: int, order: str, tie: str = "id", parts: int = 1000) -> DataFrame:
    """Page ``number`` (from 1) of a listing sorted as ``sort_by`` does, however far down, by order statistics.

    Approximate quantiles cut the values of ``order`` (numbers, dates or timestamps) into ranges; an aggregate counts each
    range's rows, which tells the ranges that the page lies in; only rows of those are sorted, by a filter of literal bounds
    that the scan can use. ``parts`` bounds and counts come to the driver, whatever the table. Rows of one value are in one
    range, so a value that most rows share is sorted as a whole, by the key. Null values are a range of their own, first in
    ascending order and last in descending order. A page beyond the end is empty.
    """
    value, down = F.col(order.lstrip("-")), order.startswith("-")
    cuts = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10 * parts).alias("at")).first()["at"]
    kind = df.schema[order.lstrip("-")].dataType
    bounds = [F.lit(b).cast(kind) for b in sorted(set(cuts or []))]
    place = F.size(F.filter(F.array(*bounds), lambda b: b < value)) if bounds else F.lit(0)
    counted = df.groupBy(F.when(value.isNotNull(), place).alias("range")).agg(F.count("*").alias("n")).collect()  # ``parts`` rows
    counts = {r["range"]: r["n"] for r in counted}
    ranges = sorted((r for r in counts if r is not None), reverse=down)
    ranges = [*ranges, None] if down else [None, *ranges]
    skipped, taken, seen = 0, [], 0
    for r in ranges:
        here = counts.get(r, 0)
        if here and seen + here > (number - 1) * size and seen < number * size:
            taken.append(r)
        elif not taken:
            skipped = seen + here
        seen += here
    tests = []
    for r in taken:
        if r is None:
            tests.append(value.isNull())
            continue
        test = value.isNotNull()
        if r > 0:
            test = value > bounds[r - 1]
        if r < len(bounds):
            test = test & (value <= bounds[r])
        tests.append(test)
    rows = df.where(reduce(Column.__or__, tests)) if tests else df.limit(0)
    return rows.orderBy(*order_terms(order, tie)).offset((number - 1) * size - skipped if taken else 0).limit(size)


def merge_slots(df: DataFrame, keys: list[str], slot: str) -> DataFrame:
    """Adjacent slots per key become ranges [begin, end). Slots are made unique first, so a key orders at most 24."""
    order = Window.partitionBy(*keys).orderBy(slot)
    unique = df.select(*keys, slot).distinct()
    opens = unique.withColumn("_open", F.when(F.lag(slot).over(order) == F.col(slot) - 1, 0).otherwise(1))
    islands = opens.withColumn("_island", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(slot).alias("begin"), (F.max(slot) + 1).alias("end")).drop("_island")
