"""Listings, validated import, append and patch, export, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslake.functions.calendar import at, day_window

# Log kinds with a keep-days setting.
KEEP_DAYS_KINDS = [
    "login_log",
    "task_log",
    "operate_log",
    "password_change_log",
    "ftp_log",
    "terminal_session",
    "activity_log",
    "job_execution",
    "cloud_sync_task_execution",
    "account_change_secret_record",
]


def listing(df: DataFrame, meta: dict[str, dict] | None = None, order: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Visible columns of a resource: no ``write_only`` ones, primary columns first, then the explicit or metadata order.

    Only the chosen columns are selected, so the scan reads no others.
    """
    meta = meta or {}
    names = [c for c in df.columns if c not in exclude and not meta.get(c, {}).get("write_only")]
    if order:
        names = [c for c in order if c in names]
    else:
        names.sort(key=lambda c: meta.get(c, {}).get("order", len(df.columns)))
    names.sort(key=lambda c: not meta.get(c, {}).get("primary", False))
    return df.select(*names)


def read_upload(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV upload as text columns, so that a bad value is reported by its row and not lost; broken lines are kept.

    Columns are found by the names in the header, in whatever order it has them; others are left out.
    """
    found = spark.read.csv(path, header=True).columns
    if missing := [c for c in columns if c not in found]:
        raise ValueError(f"the upload has no column {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*found, "_corrupt_record"]])
    rows = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.select(*columns, "_corrupt_record")


def validate_import(df: DataFrame, types: dict[str, str], rules: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Adds ``status`` (ok or error) and ``errors``, one message per column that does not parse or rule that fails."""
    messages = [
        F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != "") & F.col(c).try_cast(t).isNull(), F.lit(f"{c}: not a valid {t}"))
        for c, t in types.items()
    ]
    if "_corrupt_record" in df.columns:
        messages.append(F.when(F.col("_corrupt_record").isNotNull(), F.lit("row: malformed")))
    messages += [F.when(~F.coalesce(test, F.lit(False)), F.lit(f"{c}: {text}")) for c, (test, text) in (rules or {}).items()]
    errors = F.array_compact(F.array(*messages))
    return df.withColumn("errors", errors).withColumn("status", F.when(F.size("errors") == 0, "ok").otherwise("error"))


def append_new(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Target plus the batch rows whose key it lacks; of batch rows with one key the smallest row is taken."""
    rest = [c for c in target.columns if c != key]
    first = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")
    return target.unionByName(first.join(target.select(key), key, "left_anti"))


def patch(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Partial update by key: columns the batch has replace the old value (null included), the others stay.

    Of batch rows with one key the smallest row is taken, as ``append_new`` does, so the target keeps its rows.
    """
    changed = [c for c in batch.columns if c != key]
    news = batch.groupBy(key).agg(F.min(F.struct(*changed)).alias("_new"))
    joined = target.join(news, key, "left")
    columns = [
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
        for c in target.columns
    ]
    return joined.select(*columns)


def column_profile(df: DataFrame) -> DataFrame:
    """(column, max_length) of the longest rendering per column, in one aggregation; a boolean counts 5."""

    def rendered(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return F.when(c.isNotNull(), F.lit(5))
        if isinstance(f.dataType, (T.ArrayType, T.MapType)):
            return F.when(F.size(c) > 0, F.length(F.to_json(c)))
        if isinstance(f.dataType, T.StructType):
            return F.length(F.to_json(c))
        return F.length(c.cast("string"))

    lengths = df.agg(*[F.coalesce(F.max(rendered(f)), F.lit(0)).cast("bigint").alias(f.name) for f in df.schema.fields])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("max_length")) for c in lengths.columns])
    return lengths.select(F.inline(rows))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns whose every value renders empty. Reads one row of the profile per column to the driver."""
    kept = {r["column"] for r in column_profile(df).where("max_length > 0").collect()}
    return df.select(*[c for c in df.columns if c in kept])


def export(df: DataFrame, path: str, predicate: Column | None = None, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Writes the filtered rows, one file per task; nothing is brought to the driver."""
    rows = df if predicate is None else df.where(predicate)
    rows.write.mode(mode).format(fmt).option("header", True).save(path)


def selected(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows named by the id list, for an export of a selection."""
    return df.join(ids.select(key), key, "left_semi")


def retain(df: DataFrame, ts: str, keep_days: int, as_of) -> DataFrame:
    """Rows of the last ``keep_days`` days; a literal bound, so whole day partitions are skipped."""
    start, _ = day_window(as_of, keep_days)
    return df.where(F.col(ts) >= at(df, ts, start))


def retain_kinds(logs: dict[str, tuple[DataFrame, str]], keep_days: dict[str, int], as_of) -> dict[str, DataFrame]:
    """``retain`` for each log kind that has a setting; ``logs`` gives the frame and its time column per kind."""
    unknown = set(keep_days) - set(KEEP_DAYS_KINDS)
    if unknown:
        raise ValueError(f"no keep-days setting for {sorted(unknown)}")
    return {kind: retain(df, ts, keep_days[kind], as_of) if kind in keep_days else df for kind, (df, ts) in logs.items()}
