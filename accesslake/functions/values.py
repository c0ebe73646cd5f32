"""Scalar expressions for display and repair of values. All stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The keys tried, in this order, when an object is shown as text.
DISPLAY_KEYS = ["name", "label", "title", "username", "value", "address", "id"]

# Units of a file size.
SIZE_UNITS = ["Bytes", "KB", "MB", "GB", "TB"]


def is_blank(c: Column) -> Column:
    """Null and the empty string are blank; 0 and false are not."""
    return c.isNull() | (c.cast("string") == "")


def _text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.regexp_replace(c.cast("string"), r"\.0$", "")
    return c.cast("string")


def _nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))


def _absent(c: Column, dtype: T.DataType) -> Column:
    return c.isNull() if _nested(dtype) else is_blank(c)


def _show(c: Column, dtype: T.DataType, first_key: str | None, delimiter: str) -> Column:
    if isinstance(dtype, T.ArrayType):
        shown = F.transform(c, lambda x: _show(x, dtype.elementType, first_key, delimiter))
        return F.coalesce(F.array_join(F.filter(shown, lambda s: s != ""), delimiter), F.lit(""))
    if isinstance(dtype, T.StructType):
        keys = ([first_key] if first_key else []) + [k for k in DISPLAY_KEYS if k != first_key]
        choices = []
        for key in keys:
            value, value_type = c, dtype
            for step in key.split("."):
                if not isinstance(value_type, T.StructType) or step not in value_type.names:
                    value_type = None
                    break
                value, value_type = value[step], value_type[step].dataType
            if value_type is not None:
                choices.append(F.when(~_absent(value, value_type), _show(value, value_type, None, delimiter)))
        choices += [
            F.when(~is_blank(c[f.name]), _text(c[f.name], f.dataType)) for f in dtype.fields if not _nested(f.dataType)
        ]
        return F.when(c.isNull(), F.lit("")).otherwise(F.coalesce(*choices, F.to_json(c)))
    if isinstance(dtype, T.MapType):
        keys = ([first_key] if first_key else []) + [k for k in DISPLAY_KEYS if k != first_key]
        values = [F.try_element_at(c, F.lit(k)) for k in keys]
        choices = [F.when(~_absent(v, dtype.valueType), _show(v, dtype.valueType, None, delimiter)) for v in values]
        if not _nested(dtype.valueType):
            kept = F.filter(F.map_values(c), lambda v: ~is_blank(v))
            choices.append(_text(F.try_element_at(kept, F.lit(1)), dtype.valueType))
        return F.when(c.isNull(), F.lit("")).otherwise(F.coalesce(*choices, F.to_json(c)))
    return F.coalesce(_text(c, dtype), F.lit(""))


def display_value(df: DataFrame, column: str, display_key: str | None = None, delimiter: str = ", ") -> Column:
    """Text for a column of any type: an object shows its first non-blank display key, a list joins its items."""
    return _show(F.col(column), df.schema[column].dataType, display_key, delimiter)


def blank_default(c: Column, default: str = "-") -> Column:
    """The default for null and for the empty text only; blanks are a value."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def choice_label(c: Column, choices: dict[str, str]) -> Column:
    """Value to label through a plan-time map; an unknown value stays as it is."""
    table = F.create_map(*[F.lit(x) for pair in choices.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def seconds_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000)


def readable_duration(start: Column, end: Column, units: tuple[str, str, str, str] = ("d", "h", "m", "s")) -> Column:
    """The largest unit whose value exceeds 1, with one decimal; a negative span gives the empty text."""
    seconds = seconds_between(start, end)

    def fmt(x, unit):
        return F.concat_ws(" ", F.round(x, 1).cast("string"), F.lit(unit))

    return (
        F.when(seconds.isNull(), F.lit(None).cast("string"))
        .when(seconds > 86400, fmt(seconds / 86400, units[0]))
        .when(seconds > 3600, fmt(seconds / 3600, units[1]))
        .when(seconds > 60, fmt(seconds / 60, units[2]))
        .when(seconds >= 0, fmt(seconds, units[3]))
        .otherwise(F.lit(""))
    )


def safe_date(c: Column) -> Column:
    """Text to a timestamp, retried after turning slashes to dashes and after dropping a ``+zone`` suffix."""
    dashed = F.regexp_replace(c, "/", "-")
    unzoned = F.rtrim(F.split_part(dashed, F.lit("+"), F.lit(1)))
    return F.coalesce(*[x.try_cast("timestamp_ntz") for x in (c, dashed, unzoned)])


def age_bucket(ts: Column, as_of: Column) -> Column:
    """Rough age for display: now, minutes, hours, one day, else the date."""
    age = seconds_between(ts, as_of)
    return (
        F.when(age < 30, F.lit("just now"))
        .when(age < 3600, F.concat(F.ceil(age / 60).cast("string"), F.lit(" minutes ago")))
        .when(age < 86400, F.concat(F.ceil(age / 3600).cast("string"), F.lit(" hours ago")))
        .when(age < 2 * 86400, F.lit("1 day ago"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm"))
    )


def format_bytes(n: Column) -> Column:
    """Base-1024 size with at most two decimals. Comparing with powers of 1024 avoids the error of a logarithm."""
    chain = None
    for power, unit in reversed(list(enumerate(SIZE_UNITS))):
        number = F.regexp_replace(F.round(n / F.lit(1024.0**power), 2).cast("string"), r"\.0$", "")
        text = F.concat_ws(" ", number, F.lit(unit))
        at_least = n >= F.lit(1024**power)
        chain = F.when(at_least, text) if chain is None else chain.when(at_least, text)
    return F.when(n == 0, F.lit("0 Bytes")).otherwise(chain)


def truncate_end(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def truncate_center(c: Column, n: int) -> Column:
    """Keeps a head and the tail of the first ``n`` characters (not the tail of the whole text)."""
    middle = -(-n // 2)
    cut = F.concat(F.substring(c, 1, middle - 2), F.lit("..."), F.substring(c, middle + 2, n - middle - 1))
    return F.when(F.length(c) > n, cut).otherwise(c)


def epoch_text(seconds: Column, layout: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_seconds(seconds), layout)


def decode_flags(c: Column, flags: dict[int, str]) -> Column:
    """Integer bit set to the list of the names whose bit is on."""
    names = F.array(*[F.when(c.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in flags.items()])
    return F.array_compact(names)


def split_values(c: Column) -> Column:
    """Split at commas (both widths) and line ends; trimmed, blanks dropped, first of equals kept."""
    trimmed = F.transform(F.split(c, r"[,，\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def label_text(name: Column, value: Column) -> Column:
    return F.concat_ws(":", name, value)


def actions_summary(labels: Column, all_count: int = 6) -> Column:
    """All actions read "All"; otherwise the labels without their bracketed remark, joined by commas."""
    short = F.transform(labels, lambda x: F.regexp_replace(x, r" \([^)]*\)", ""))
    return F.when(F.size(labels) == all_count, F.lit("All")).otherwise(F.array_join(short, ","))


def list_amount(c: Column, dtype: T.DataType, remove: tuple[str, ...] = ("@SPEC",)) -> Column:
    """Number of elements (of keys for a map) besides the marker values; duplicates count."""
    items = F.map_keys(c) if isinstance(dtype, T.MapType) else c
    kept = F.filter(items, lambda x: ~x.isin(*remove)) if remove else items
    return F.when(kept.isNull(), 0).otherwise(F.size(kept))


def redact(df: DataFrame, fields: tuple[str, ...] = ("password", "secret", "private_key")) -> DataFrame:
    """Named secret fields are replaced by their SHA-256; the other columns pass unchanged."""
    present = [f for f in fields if f in df.columns]
    return df.withColumns({f: F.sha2(F.col(f).cast("string"), 256) for f in present})


def any_of(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def all_of(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests) if tests else F.lit(True)
