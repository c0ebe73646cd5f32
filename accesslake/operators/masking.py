"""Column masking by rule."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.operators.rules import access_test, by_priority

# Our masking methods; ``fixed_char`` is the one that takes a pattern.
METHODS = ["fixed_char", "hide_middle", "keep_prefix", "keep_suffix", "hash"]


def masked(c: Column, method: str, pattern: str = "######") -> Column:
    text = c.cast("string")
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    stars = F.lit("*")
    forms = {
        "fixed_char": lambda: F.when(text.isNotNull(), F.lit(pattern)),
        "hide_middle": lambda: F.concat(
            F.left(text, quarter), F.repeat(stars, n - 2 * quarter), F.right(text, quarter)
        ),
        "keep_prefix": lambda: F.concat(F.left(text, quarter), F.repeat(stars, n - quarter)),
        "keep_suffix": lambda: F.concat(F.repeat(stars, n - quarter), F.right(text, quarter)),
        "hash": lambda: F.sha2(text, 256),
    }
    return forms[method]()


def fields_matching(columns: list[str], pattern: str) -> list[str]:
    """Columns named by a comma-separated list of shell-style patterns, matched when the plan is built."""
    wanted = [p.strip() for p in pattern.split(",") if p.strip()]
    return [c for c in columns if any(fnmatch.fnmatchcase(c, p) for p in wanted)]


def mask_columns(df: DataFrame, rules: list[dict], user_key: str, **scopes: str) -> DataFrame:
    """Masks columns row by row: the first rule in priority order that names the column and covers the row applies."""
    live = [r for r in by_priority(rules) if r.get("is_active", True)]
    changed: dict[str, Column] = {}
    for column in df.columns:
        chain = None
        for r in live:
            if column not in fields_matching(df.columns, r["fields_pattern"]):
                continue
            test = access_test(r, user_key, **scopes)
            value = masked(F.col(column), r["masking_method"], r.get("mask_pattern", "######"))
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        if chain is not None:
            changed[column] = chain.otherwise(F.col(column).cast("string"))
    return df.withColumns(changed) if changed else df
