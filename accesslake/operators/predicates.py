"""Search parameters, attribute rules and permission expressions compiled to a single ``Column``.

The documents are small and known when the plan is built, so nothing here needs a join: every test lands in the
filter of the scan, where Catalyst pushes what the source understands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.functions.network import ip_in
from accesslake.functions.values import all_of, any_of

# The lookups a search parameter may carry after its field name.
LOOKUPS = ["exact", "icontains", "startswith", "in", "icontains_any", "icontains_all"]

# Match operators offered per attribute type.
STR_MATCHES = ["exact", "not", "in", "contains", "startswith", "endswith", "regex"]
TYPE_MATCHES = {
    "str": STR_MATCHES,
    "bool": ["exact", "not"],
    "m2m": ["m2m", "m2m_all"],
    "fk": ["m2m"],
    "ip": [*STR_MATCHES, "ip_in"],
    "int": [*STR_MATCHES, "gte", "lte"],
    "select": ["in"],
}


def values_of(value) -> list[str]:
    """One parameter value as a list: lists stay, text is split at commas, blanks are dropped."""
    items = value if isinstance(value, (list, tuple)) else str(value).split(",")
    return [str(v).strip() for v in items if str(v).strip() != ""]


def icontains(c: Column, text: str) -> Column:
    return F.contains(F.lower(c.cast("string")), F.lit(text.lower()))


def search_any(df: DataFrame, keyword: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any column's text contains the keyword; case matters."""
    tests = [F.contains(F.col(c).cast("string"), F.lit(keyword)) for c in columns or df.columns]
    return df.where(any_of([F.coalesce(t, F.lit(False)) for t in tests]))


def split_lookup(parameter: str) -> tuple[str, str]:
    field, mark, lookup = parameter.rpartition("__")
    return (field, lookup) if mark and lookup in LOOKUPS else (parameter, "exact")


def lookup_test(c: Column, lookup: str, value) -> Column:
    tests: dict[str, Callable[[], Column]] = {
        "exact": lambda: c == F.lit(value),
        "icontains": lambda: icontains(c, str(value)),
        "startswith": lambda: c.startswith(str(value)),
        "in": lambda: c.isin(*(value if isinstance(value, (list, tuple)) else values_of(value))),
        "icontains_any": lambda: any_of([icontains(c, v) for v in values_of(value)]),
        "icontains_all": lambda: all_of([icontains(c, v) for v in values_of(value)]),
    }
    return tests[lookup]()


def search_batches(text: str, columns: Iterable[str]) -> Column:
    """``a|b,c``: every batch must hit, a batch hits by any of its words in any of the columns (case-insensitive)."""
    columns = list(columns)
    batches = [[w.strip() for w in batch.split("|") if w.strip()] for batch in text.split(",")]
    return all_of([any_of([icontains(F.col(c), w) for w in words for c in columns]) for words in batches if words])


def clean_params(params: dict) -> dict:
    """Drop blank parameters (0 and False are not blank) and trim text."""
    trimmed = {k: v.strip() if isinstance(v, str) else v for k, v in params.items()}
    return {k: v for k, v in trimmed.items() if v is not None and v != ""}


def compose_conditions(conditions: Iterable[tuple[str, str, object]]) -> dict:
    """(field, lookup, value) conditions in the order given -> parameters.

    ``exact`` and ``in`` overwrite; the second ``icontains`` on a field turns both into contains-all; conditions on
    the keyword ``search`` add batches, or join its own contains-all list when that lookup is asked for.
    """
    params: dict = {}
    for field, lookup, value in conditions:
        if field in ("", "search"):
            if lookup == "icontains_all":
                params.setdefault("search__icontains_all", []).extend(values_of(value))
            elif batch := "|".join(values_of(value)):
                params["search"] = f"{params['search']},{batch}" if "search" in params else batch
        elif lookup == "exact":
            params[field] = value
        elif lookup == "in":
            params[f"{field}__in"] = value
        elif lookup in ("icontains", "icontains_all"):
            one, many = f"{field}__icontains", f"{field}__icontains_all"
            if lookup == "icontains" and one not in params and many not in params:
                params[one] = value
            else:
                earlier = values_of(params.pop(one)) if one in params else []
                merged = params.get(many, []) + earlier + values_of(value)
                params[many] = list(dict.fromkeys(merged))
        else:
            params.setdefault(f"{field}__{lookup}", []).append(value)
    return params


def compile_params(params: dict, search_columns: Iterable[str] = ()) -> Column:
    """All parameters of a listing as one predicate; no parameter means every row."""
    search_columns = list(search_columns)
    tests = []
    for name, value in clean_params(params).items():
        field, lookup = split_lookup(name)
        if field == "search" and not search_columns:
            raise ValueError("search needs columns to search in")
        if field == "search" and lookup == "icontains_all":
            tests += [any_of([icontains(F.col(c), w) for c in search_columns]) for w in values_of(value)]
        elif field == "search":
            tests.append(search_batches(value, search_columns))
        elif lookup == "startswith" and isinstance(value, list):
            tests.append(all_of([lookup_test(F.col(field), lookup, v) for v in value]))
        else:
            tests.append(lookup_test(F.col(field), lookup, value))
    return all_of(tests)


def merge_filters(active: list[dict], clicked: dict) -> list[dict]:
    """Clicking a quick filter removes the active ones that share one of its keys, then adds it."""
    return [f for f in active if not set(f) & set(clicked)] + [clicked]


def combined(filters: list[dict]) -> dict:
    return {k: v for f in filters for k, v in f.items()}


def match(c: Column, how: str, value) -> Column:
    """One attribute condition. Null matches no positive condition; ``not`` and ``exclude`` keep it."""
    text = c.cast("string")
    tests: dict[str, Callable[[], Column]] = {
        "exact": lambda: c.eqNullSafe(F.lit(value)),
        "not": lambda: ~c.eqNullSafe(F.lit(value)),
        "in": lambda: F.coalesce(c.isin(*value), F.lit(False)),
        "contains": lambda: F.coalesce(F.contains(text, F.lit(str(value))), F.lit(False)),
        "exclude": lambda: F.coalesce(~F.contains(text, F.lit(str(value))), F.lit(True)),
        "startswith": lambda: F.coalesce(text.startswith(str(value)), F.lit(False)),
        "endswith": lambda: F.coalesce(text.endswith(str(value)), F.lit(False)),
        "regex": lambda: F.coalesce(text.rlike(str(value)), F.lit(False)),
        "m2m": lambda: F.coalesce(F.arrays_overlap(c, F.array(*[F.lit(v) for v in value])), F.lit(False)),
        "m2m_all": lambda: F.coalesce(F.size(F.array_except(F.array(*[F.lit(v) for v in value]), c)) == 0, F.lit(False)),
        "ip_in": lambda: ip_in(c, value if isinstance(value, (list, tuple)) else [value]),
        "gte": lambda: F.coalesce(c >= F.lit(value), F.lit(False)),
        "lte": lambda: F.coalesce(c <= F.lit(value), F.lit(False)),
    }
    return tests[how]()


def attr_tests(attrs: list[dict], relation: str = "and") -> Column:
    """Conditions on attributes; a later condition on the same attribute replaces the earlier one."""
    by_name = {a["name"]: a for a in attrs}
    tests = [match(F.col(a["name"]), a["match"], a["value"]) for a in by_name.values()]
    return any_of(tests) if relation == "or" else all_of(tests)


def combine_rules(rules: list[dict], relation: str = "and") -> Column:
    """Strategy rules joined by their relation, ``and`` unless said otherwise; here equal names may repeat."""
    tests = [match(F.col(r["name"]), r["match"], r["value"]) for r in rules]
    return any_of(tests) if relation == "or" else all_of(tests)


def match_members(bridge: DataFrame, key: str, member: str, wanted: list) -> DataFrame:
    """(key, has_any, has_all) of a relation kept as rows; one flag per wanted member, so no list is collected."""
    flags = bridge.where(F.col(member).isin(*wanted)).groupBy(key).agg(
        *[F.bool_or(F.col(member) == F.lit(w)).alias(f"_has{i}") for i, w in enumerate(wanted)]
    )
    each = [F.col(f"_has{i}") for i in range(len(wanted))]
    return flags.select(key, any_of(each).alias("has_any"), all_of(each).alias("has_all"))


def rule_test(rule: dict, id_column: str) -> Column:
    """``{type: all | ids | attrs}`` as a predicate."""
    if rule["type"] == "all":
        return F.lit(True)
    if rule["type"] == "ids":
        return F.coalesce(F.col(id_column).isin(*rule["ids"]), F.lit(False)) if rule["ids"] else F.lit(False)
    return attr_tests(rule["attrs"])


def check_rule(rule: dict, types: dict[str, str]) -> dict:
    """The rule, if each of its conditions uses an operator offered for the attribute's type; else an error."""
    for condition in rule.get("attrs", []):
        offered = TYPE_MATCHES[types[condition["name"]]]
        if condition["match"] not in offered:
            raise ValueError(f"{condition['name']}: {condition['match']} is not one of {', '.join(offered)}")
    return rule


def match_rules(df: DataFrame, rule: dict, id_column: str) -> DataFrame:
    return df.where(rule_test(rule, id_column))


def match_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows named by an id table of any size; Spark broadcasts it only when its measured size allows.

    A semi join needs no distinct ids; without that aggregation a hot id's rows can be split by adaptive execution.
    """
    return df.join(ids.select(key), key, "left_semi")


def parse_labels(selections: str | list[tuple[str, str]]) -> dict[str, list[str] | None]:
    """Label picks in click order -> {name: values or None for any}.

    A pick that is already chosen is taken back; ``*`` drops the name's values and a value drops the name's ``*``.
    """
    if isinstance(selections, str):
        selections = [tuple(s.split(":", 1)) for s in selections.split(",") if ":" in s]
    chosen: list[tuple[str, str]] = []
    for name, value in selections:
        if not name or value in ("", None):
            continue
        if (name, value) in chosen:
            chosen.remove((name, value))
            continue
        chosen = [(n, v) for n, v in chosen if n != name or (v != "*" and value != "*")] + [(name, value)]
    picked: dict[str, list[str] | None] = {}
    for name, value in chosen:
        if value == "*":
            picked[name] = None
        else:
            picked.setdefault(name, []).append(value)
    return picked


def has_labels(df: DataFrame, bridge: DataFrame, selections, key: str, bridge_key: str = "res_id") -> DataFrame:
    """Rows that carry, for every picked label name, one of its picked values.

    One pass over the bridge: a resource qualifies when it covers all names, counted without a join per name.
    """
    picked = parse_labels(selections)
    if not picked:
        return df
    tests = {
        n: (F.col("name") == n) if values is None else (F.col("name") == n) & F.col("value").isin(*values)
        for n, values in picked.items()
    }
    covering = (
        bridge.where(any_of(list(tests.values())))
        .groupBy(F.col(bridge_key).alias(key))
        .agg(*[F.bool_or(t).alias(f"_has{i}") for i, t in enumerate(tests.values())])
        .where(all_of([F.col(f"_has{i}") for i in range(len(tests))]))
    )
    return df.join(covering.select(key), key, "left_semi")


def has_perms(required: Column, granted: Column) -> Column:
    """Every required item must be granted; an item ``a|b`` is granted if any part is; no item at all is granted."""

    def held(item: Column) -> Column:
        parts = F.filter(F.transform(F.split(item, r"\|"), lambda part: F.trim(part)), lambda p: p != "")
        return F.exists(parts, lambda p: F.array_contains(granted, p))

    return F.forall(required, held)


def validity(df: DataFrame, as_of, start: str = "date_start", expiry: str = "date_expired", active: str = "is_active") -> DataFrame:
    """Adds ``is_expired`` and ``is_valid`` as of a moment; all three date tests are plain comparisons."""
    now = F.lit(str(as_of)).cast(df.schema[expiry].dataType)
    return df.withColumn("is_expired", F.col(expiry) <= now).withColumn(
        "is_valid", F.col(active) & (F.col(start) <= now) & ~F.col("is_expired")
    )


def no_login_for(users: DataFrame, logins: DataFrame, days: int, as_of, user_key: str, log_key: str, ts: str) -> DataFrame:
    """Users whose last login is older than ``days`` or who never logged in; adds ``last_login``."""
    last = logins.groupBy(F.col(log_key).alias(user_key)).agg(F.max(ts).alias("last_login"))
    return users.join(last, user_key, "left").where(idle(F.col("last_login"), days, as_of))


def idle(last_login: Column, days: int, as_of) -> Column:
    """No login for more than ``days``, or none at all."""
    return last_login.isNull() | (F.datediff(F.lit(str(as_of)[:10]).cast("date"), last_login) > days)


