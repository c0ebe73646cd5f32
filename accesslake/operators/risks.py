"""Account risks: findings from reconciled snapshots, decision table, timeline and status changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.operators.predicates import idle
from accesslake.operators.relations import attach_spread

# The eleven risks the counters name, in their order.
RISKS = [
    "long_time_no_login",
    "new_found",
    "groups_changed",
    "sudoers_changed",
    "authorized_keys_changed",
    "account_deleted",
    "password_expired",
    "long_time_password",
    "weak_password",
    "leaked_password",
    "repeated_password",
]

# Remedies per action. The second item says whether the account must exist (None: either way).
# The spellings group_changed, sudo_changed and authorized_key_changed differ from the counters' on purpose.
RISK_ACTIONS = [
    ("delete_remote", None, ["long_time_no_login", "new_found"]),
    ("delete_both", None, ["long_time_no_login"]),
    ("add_account", None, ["new_found"]),
    ("change_password_add", False, ["new_found", "long_time_password", "password_expired"]),
    (
        "change_password",
        True,
        ["long_time_password", "weak_password", "password_expired", "leaked_password", "repeated_password"],
    ),
    ("delete_account", True, ["account_deleted"]),
    ("review", None, ["group_changed", "sudo_changed", "authorized_key_changed", "account_deleted", "others"]),
]

# Status codes of a gathered account.
STATUS = {"pending": "0", "confirmed": "1", "ignored": "2"}

# Timeline texts; again a third spelling for two of the risks.
TIMELINE_TEXTS = {
    "new_found": "New found",
    "account_deleted": "Account deleted",
    "weak_password": "Weak password",
    "repeat_password": "Repeated password",
    "leak_password": "Leaked password",
}
TIMELINE_DATED = {"long_time_no_login": "Last login time", "long_time_password": "Last change time"}
TIMELINE_DIFFED = ["group_changed", "sudoers_changed", "authorized_key_changed"]

# Chosen thresholds, in days.
NO_LOGIN_DAYS = 90
PASSWORD_DAYS = 180
PASSWORD_VALID_DAYS = 365


def older_than(ts: Column, days: int, as_of) -> Column:
    return F.datediff(F.lit(str(as_of)[:10]).cast("date"), ts) > days


def weak(secret: Column, min_length: int = 12) -> Column:
    """Chosen rule: shorter than ``min_length``, or without a letter, a digit or another character."""
    strong = (F.length(secret) >= min_length) & secret.rlike("[A-Za-z]") & secret.rlike("[0-9]") & secret.rlike("[^A-Za-z0-9]")
    return ~strong


def account_filters(
    as_of,
    days: int = 7,
    created: str = "date_created",
    last_login: str = "date_last_login",
    updated: str = "date_updated",
    secret_changed: str = "date_change_secret",
    secret: str = "secret",
    has_secret: str = "has_secret",
    failed: str = "change_secret_failed",
) -> dict[str, Column]:
    """The quick filters of an account list as named tests, with the same idle and weak-secret rules as the risks.

    ``latest_`` means within the ``days`` ending on ``as_of``; updated accounts have changed since they were created.
    """
    today = F.lit(str(as_of)[:10]).cast("date")

    def recent(c: str) -> Column:
        return F.datediff(today, F.col(c)) < days

    return {
        "latest_discovery": recent(created),
        "latest_accessed": recent(last_login),
        "latest_updated": recent(updated) & (F.col(updated) > F.col(created)),
        "latest_secret_change_failed": F.col(failed),
        "long_time_no_login": idle(F.col(last_login), NO_LOGIN_DAYS, as_of),
        "weak_password": F.coalesce(weak(F.col(secret)), F.lit(False)),
        "no_secret": ~F.col(has_secret),
        "long_time_no_change_secret": older_than(F.col(secret_changed), PASSWORD_DAYS, as_of),
    }


def new_found(reconciled: DataFrame) -> DataFrame:
    return reconciled.where(F.col("remote_present") & ~F.col("present"))


def account_deleted(reconciled: DataFrame) -> DataFrame:
    return reconciled.where(F.col("present") & ~F.col("remote_present"))


def repeated(df: DataFrame, secret: str, row_id: str) -> DataFrame:
    """Rows whose secret occurs more than once, with the count; secrets meet as hashes, hot ones are spread."""
    hashed = df.withColumn("_hash", F.sha2(F.col(secret), 256))
    often = hashed.groupBy("_hash").agg(F.count("*").alias("same")).where(F.col("same") > 1)
    return attach_spread(hashed, often, "_hash", F.col(row_id), "same").where(F.col("same").isNotNull()).drop("_hash")


def flag_duplicates(df: DataFrame, name: str, row_id: str) -> DataFrame:
    """Adds ``is_same`` to rows whose name occurs more than once."""
    often = df.groupBy(name).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return attach_spread(df, often, name, F.col(row_id), "_n").withColumn("is_same", F.col("_n").isNotNull()).drop("_n")


def attr_changed(reconciled: DataFrame) -> dict[str, Column]:
    """The three attribute risks as tests on accounts present on both sides."""
    both = F.col("present") & F.col("remote_present")
    return {
        f"{a}_changed": both & ~F.col(f"managed_{a}").eqNullSafe(F.col(f"remote_{a}"))
        for a in ("groups", "sudoers", "authorized_keys")
    }


def findings(reconciled: DataFrame, secret: Column, leaks: DataFrame, as_of, details: DataFrame | None = None, key: str = "asset") -> DataFrame:
    """(asset, username, risk) for every risk of every account.

    All tests are made on one row per account and exploded, so the snapshots are read once whatever the number of risks.
    ``secret`` is the account's secret as an expression over ``reconciled`` and the ``details`` joined to it by ``key``; where it
    is null the account keeps its other risks and has none of the secret's. ``leaks`` has one ``password`` column.

    The tests that need no secret are made first and kept as the bits of one number, so that the joins move an account's
    keys, that number and a digest, not its two snapshots.
    """
    last_login = F.greatest("managed_date_last_login", "remote_date_last_login")
    changed = F.greatest("managed_date_secret_changed", "remote_date_secret_changed")
    first = {
        "long_time_no_login": idle(last_login, NO_LOGIN_DAYS, as_of),
        "new_found": F.col("remote_present") & ~F.col("present"),
        **attr_changed(reconciled),
        "account_deleted": F.col("present") & ~F.col("remote_present"),
        "password_expired": older_than(changed, PASSWORD_VALID_DAYS, as_of),
        "long_time_password": older_than(changed, PASSWORD_DAYS, as_of),
    }
    bits = reduce(Column.__add__, [F.when(test, F.lit(1 << RISKS.index(r))).otherwise(F.lit(0)) for r, test in first.items()])
    if details is None:
        accounts = reconciled.withColumn("_bits", bits)
    else:
        accounts = reconciled.select("asset", "username", "present", bits.alias("_bits")).join(details, key, "left")
    hashed = lambda c: F.unhex(F.sha2(c, 256))
    digested = accounts.select("asset", "username", "present", "_bits", hashed(secret).alias("_hash"), F.coalesce(weak(secret), F.lit(False)).alias("_weak"))
    leak_hashes = leaks.select(hashed(F.col("password")).alias("_hash")).distinct().withColumn("_leak", F.lit(True))
    often = (
        digested.where(F.col("_hash").isNotNull()).groupBy("_hash").agg(F.count("*").alias("_n")).join(leak_hashes, "_hash", "left").where(
            (F.col("_n") > 1) | F.col("_leak")
        )
    )
    known = attach_spread(digested, often, "_hash", F.struct("asset", "username"), "_n")
    tests = {
        **{r: F.col("_bits").bitwiseAND(F.lit(1 << RISKS.index(r))) != 0 for r in first},
        "weak_password": F.col("_weak"),
        "leaked_password": F.coalesce("_leak", F.lit(False)),
        "repeated_password": F.coalesce(F.col("_n") > 1, F.lit(False)),
    }
    named = F.array_compact(F.array(*[F.when(tests[r], F.lit(r)) for r in RISKS]))
    return known.select("asset", "username", "present", F.explode(named).alias("risk"))


def risk_totals(found: DataFrame) -> DataFrame:
    """One row with the eleven named totals."""
    return found.agg(*[F.count_if(F.col("risk") == r).alias(f"total_{r}_accounts") for r in RISKS])


def risk_per_asset(found: DataFrame) -> DataFrame:
    """``risk_total`` and ``risk_summary`` (risk -> count, zero entries left out) per asset; at most eleven entries."""
    counted = found.groupBy("asset").agg(
        F.count("*").alias("risk_total"), *[F.count_if(F.col("risk") == r).alias(r) for r in RISKS]
    )
    entries = F.create_map(*[x for r in RISKS for x in (F.lit(r), F.col(r))])
    return counted.select("asset", "risk_total", F.map_filter(entries, lambda _, v: v != 0).alias("risk_summary"))


def allowed_actions(found: DataFrame, risk: str = "risk", exists: str = "exists") -> DataFrame:
    """One row per finding and allowed action, from the decision table compiled into the row."""
    offers = []
    for action, must_exist, risks in RISK_ACTIONS:
        test = F.col(risk).isin(*risks)
        if must_exist is not None:
            test = test & (F.col(exists) == F.lit(must_exist))
        offers.append(F.when(test, F.lit(action)))
    return found.select(*found.columns, F.explode(F.array_compact(F.array(*offers))).alias("action"))


def set_status(accounts: DataFrame, chosen: DataFrame, keys: list[str], status: str, column: str = "status") -> DataFrame:
    """Bulk status change of the chosen accounts; the others keep theirs."""
    picked = chosen.select(*keys).distinct().withColumn("_picked", F.lit(True))
    value = F.when(F.col("_picked"), F.lit(STATUS[status])).otherwise(F.col(column))
    return accounts.join(picked, keys, "left").withColumn(column, value).drop("_picked")


def timeline_text(risk: Column, kind: Column, action: Column, comment: Column, date: Column, diff: Column) -> Column:
    """Text of one timeline entry: found again and again it tells the risk, processed it tells the action."""
    told = None
    for name, text in TIMELINE_TEXTS.items():
        told = F.when(risk == name, F.lit(text)) if told is None else told.when(risk == name, F.lit(text))
    for name, text in TIMELINE_DATED.items():
        told = told.when(risk == name, F.concat(F.lit(f"{text}: "), F.date_format(date, "yyyy-MM-dd HH:mm:ss")))
    told = told.when(risk.isin(*TIMELINE_DIFFED), F.concat(F.lit("Diff: "), diff)).otherwise(F.lit("Other"))
    with_comment = F.when(comment.isNotNull() & (comment != ""), F.concat(action, F.lit(" ("), comment, F.lit(")"))).otherwise(action)
    return F.when(kind.isNull() | kind.isin("", "init", "refind"), told).when(kind == "process", with_comment)


def pending_types(found: DataFrame) -> DataFrame:
    """Distinct risks among the pending findings."""
    return found.where(F.col("status") == STATUS["pending"]).select("risk").distinct()
