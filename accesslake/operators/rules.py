"""Access rules, command filters and sync strategies evaluated over events.

Rules are documents known when the plan is built. They compile to conditional expressions ordered by priority, so an
evaluation is one narrow pass: no join with the rules, no shuffle, no window, and the same expression serves a stream.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.functions.calendar import in_week_period
from accesslake.functions.network import ip_in
from accesslake.functions.values import all_of, any_of
from accesslake.operators.predicates import combine_rules, rule_test

# Rule defaults.
DEFAULT_PRIORITY = 50
DEFAULT_LOGIN_ACTION = "reject"
ACTIONS_WITH_REVIEWERS = ["review", "notice"]


def by_priority(rules: list[dict]) -> list[dict]:
    """Lower number first, then the id."""
    return sorted(rules, key=lambda r: (r.get("priority", DEFAULT_PRIORITY), r["id"]))


def access_test(
    rule: dict, user_key: str, asset_key: str | None = None, account: str | None = None, address: str | None = None, ts: str | None = None
) -> Column:
    """All scopes of one rule: users, assets, accounts, IP group and weekly period. An absent scope does not restrict."""
    tests = [rule_test(rule.get("users", {"type": "all"}), user_key)]
    if asset_key:
        tests.append(rule_test(rule.get("assets", {"type": "all"}), asset_key))
    accounts = rule.get("accounts", ["@ALL"])
    if account and "@ALL" not in accounts:
        tests.append(F.coalesce(F.col(account).isin(*accounts), F.lit(False)))
    if address:
        tests.append(ip_in(F.col(address), rule.get("ip_group") or ["*"]))
    if ts:
        tests.append(in_week_period(F.col(ts), rule.get("time_period") or []))
    return all_of(tests)


def first_match(tests: list[tuple[dict, Column]], default_action: str | None = None) -> Column:
    """The first holding test's rule as a struct (rule, priority, action); null fields when none holds."""

    def outcome(rule):
        return F.struct(
            F.lit(rule["id"]).alias("rule"),
            F.lit(rule.get("priority", DEFAULT_PRIORITY)).alias("priority"),
            F.lit(rule.get("action", default_action)).cast("string").alias("action"),
        )

    none = F.struct(
        F.lit(None).cast("int").alias("rule"), F.lit(None).cast("int").alias("priority"), F.lit(None).cast("string").alias("action")
    )
    chain = None
    for rule, test in tests:
        chain = F.when(test, outcome(rule)) if chain is None else chain.when(test, outcome(rule))
    return none if chain is None else chain.otherwise(none)


def evaluate(events: DataFrame, rules: list[dict], user_key: str, default_action: str | None = None, **scopes: str) -> DataFrame:
    """Adds the winning ``rule``, its ``priority`` and its ``action`` to every event."""
    live = [r for r in by_priority(rules) if r.get("is_active", True)]
    hit = first_match([(r, access_test(r, user_key, **scopes)) for r in live], default_action)
    return events.withColumn("_hit", hit).select(*events.columns, "_hit.rule", "_hit.priority", "_hit.action")


def all_matches(events: DataFrame, rules: list[dict], user_key: str, **scopes: str) -> DataFrame:
    """One row per event and matching rule; at most as many rows per event as there are rules."""
    live = [r for r in by_priority(rules) if r.get("is_active", True)]
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    access_test(r, user_key, **scopes),
                    F.struct(
                        F.lit(r["id"]).alias("rule"),
                        F.lit(r.get("priority", DEFAULT_PRIORITY)).alias("priority"),
                        F.lit(r.get("action")).cast("string").alias("action"),
                    ),
                )
                for r in live
            ]
        )
    )
    return events.select(*events.columns, F.inline(hits))


def check_login_rules(rules: list[dict]) -> list[dict]:
    """Rules with the default action filled in; a reviewing action must name reviewers."""
    checked = [{"action": DEFAULT_LOGIN_ACTION, "ip_group": ["*"], **r} for r in rules]
    for rule in checked:
        if rule["action"] in ACTIONS_WITH_REVIEWERS and not rule.get("reviewers"):
            raise ValueError(f"rule {rule['id']}: action {rule['action']} needs reviewers")
    return checked


def login_acl(logins: DataFrame, rules: list[dict], user_key: str, address: str, ts: str) -> DataFrame:
    return evaluate(logins, check_login_rules(rules), user_key, DEFAULT_LOGIN_ACTION, address=address, ts=ts)


# A pattern that no text matches.
NO_COMMAND = r"(?!)"


def command_pattern(group: dict) -> str:
    """Java regular expression of a command group: one command per line as whole words, or the group's own regex.

    A group without any command hits nothing.
    """
    if group["type"] == "regex":
        if not group["content"].strip():
            return NO_COMMAND
        body = group["content"]
    else:
        commands = [c.strip() for c in re.split(r"[\r\n]+", group["content"]) if c.strip()]
        if not commands:
            return NO_COMMAND
        body = r"(?<!\w)(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", c) for c in commands) + r")(?!\w)"
    return f"(?i){body}" if group.get("ignore_case", True) else body


def match_commands(commands: DataFrame, groups: list[dict], text: str = "input") -> DataFrame:
    """Commands hit by a group, one row per hit, with the group's ``id`` as ``group``."""
    hits = F.array_compact(
        F.array(*[F.when(F.col(text).rlike(command_pattern(g)), F.lit(g["id"])) for g in sorted(groups, key=lambda g: g["id"])])
    )
    return commands.select(*commands.columns, F.explode(hits).alias("group"))


def command_rule(commands: DataFrame, rules: list[dict], text: str = "input") -> DataFrame:
    """First rule by priority one of whose command groups hits the text."""
    tests = [(r, any_of([F.col(text).rlike(command_pattern(g)) for g in r["groups"]])) for r in by_priority(rules)]
    return commands.withColumn("_hit", first_match(tests)).select(*commands.columns, "_hit.rule", "_hit.priority", "_hit.action")


def assign(instances: DataFrame, strategies: list[dict]) -> DataFrame:
    """Instances with each attribute set by the first strategy, in priority order, that matches and sets it.

    Strategies carry ``rules`` on instance attributes, a ``rule_relation`` and ``actions`` [{attr, value}].
    The result has one row per instance and attribute set.
    """
    by_attr: dict[str, list] = {}
    for s in by_priority(strategies):
        for action in s["actions"]:
            by_attr.setdefault(action["attr"], []).append((s, action["value"]))
    columns = []
    for attr, offers in by_attr.items():
        chain = None
        for s, value in offers:
            test = combine_rules(s["rules"], s.get("rule_relation", "and"))
            out = F.struct(F.lit(attr).alias("attr"), F.lit(value).alias("value"), F.lit(s["id"]).alias("strategy"))
            chain = F.when(test, out) if chain is None else chain.when(test, out)
        columns.append(chain)
    return instances.select(*instances.columns, F.inline(F.array_compact(F.array(*columns))))
