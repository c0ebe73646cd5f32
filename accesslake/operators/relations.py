"""Joins between entities: display of relations, entitlements, reconciliation, group and node membership."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from accesslake.functions.values import all_of, any_of
from accesslake.operators.predicates import validity

# Account selectors of a permission.
ALL, SPEC, NOT, NONE, SAME_USER, INPUT, ANON = "@ALL", "@SPEC", "@NOT", "@NONE", "@USER", "@INPUT", "@ANON"


def attach(df: DataFrame, dim: DataFrame, fk: str, dim_key: str, **names: str) -> DataFrame:
    """Left join that adds ``new=column`` of a related table. Spark broadcasts it when its measured size is small."""
    picked = dim.select(F.col(dim_key).alias(fk), *[F.col(column).alias(new) for new, column in names.items()])
    return df.join(picked, fk, "left")


def attach_spread(
    df: DataFrame,
    per_key: DataFrame,
    keys: str | list[str],
    row_id: Column,
    rows: str | None = None,
    hot_keys: int = 1000,
) -> DataFrame:
    """Left join of one-row-per-key results back to their rows when a key may hold a large part of all rows.

    ``rows`` names the result's count of the key's rows. Keys above a ``hot_keys``-th of the counted rows (so never
    more than that many keys, which bounds what is broadcast) have their rows spread by a hash of the row's id over as
    many tasks as their count is such shares, and only their results are repeated as often. The salt also keeps an
    exchange right below the join on both sides (an aggregated side alone would bring none), which lets adaptive
    execution split partitions that are still too large; without ``rows`` that splitting is relied on alone. Rows
    without a key are spread over ``hot_keys`` ways.
    """
    keys = [keys] if isinstance(keys, str) else keys
    # The joins would add this test to some readers of the result and not to others; said here, all share one exchange.
    per_key = per_key.where(all_of([F.col(k).isNotNull() for k in keys]))
    if rows is None:
        marked, flagged = per_key.withColumn("_ways", F.lit(1)), df.withColumn("_ways", F.lit(1))
    else:
        share = per_key.select(F.sum(rows)).scalar() / hot_keys
        marked = per_key.withColumn("_ways", F.ceil(F.col(rows) / share).cast("int"))
        flagged = df.join(F.broadcast(marked.where("_ways > 1").select(*keys, "_ways")), keys, "left")
    keyless = any_of([F.col(k).isNull() for k in keys])
    ways = F.when(keyless, hot_keys).otherwise(F.coalesce("_ways", F.lit(1)))
    salted = flagged.withColumn("_salt", F.pmod(F.xxhash64(row_id), ways).cast("int")).drop("_ways")
    repeated = marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1))).drop("_ways")
    return salted.join(repeated, [*keys, "_salt"], "left").drop("_salt")


def with_counts(base: DataFrame, key: str, children: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """``base`` with any number of counts over its rows in one table: one scan, one aggregation and one join."""
    per_key = children.groupBy(key).agg(*[c.alias(name) for name, c in counts.items()])
    return base.join(per_key, key, "left").fillna(0, list(counts))


def relation_amounts(base: DataFrame, key: str, bridges: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Member counts: for each bridge table the distinct members in each named column (``new=column``).

    A bridge is scanned once for all its columns and reduced to one row per key before the join.
    """
    for bridge, columns in bridges:
        base = with_counts(base, key, bridge, {name: F.count_distinct(column) for name, column in columns.items()})
    return base


def permission_users(direct: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(permission, user): named users and members of named groups, each pair once."""
    through = groups.join(members, "group").select("permission", "user")
    return direct.select("permission", "user").union(through).distinct()


def permission_assets(direct: DataFrame, nodes: DataFrame, closure: DataFrame, node_assets: DataFrame) -> DataFrame:
    """(permission, asset): named assets and the assets below named nodes, each pair once."""
    below = nodes.join(closure, nodes.node == closure.ancestor).select("permission", F.col("descendant").alias("node"))
    through = below.distinct().join(node_assets, "node").select("permission", "asset")
    return direct.select("permission", "asset").union(through).distinct()


def resolve(requests: DataFrame, permissions: DataFrame, users: DataFrame, assets: DataFrame, actions: list[str]) -> DataFrame:
    """For every asked (user, asset) pair: whether it is granted, by how many permissions, and with which actions.

    The user and asset sides stay factored by permission and only asked pairs are formed; the full product of users
    and assets is never built. ``permissions`` has (permission, actions) of those that hold, see ``in_force``;
    ``actions`` lists the possible actions, each of which becomes one flag, so that a pair is reduced without lists.
    """
    asked = requests.select("user", "asset").distinct()
    covered = assets.withColumn("_covered", F.lit(True))
    candidates = (
        asked.join(users, "user", "left").join(covered, ["permission", "asset"], "left").join(permissions, "permission", "left")
    )
    hit = F.coalesce("_covered", F.lit(False)) & F.col("actions").isNotNull()
    per_pair = candidates.groupBy("user", "asset").agg(
        F.count_if(hit).alias("permissions"), *[F.bool_or(hit & F.array_contains("actions", x)).alias(f"_{x}") for x in actions]
    )
    held = F.array_compact(F.array(*[F.when(F.col(f"_{x}"), F.lit(x)) for x in actions]))
    return per_pair.select("user", "asset", "permissions", (F.col("permissions") > 0).alias("granted"), held.alias("actions"))


def in_force(permissions: DataFrame, as_of) -> DataFrame:
    """Permissions that are active and within their dates at a moment."""
    return validity(permissions, as_of).where("is_valid")


def granted(requests: DataFrame, permissions: DataFrame, users: DataFrame, assets: DataFrame) -> DataFrame:
    """(user, asset, permission) for the asked pairs: every permission in ``permissions`` that grants one, as rows."""
    asked = requests.select("user", "asset").distinct()
    pairs = asked.join(users.join(permissions.select("permission"), "permission", "left_semi"), "user")
    return pairs.join(assets, ["permission", "asset"], "left_semi").select("user", "asset", "permission")


def granted_accounts(grants: DataFrame, permissions: DataFrame, accounts: DataFrame, actions: list[str]) -> DataFrame:
    """(user, asset, account, actions) of granted pairs: the accounts each permission selects, and what may be done with them.

    ``permissions`` has (permission, actions, selectors), ``accounts`` (asset, username). Actions of several permissions
    that select one account are put together, one flag an action.
    """
    scopes = grants.join(permissions, "permission").select(F.col("permission").alias("scope"), F.col("user").cast("string").alias("user"), "asset", "selectors")
    chosen = selected_accounts(scopes, accounts).join(permissions.select(F.col("permission").alias("scope"), "actions"), "scope")
    flags = chosen.groupBy("user", "asset", F.col("username").alias("account")).agg(*[F.bool_or(F.array_contains("actions", x)).alias(f"_{x}") for x in actions])
    held = F.array_compact(F.array(*[F.when(F.col(f"_{x}"), F.lit(x)) for x in actions]))
    return flags.select("user", "asset", "account", held.alias("actions"))


def permitted_users(asset_id, users: DataFrame, assets: DataFrame) -> DataFrame:
    """(user, permission) of one asset's page."""
    granting = assets.where(F.col("asset") == F.lit(asset_id)).select("permission")
    return users.join(granting, "permission").select("user", "permission")


def _has(mark: str) -> Column:
    return F.array_contains("selectors", mark)


def _chosen(exists: Column, username: Column) -> Column:
    """Whether the selectors choose an account, given that it exists on the asset."""
    named = F.array_contains("selectors", username)
    real = _has(ALL) | (_has(SPEC) & named) | (_has(NOT) & ~named) | (_has(SAME_USER) & (username == F.col("user")))
    return exists & real & ~_has(NONE)


def selected_accounts(scopes: DataFrame, accounts: DataFrame) -> DataFrame:
    """The list of accounts each scope may use on its asset, as on one permission's page.

    ``scopes`` has (scope, user, asset, selectors); ``accounts`` has (asset, username). Selectors: ``@ALL`` every
    account; names after ``@SPEC`` those accounts; names after ``@NOT`` all but those; ``@NONE`` nothing; ``@USER``
    the account named like the user; ``@INPUT`` and ``@ANON`` one virtual row each. Written names meet the accounts by
    equality; only ``@ALL`` and ``@NOT`` are expanded by asset, as their answers are that long. To test accesses or count
    accounts over all scopes use ``account_allowed`` and ``usable_accounts``, which do not pair scopes with accounts.
    """
    known = accounts.select("asset", "username").distinct()
    nothing = F.array().cast("array<string>")
    names = F.filter("selectors", lambda x: ~x.startswith("@"))
    wanted = F.concat(F.when(_has(SPEC), names).otherwise(nothing), F.when(_has(SAME_USER), F.array("user")).otherwise(nothing))
    whole = _has(ALL) | _has(NOT)
    by_name = scopes.where(~whole & ~_has(NONE)).select("scope", "user", "asset", F.explode(F.array_distinct(wanted)).alias("username"))
    # ``@ALL`` takes every account, so its selectors need not be moved.
    listing = scopes.where(whole & ~_has(NONE)).select("scope", "user", "asset", F.when(~_has(ALL), F.col("selectors")).alias("selectors"))
    of_asset = listing.join(known, "asset").where(F.col("selectors").isNull() | _chosen(F.lit(True), F.col("username")))
    on_asset = by_name.join(known, ["asset", "username"]).select("scope", "user", "asset", "username").unionByName(of_asset.select("scope", "user", "asset", "username"))
    virtual = scopes.where(~_has(NONE)).select(
        "scope", "user", "asset", F.explode(F.array_intersect("selectors", F.array(F.lit(INPUT), F.lit(ANON)))).alias("username")
    )
    return on_asset.select("scope", "user", "asset", "username").unionByName(virtual)


#: Accounts in all, repeated ones counted too, that Spark broadcasts; more are listed by asset.
FEW = 10_000
#: Accounts of one asset that are listed beside its scopes; assets with more that are told apart by a broadcast.
LISTED, MOST_LONG = 1000, 10_000


def _by_length(rows: DataFrame, accounts: DataFrame, of_lists: Callable, looked_up: Callable) -> DataFrame:
    """``of_lists`` for the rows of assets with up to ``LISTED`` accounts, ``looked_up`` for the others' rows; both take accounts too."""
    accounts = accounts.select("asset", "username").where(F.col("asset").isNotNull())
    if accounts.limit(FEW + 1).count() <= FEW:
        return looked_up(rows, accounts)
    long = accounts.groupBy("asset").agg(F.count("*").alias("n")).where(F.col("n") > LISTED).select("asset").limit(MOST_LONG + 1).collect()
    if len(long) > MOST_LONG:
        return looked_up(rows, accounts)
    if not long:
        return of_lists(rows, accounts)
    marked = F.broadcast(rows.sparkSession.createDataFrame(long, StructType([accounts.schema["asset"]])))
    short, rest = ([x.join(marked, "asset", how) for x in (rows, accounts)] for how in ("left_anti", "left_semi"))
    return of_lists(*short).unionByName(looked_up(*rest))


def _with_names(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds ``_names``, the accounts of the row's asset."""
    known = accounts.repartition("asset").distinct()
    # In a struct, as a list has no nulls otherwise; a nameless account counts.
    lists = known.groupBy("asset").agg(F.collect_list(F.struct("username")).alias("_names"))
    return attach_spread(rows, lists, "asset", F.struct("scope", "user"))


def _allowed(exists: Column) -> Column:
    virtual = F.col("username").isin(INPUT, ANON) & F.array_contains("selectors", F.col("username")) & ~_has(NONE)
    return virtual | _chosen(exists, F.col("username"))


def _allowed_of_lists(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    answers = requests.withColumns({"_if": _allowed(F.lit(True)), "_else": _allowed(F.lit(False))})
    exists = F.coalesce(F.array_contains(F.col("_names.username"), F.col("username")), F.lit(False))
    joined = _with_names(answers, accounts).withColumn("allowed", F.when(exists, F.col("_if")).otherwise(F.col("_else")))
    return joined.drop("_names", "_if", "_else")


def _allowed_looked_up(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    known = accounts.distinct().withColumn("_known", F.lit(True))
    joined = attach_spread(requests, known, ["asset", "username"], F.struct("scope", "user"))
    return joined.withColumn("allowed", _allowed(F.col("_known").isNotNull())).drop("_known")


def account_allowed(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds ``allowed`` to requests (scope, user, asset, selectors, username): one equality join, whatever the selector.

    An asset's accounts come as one list while they are few; selectors are read before the join, which moves two answers instead.
    """
    return _by_length(requests, accounts, _allowed_of_lists, _allowed_looked_up)


def _wanted_names() -> Column:
    """The names whose accounts are counted one by one: those left out by ``@NOT``, else those added."""
    nothing = F.array().cast("array<string>")
    names = F.filter("selectors", lambda x: ~x.startswith("@"))
    own = F.when(_has(SAME_USER), F.array("user")).otherwise(nothing)
    some = F.when(_has(NOT), F.array_except(names, own)).when(_has(SPEC), F.concat(names, own)).otherwise(own)
    return F.array_distinct(F.array_compact(F.when(_has(ALL) | _has(NONE), nothing).otherwise(some)))


def _usable_of_lists(scopes: DataFrame, accounts: DataFrame) -> DataFrame:
    counted = _with_names(scopes, accounts)
    names = F.coalesce(F.col("_names.username"), F.array().cast("array<string>"))
    # As by the join, no names are found for a scope of a null id, user or asset.
    whole = all_of([F.col(c).isNotNull() for c in ("scope", "user", "asset")])
    total, named = F.size(names), F.when(whole, F.size(F.array_intersect(_wanted_names(), names))).otherwise(0)
    real = F.when(_has(ALL), total).when(_has(NOT), total - named).otherwise(named)
    virtual = F.size(F.array_intersect("selectors", F.array(F.lit(INPUT), F.lit(ANON))))
    usable = F.when(_has(NONE), F.lit(0)).otherwise(real + virtual).cast("bigint")
    return counted.withColumn("usable", usable).drop("_names")


def _usable_looked_up(scopes: DataFrame, accounts: DataFrame) -> DataFrame:
    ids = ["scope", "user", "asset"]
    known = accounts.select("asset", "username").distinct()
    totals = known.groupBy("asset").agg(F.count("*").alias("_total"))
    nothing = F.array().cast("array<string>")
    names = F.filter("selectors", lambda x: ~x.startswith("@"))
    wanted = F.array_distinct(F.concat(names, F.when(_has(SAME_USER), F.array("user")).otherwise(nothing)))
    by_name = F.when(_has(ALL) | _has(NONE), nothing).otherwise(wanted)
    listed = F.array_contains("selectors", F.col("username"))
    looked_up = scopes.select(*ids, F.explode(by_name).alias("username"), "selectors").select(*ids, "username", listed.alias("_listed"))
    found = attach_spread(
        looked_up, known.withColumn("_known", F.lit(True)), ["asset", "username"], F.struct("scope", "user")
    ).where(F.col("_known"))
    per_scope = found.groupBy(*ids).agg(
        F.count_if("_listed").alias("_named"),
        F.count_if(F.col("username") == F.col("user")).alias("_own"),
        F.count_if(F.col("_listed") & (F.col("username") == F.col("user"))).alias("_own_named"),
    )
    counted = attach_spread(scopes, totals, "asset", F.struct("scope", "user")).join(per_scope, ids, "left")

    def n(c):
        return F.coalesce(F.col(c), F.lit(0).cast("bigint"))

    own = F.when(_has(SAME_USER), n("_own") - F.when(_has(SPEC), n("_own_named")).otherwise(0)).otherwise(0)
    own_excluded = F.when(_has(SAME_USER), n("_own_named")).otherwise(0)
    real = (
        F.when(_has(ALL), n("_total"))
        .when(_has(NOT), n("_total") - n("_named") + own_excluded)
        .when(_has(SPEC), n("_named") + own)
        .otherwise(own)
    )
    virtual = F.size(F.array_intersect("selectors", F.array(F.lit(INPUT), F.lit(ANON))))
    usable = F.when(_has(NONE), F.lit(0)).otherwise(real + virtual).cast("bigint")
    return counted.withColumn("usable", usable).drop("_total", "_named", "_own", "_own_named")


def usable_accounts(scopes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds ``usable``, the number of accounts the scope may use on its asset, virtual ones included.

    ``@ALL`` and ``@NOT`` start from the asset's account total, and only the names written in the selector are looked
    up one by one: in the asset's list of accounts while it is short, by a join otherwise. ``scopes`` is unique by
    (scope, user, asset).
    """
    return _by_length(scopes, accounts, _usable_of_lists, _usable_looked_up)


def account_exists(wanted: DataFrame, accounts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``exists`` to every wanted account; the account list is reduced to its keys before the join."""
    known = accounts.select(*keys).distinct().withColumn("_known", F.lit(True))
    joined = attach_spread(wanted, known, keys, F.struct(*wanted.columns))
    return joined.withColumn("exists", F.col("_known").isNotNull()).drop("_known")


def all_exist(checked: DataFrame) -> DataFrame:
    """One row: true when the batch is not empty and every account exists."""
    return checked.agg(F.coalesce(F.bool_and("exists"), F.lit(False)).alias("all_exist"))


class Snapshot(NamedTuple):
    """One row per key of the ``rows`` that are ``held``: ``values`` names an aggregate, which skips nulls, of a column of them."""

    rows: DataFrame
    held: Column
    keys: list[str]
    values: dict[str, tuple[Callable[[Column], Column], str]]

    def frame(self) -> DataFrame:
        return self.rows.where(self.held).groupBy(*self.keys).agg(*[f(F.col(c)).alias(name) for name, (f, c) in self.values.items()])


def reconcile(managed: DataFrame | Snapshot, discovered: DataFrame | Snapshot, keys: list[str]) -> DataFrame:
    """Full outer join with ``present`` (managed) and ``remote_present`` (on the host).

    Other columns arrive as ``managed_x`` and ``remote_x``. Snapshots of the same rows by these keys are reduced together, so
    that a task holds one table of accounts instead of two and their sorted copies. A null key is found on one side only.
    """
    if isinstance(managed, Snapshot) and isinstance(discovered, Snapshot):
        if managed.rows is discovered.rows and managed.keys == discovered.keys == keys:
            return _reduced_together(managed, discovered, keys)
    managed, discovered = (x.frame() if isinstance(x, Snapshot) else x for x in (managed, discovered))

    def side(df, prefix, flag):
        rest = [F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys]
        return df.select(*keys, *rest, F.lit(True).alias(flag))

    joined = side(managed, "managed", "present").join(side(discovered, "remote", "remote_present"), keys, "full_outer")
    return joined.withColumns(
        {"present": F.coalesce("present", F.lit(False)), "remote_present": F.coalesce("remote_present", F.lit(False))}
    )


def _reduced_together(managed: Snapshot, discovered: Snapshot, keys: list[str]) -> DataFrame:
    sides = [("managed", "present", 1, managed), ("remote", "remote_present", 2, discovered)]
    totals = [f(F.when(one.held, F.col(c))).alias(f"{side}_{x}") for side, _, _, one in sides for x, (f, c) in one.values.items()]
    on = [F.when(one.held, F.lit(bit)).otherwise(F.lit(0)) for _, _, bit, one in sides]
    grouped = managed.rows.where(managed.held | discovered.held).groupBy(*keys).agg(*totals, F.bit_or(on[0].bitwiseOR(on[1])).alias("_on"))
    # Null keys equal none: a group of them that both sides have is a row of either.
    apart = any_of([F.col(k).isNull() for k in keys]) & (F.col("_on") == 3)
    rows = grouped.withColumn("_side", F.explode(F.when(apart, F.array(F.lit(1), F.lit(2))).otherwise(F.array("_on"))))
    picked = []
    for side, flag, bit, one in sides:
        here = F.col("_side").bitwiseAND(F.lit(bit)) != 0
        picked += [F.when(here, F.col(f"{side}_{x}")).alias(f"{side}_{x}") for x in one.values] + [here.alias(flag)]
    return rows.select(*keys, *picked)


def sync_classify(cloud: DataFrame, local: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Class of every instance: new (cloud only), released (local only), sync (equal) or unsync (attributes differ)."""
    c = cloud.select(F.col(key), F.struct(*attributes).alias("_cloud"))
    l = local.select(F.col(key), F.struct(*attributes).alias("_local"))
    kind = (
        F.when(F.col("_local").isNull(), "new")
        .when(F.col("_cloud").isNull(), "released")
        .when(F.col("_cloud").eqNullSafe(F.col("_local")), "sync")
        .otherwise("unsync")
    )
    return c.join(l, key, "full_outer").select(key, kind.alias("class"))


def session_children(sessions: DataFrame, key: str, children: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Sessions with the number of their commands, file logs, join records, ...: per child table the named tests."""
    for child, tests in children:
        sessions = with_counts(sessions, key, child, {name: F.count_if(test) for name, test in tests.items()})
    return sessions


def leaked(accounts: DataFrame, leaks: DataFrame, secret: str = "secret", password: str = "password") -> DataFrame:
    """Accounts whose secret is in the leak list; both sides meet as hashes only."""
    hashes = leaks.select(F.sha2(F.col(password), 256).alias("_hash"))
    return accounts.withColumn("_hash", F.sha2(F.col(secret), 256)).join(hashes, "_hash", "left_semi").drop("_hash")


def members_of(users: DataFrame, membership: DataFrame, group) -> DataFrame:
    return users.join(membership.where(F.col("group") == F.lit(group)).select("user"), users.id == F.col("user"), "left_semi")


def not_members_of(users: DataFrame, membership: DataFrame, group) -> DataFrame:
    return users.join(membership.where(F.col("group") == F.lit(group)).select("user"), users.id == F.col("user"), "left_anti")


def assets_below(asset_nodes: DataFrame, closure: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ancestor, asset) for the wanted nodes, descendants included; an asset counts once per ancestor."""
    below = closure.join(wanted.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    return asset_nodes.join(below, asset_nodes.node == below.descendant).select("ancestor", "asset").distinct()
