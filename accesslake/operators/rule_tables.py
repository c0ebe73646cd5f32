"""Access rules and address groups given as tables of any length, matched by equality joins.

``rules.evaluate`` compiles a short list of rule documents into one expression; this is the form for rules that are data.
The caller chooses between the two.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.functions.network import ip_to_long
from accesslake.functions.values import all_of


def networks_of(address: Column, lengths: list[int]) -> Column:
    """The networks of the given prefix lengths that an IPv4 address lies in, as an array of (length, prefix)."""
    number = ip_to_long(address)
    return F.array(*[F.struct(F.lit(n).alias("length"), F.shiftright(number, 32 - n).alias("prefix")) for n in lengths])


def network_blocks(spec: Column) -> Column:
    """The fewest networks, as an array of (length, prefix), that cover ``*``, an address, ``a/length`` or a range ``a-b``.

    Both ends of a range belong to it; 62 networks are enough for any. Null for a text that is none of these, and for a
    range whose ends are the wrong way round.
    """
    kind = "array<struct<length:int,prefix:bigint>>"

    def one(length, low):
        return F.array(F.struct(length.alias("length"), F.call_function("shiftright", low, 32 - length).alias("prefix")))

    text = F.trim(spec)
    parts, ends = F.split(text, "/"), F.split(text, "-")
    base, length = ip_to_long(F.get(parts, F.lit(0))), F.get(parts, F.lit(1)).try_cast("int")
    low, high = (ip_to_long(F.trim(F.get(ends, F.lit(i)))) for i in range(2))

    def climb(state, bits):
        """Blocks of 2**bits addresses at both open ends; what is left is a range of such blocks."""
        left, right = state["left"], state["right"]
        odd_left = (left < right) & (left % 2 == 1)
        after = F.when(odd_left, left + 1).otherwise(left)
        odd_right = (after < right) & (right % 2 == 1)
        before = F.when(odd_right, right - 1).otherwise(right)
        size = (F.lit(32) - bits).cast("int")
        mine = [F.when(odd_left, F.array(F.struct(size.alias("length"), left.alias("prefix")))), F.when(odd_right, F.array(F.struct(size.alias("length"), before.alias("prefix"))))]
        blocks = F.concat(state["blocks"], *(F.coalesce(m, F.array().cast(kind)) for m in mine))
        return F.struct(F.shiftright(after, 1).alias("left"), F.shiftright(before, 1).alias("right"), blocks.alias("blocks"))

    start = F.struct(low.alias("left"), (high + 1).alias("right"), F.array().cast(kind).alias("blocks"))
    spread = F.reduce(F.sequence(F.lit(0), F.lit(32)), start, climb)["blocks"]
    everything = F.array(F.struct(F.lit(0).alias("length"), F.lit(0).cast("bigint").alias("prefix")))
    return (
        F.when(text == "*", everything)
        .when((F.size(ends) == 2) & (low <= high), spread)
        .when((F.size(parts) == 2) & base.isNotNull() & length.between(0, 32), one(length, base))
        .when((F.size(parts) == 1) & base.isNotNull(), one(F.lit(32), base))
    )


def unreadable_networks(networks: DataFrame) -> DataFrame:
    """The rows of (group, network) that ``match_networks`` can't read and that therefore match nothing."""
    return networks.where(network_blocks(F.col("network")).isNull())


#: Rows that may meet one block in one task; the rows of a busier block are dealt to several.
ROWS_A_BLOCK = 10_000


def outermost(blocks: DataFrame, lengths: list[int]) -> DataFrame:
    """The blocks (_group, _length, _prefix) that lie in no other block of their group; what a group covers stays the same."""
    wider = F.filter(
        F.array(*[F.struct(F.lit(n).alias("length"), F.call_function("shiftright", F.col("_prefix"), F.col("_length") - n).alias("prefix")) for n in lengths]),
        lambda block: block["length"] < F.col("_length"),
    )
    around = blocks.select("*", F.explode(wider).alias("_in"))
    held = blocks.select(*[F.col(c).alias(f"_held{c}") for c in blocks.columns])
    at = (F.col("_in.length") == F.col("_held_length")) & (F.col("_in.prefix") == F.col("_held_prefix")) & F.col("_group").eqNullSafe(F.col("_held_group"))
    inner = around.join(held, at, "left_semi").select(*[F.col(c).alias(f"_inner{c}") for c in blocks.columns])
    same = (F.col("_length") == F.col("_inner_length")) & (F.col("_prefix") == F.col("_inner_prefix")) & F.col("_group").eqNullSafe(F.col("_inner_group"))
    return blocks.join(inner, same, "left_anti")


def match_networks(rows: DataFrame, address: str, networks: DataFrame) -> DataFrame:
    """The different ``rows`` with the ``group`` of every network the address lies in; one row per group hit.

    ``networks`` has (group, network) with the network as ``*``, an address, ``a.b.c.d/length`` or a range ``a-b``; a range
    becomes the fewest networks that cover it. An address is looked up by its leading bits, once per prefix length that
    occurs (33 at most), so the join is one of equality however many networks there are. Texts that are none of these
    match nothing; ``unreadable_networks`` lists them. An address that is none lies in no network, ``*`` included.

    A group's blocks are made disjoint first, so an address meets a group once and the hits, which may be far more than the
    rows, need no distinct. A block that more than ``ROWS_A_BLOCK`` rows lie in (``*``, a short prefix, a frequent address)
    is repeated, and its rows are dealt over the copies. The looked-up rows are never broadcast: Spark takes them for as
    small as the table they come from.
    """
    blocks = networks.select(F.col("group").alias("_group"), F.explode(network_blocks(F.col("network"))).alias("_block"))
    blocks = blocks.select("_group", F.col("_block.length").alias("_length"), F.col("_block.prefix").alias("_prefix")).distinct()
    lengths = sorted(r["_length"] for r in blocks.select("_length").distinct().collect())
    table = outermost(blocks, lengths) if len(lengths) > 1 else blocks
    number = ip_to_long(F.col(address))
    known = rows.where(number.isNotNull()).distinct()
    places = F.explode(networks_of(F.col(address), lengths) if lengths else F.array().cast("array<struct<length:int,prefix:bigint>>")).alias("_at")

    per_address = known.groupBy(F.col(address)).agg(F.count("*").alias("_n")).select("_n", places)
    seen = per_address.groupBy(F.col("_at.length").alias("_l"), F.col("_at.prefix").alias("_p")).agg(F.sum("_n").alias("_n"))
    # Only blocks of the table count, and a thousandth of their rows is never less than a share: 1,000 busy ones at most.
    met = seen.join(table.select(F.col("_length").alias("_l"), F.col("_prefix").alias("_p")).distinct().hint("merge"), ["_l", "_p"], "left_semi")
    share = F.greatest(F.lit(ROWS_A_BLOCK).cast("double"), met.select(F.sum("_n")).scalar() / 1000)
    busy = met.withColumn("_ways", F.ceil(F.col("_n") / share).cast("int")).where("_ways > 1").drop("_n")
    dealt = table.join(F.broadcast(busy), (F.col("_length") == F.col("_l")) & (F.col("_prefix") == F.col("_p")), "left")
    dealt = dealt.select("_group", "_length", "_prefix", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1)).alias("_part"))
    asked = known.select("*", places).join(F.broadcast(busy), (F.col("_at.length") == F.col("_l")) & (F.col("_at.prefix") == F.col("_p")), "left")
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.coalesce("_ways", F.lit(1))).cast("int"))
    hit = (F.col("_at.length") == F.col("_length")) & (F.col("_at.prefix") == F.col("_prefix")) & (F.col("_salt") == F.col("_part"))
    return asked.join(dealt.hint("merge"), hit).select(*(F.col(f"`{c}`") for c in rows.columns), F.col("_group").alias("group"))


HALF_HOURS = 48


def week_bitmaps(periods: DataFrame) -> DataFrame:
    """(rule, weeks): for each weekday, 0 Sunday, a number whose bit h is set if the half-hour h belongs to the rule.

    ``periods`` has (rule, weekday, begin, finish) with times as ``HH:MM``; an end of 00:00 means midnight. The product's editor
    gives half-hours; a time between them is widened to the whole half-hour. Rows that can't be read set nothing.
    """

    def minutes(c):
        parts = F.split(F.trim(c), ":")
        return F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")

    begin, finish = minutes(F.col("begin")), minutes(F.col("finish"))
    first, last = F.floor(begin / 30), F.ceil(F.when(finish == 0, 1440).otherwise(finish) / 30)
    ones = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")) - 1
    bits = F.when((first >= 0) & (first < last) & (last <= HALF_HOURS), ones(last) - ones(first)).otherwise(F.lit(0).cast("bigint"))
    days = [F.coalesce(F.bit_or(F.when(F.col("weekday") == day, bits)), F.lit(0).cast("bigint")) for day in range(7)]
    return periods.groupBy("rule").agg(F.array(*days).alias("weeks"))


def half_hour(ts: Column) -> Column:
    """The half-hour of the week, 0 at midnight to Sunday."""
    return ((F.dayofweek(ts) - 1) * HALF_HOURS + F.floor((F.hour(ts) * 60 + F.minute(ts)) / 30)).cast("int")


def login_acl_table(logins: DataFrame, user: str, address: str, ts: str, rules: DataFrame, users: DataFrame, networks: DataFrame, periods: DataFrame, default_action: str = "reject", default_priority: int = 50) -> DataFrame:
    """Adds the winning login ``rule``, its ``priority`` and its ``action`` to every login; nulls where none matches.

    ``rules`` has (rule, priority, action), ``users`` (rule, value), ``networks`` (rule, network) as in ``match_networks`` and
    ``periods`` (rule, weekday, begin, finish) as in ``week_bitmaps``. A rule without rows in one of them is not restricted by
    it; rows that can't be read restrict all the same. The lowest priority wins, then the smallest rule.

    Logins are first reduced to their different (user, address, half-hour of the week), so a user with a third of all logins
    and thousands of rules costs at most 336 combinations an address. A combination meets the rules that name its user, and
    those that name only networks, by equality; the period is one shifted bit. Rules that only a period restricts are
    reduced to the best one a half-hour first, 336 rows whatever the rules. Logins without a user, address or time can
    only match rules that don't restrict it.
    """
    best = F.min(F.struct("priority", "rule", "action"))
    every = F.array(*[F.lit((1 << HALF_HOURS) - 1)] * 7)
    limited = lambda table, name: table.select("rule", F.lit(True).alias(name)).distinct()
    live = rules.select("rule", F.coalesce("priority", F.lit(default_priority)).alias("priority"), F.coalesce("action", F.lit(default_action)).alias("action"))
    live = live.join(limited(users, "_users"), "rule", "left").join(limited(networks, "_networks"), "rule", "left").join(week_bitmaps(periods), "rule", "left")
    live = live.select("rule", "priority", "action", F.coalesce("_users", F.lit(False)).alias("_users"), F.coalesce("_networks", F.lit(False)).alias("_networks"), F.col("weeks").isNull().alias("_always"), F.coalesce("weeks", every).alias("weeks"))

    slot = half_hour(F.col(ts))
    asked = logins.select(F.col(user).alias("_user"), F.col(address).alias("_address"), slot.alias("_slot")).distinct()
    day, bit = F.floor(F.col("_slot") / HALF_HOURS).cast("int"), F.col("_slot") % HALF_HOURS
    open_ = F.col("_always") | F.coalesce(F.call_function("shiftright", F.get("weeks", day), bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    hits = match_networks(asked.select("_address").distinct(), "_address", networks.select(F.col("rule").alias("group"), "network"))
    hits = hits.select(F.col("_address").alias("_of"), F.col("group").alias("_rule"))

    named = asked.join(users.select(F.col("rule").alias("_named"), F.col("value").alias("_value")).distinct(), F.col("_user") == F.col("_value"))
    named = named.join(live.where("_users"), F.col("_named") == F.col("rule")).where(open_)
    named = named.join(hits, (F.col("_address") == F.col("_of")) & (F.col("rule") == F.col("_rule")), "left").where(~F.col("_networks") | F.col("_rule").isNotNull())
    placed = asked.select("_address", "_slot").distinct().join(hits, F.col("_address") == F.col("_of")).join(live.where("not _users and _networks"), F.col("_rule") == F.col("rule")).where(open_)
    free = live.where("not _users and not _networks")
    slots = logins.sparkSession.range(0, 7 * HALF_HOURS, 1, 1).select(F.col("id").cast("int").alias("_slot"))
    timed = free.where("not _always").select("priority", "rule", "action", "weeks", "_always", F.explode(F.sequence(F.lit(0), F.lit(7 * HALF_HOURS - 1))).alias("_slot")).where(open_)
    by_slot = slots.join(timed.groupBy("_slot").agg(best.alias("_timed")), "_slot", "left").select(F.col("_slot").alias("_s"), "_timed")
    always = free.where("_always").agg(best).scalar()

    by_user = named.groupBy("_user", "_address", "_slot").agg(best.alias("_named"))
    by_place = placed.groupBy(F.col("_address").alias("_a"), F.col("_slot").alias("_t")).agg(best.alias("_placed"))
    by_user = by_user.select(F.col("_user").alias("_u"), F.col("_address").alias("_b"), F.col("_slot").alias("_v"), "_named")
    won = asked.join(by_user, F.col("_user").eqNullSafe(F.col("_u")) & F.col("_address").eqNullSafe(F.col("_b")) & F.col("_slot").eqNullSafe(F.col("_v")), "left")
    won = won.join(by_place, F.col("_address").eqNullSafe(F.col("_a")) & F.col("_slot").eqNullSafe(F.col("_t")), "left").join(F.broadcast(by_slot), F.col("_slot") == F.col("_s"), "left")  # 336 rows
    won = won.select(F.col("_user").alias("_u"), F.col("_address").alias("_a"), F.col("_slot").alias("_t"), F.least("_named", "_placed", "_timed", always).alias("_won"))
    at = F.col(user).eqNullSafe(F.col("_u")) & F.col(address).eqNullSafe(F.col("_a")) & slot.eqNullSafe(F.col("_t"))
    return logins.join(won, at, "left").select(*logins.columns, "_won.rule", "_won.priority", "_won.action")


#: A rule whose columns have more combinations of values than this many times its values (1 at least) is not spelled out.
MOST_SPELLED = 16


def evaluate_table(events: DataFrame, event_id: str, rules: DataFrame, scopes: dict[str, DataFrame]) -> DataFrame:
    """Adds the winning ``rule``, its ``priority`` and its ``action`` to every event; nulls where none matches.

    ``rules`` has (rule, priority, action). ``scopes`` maps a column of ``events`` to a table (rule, value): a rule with
    rows there needs the event's value among them, a rule without is not restricted by that column. The lowest priority
    wins, then the smallest rule. ``event_id`` is unique.

    Events and rules are never paired. For each choice of restricting columns the rules are reduced to the best one a
    combination of values, which an event meets by one equality join; work grows with the rows of the scopes plus the
    events. A rule with many values in several columns (see ``MOST_SPELLED``) is not spelled out: it meets the different
    combinations that occur among the events, by its first column, and its other columns are tested by one equality join
    each. Rules that nothing restricts are reduced to the best one first.
    """
    names = list(scopes)
    values = {n: scopes[n].select("rule", F.col("value").alias(f"_{n}")).where(F.col(f"_{n}").isNotNull()).distinct() for n in names}
    flagged = rules.select("rule", "priority", "action")
    for n in names:
        flagged = flagged.join(scopes[n].groupBy("rule").agg(F.count("value").cast("double").alias(f"_size_{n}")), "rule", "left")
    by = {n: F.col(f"_size_{n}").isNotNull() for n in names}
    spelled = reduce(Column.__mul__, [F.coalesce(f"_size_{n}", F.lit(1.0)) for n in names], F.lit(1.0))
    written = reduce(Column.__add__, [F.coalesce(f"_size_{n}", F.lit(0.0)) for n in names], F.lit(0.0))
    wide = spelled > MOST_SPELLED * written

    def only(chosen):
        return reduce(Column.__and__, [by[n] if n in chosen else ~by[n] for n in names], F.lit(True))

    best = F.min(F.struct("priority", "rule", "action"))
    asked, found = events.select(event_id, *names), []
    for chosen in (c for k in range(len(names)) for c in combinations(names, k + 1)):
        mine = flagged.where(only(chosen) & ~wide).select("rule", "priority", "action")
        for n in chosen:
            mine = mine.join(values[n], "rule")
        per_value = mine.groupBy(*[f"_{n}" for n in chosen]).agg(best.alias("_best"))
        found.append(asked.join(per_value, all_of([F.col(n) == F.col(f"_{n}") for n in chosen])).select(event_id, "_best"))
    for i, n in enumerate(names[:-1]):
        first = reduce(Column.__and__, [~by[m] for m in names[:i]], by[n])
        mine = values[n].join(flagged.where(first & wide), "rule")
        hits = events.select(*names).distinct().join(mine, F.col(n) == F.col(f"_{n}")).drop(f"_{n}")
        for m in names[i + 1 :]:
            tested = values[m].select(F.col("rule").alias("_rule"), f"_{m}")
            hits = hits.join(tested, (F.col("rule") == F.col("_rule")) & (F.col(m) == F.col(f"_{m}")), "left").where(~by[m] | F.col("_rule").isNotNull()).drop("_rule", f"_{m}")
        per_value = hits.groupBy(*[F.col(m).alias(f"_{m}") for m in names]).agg(best.alias("_best"))
        found.append(asked.join(per_value, all_of([F.col(m).eqNullSafe(F.col(f"_{m}")) for m in names])).select(event_id, "_best"))
    free = flagged.where(only(())).agg(best).scalar()
    if not found:
        return events.withColumn("_won", free).select(*events.columns, "_won.rule", "_won.priority", "_won.action")
    won = reduce(DataFrame.union, found).groupBy(event_id).agg(F.min("_best").alias("_best"))
    joined = events.join(won, event_id, "left").withColumn("_won", F.least("_best", free))
    return joined.select(*events.columns, "_won.rule", "_won.priority", "_won.action")
