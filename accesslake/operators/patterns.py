"""Command patterns given as a table of any length, met through an index of words and three-letter pieces.

``rules.match_commands`` compiles a short list of groups into one expression; this is the form for patterns that are data.
A pattern is looked up by the one of its words or pieces that the fewest commands have, and then verified as a regular expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.session import cut_lineage

PIECE = 3
#: Patterns in which no piece is certain; they are compiled into one expression and tested on every command.
MOST_LOOSE = 1000
_NO_PLAIN = r"[()\[\]{}|\\]"


def normalized(text: Column) -> Column:
    """Lower-case with everything but ASCII letters, digits and ``_`` as spaces, and a space at both ends."""
    return F.lower(F.concat(F.lit(" "), F.regexp_replace(text, r"[^0-9A-Za-z_]", " "), F.lit(" ")))


def pieces(text: Column) -> Column:
    """The different pieces of a text that hold more than spaces, found in one pass over it."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{PIECE}}}))"), F.lit(1))
    return F.filter(F.array_distinct(cut), lambda x: F.trim(x) != "")


def words(text: Column) -> Column:
    """The runs of ASCII letters, digits and ``_``, as written."""
    return F.regexp_extract_all(text, F.lit("[0-9A-Za-z_]+"), F.lit(0))


def _tagged(mark: str, found: Column) -> Column:
    return F.transform(F.array_distinct(found), lambda w: F.concat(F.lit(mark), w))


def handles(text: Column) -> Column:
    """All that a text can be looked up by: its words as written (``!``), its words in lower case (``=``) and its pieces."""
    return F.concat(_tagged("!", words(text)), _tagged("=", F.transform(words(text), F.lower)), pieces(normalized(text)))


def patterns_of(groups: DataFrame) -> DataFrame:
    """``group, regex, certain, handles, sure`` of command groups (``group, type, content, ignore_case``): one row per pattern.

    A group of type ``command`` has one command a line, found as whole words; of type ``regex``, one regular expression. A text that
    a pattern hits has ``certain`` in its normalized form: of a command, the command itself; of a regular expression without
    brackets, alternatives and escapes, its longest run of plain characters that no quantifier makes optional. It has all
    ``handles`` too: of a command, its words; of such an expression, the pieces of all its runs. A command of one word is
    ``sure``: texts with its handle are hit. Empty lines and empty or null contents hit nothing.
    """
    folds = F.coalesce("ignore_case", F.lit(True))
    fold = F.when(folds, F.lit("(?i)")).otherwise(F.lit(""))
    lines = groups.where("type <> 'regex'").select("group", folds.alias("folds"), fold.alias("fold"), F.explode(F.split("content", r"[\r\n]+")).alias("line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> ''")
    quoted, said = F.regexp_replace("line", r"([^\w\s])", r"\\$1"), words(F.col("line"))
    commands = lines.select(
        "group",
        F.concat("fold", F.lit(r"(?<!\w)"), quoted, F.lit(r"(?!\w)")).alias("regex"),
        normalized(F.col("line")).alias("certain"),
        F.when(F.col("folds"), _tagged("=", F.transform(said, F.lower))).otherwise(_tagged("!", said)).alias("handles"),
        F.coalesce(F.get(said, F.lit(0)) == F.col("line"), F.lit(False)).alias("sure"),
    )
    wild = groups.where(F.col("type") == "regex").where(F.regexp_replace("content", r"\s", "") != "")
    runs = F.split(F.lower(F.regexp_replace("content", r".[?*]", ".")), r"[^0-9a-z_ ]+")
    plain = wild.select("group", F.concat(fold, "content").alias("regex"), F.when(F.col("content").rlike(_NO_PLAIN), F.array(F.lit(""))).otherwise(runs).alias("runs"))
    longest = F.reduce("runs", F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))
    cut = F.array_distinct(F.flatten(F.transform("runs", pieces)))
    return commands.union(plain.select("group", "regex", longest.alias("certain"), cut.alias("handles"), F.lit(False).alias("sure")))


#: Patterns that are broadcast at once; longer lists take so many passes over the commands.
BLOCK = 200_000
#: Tries of a pattern on a command that one task makes on average, and the most tasks that this asks for.
TASK_TRIES, MOST_TASKS = 1_000_000, 20_000


def _blocks(rows: DataFrame, n: int) -> list[DataFrame]:
    return [rows.where(F.pmod(F.xxhash64("group", "regex"), F.lit(n)) == b) for b in range(n)]


def _looked_up(patterns: DataFrame, texts: DataFrame, blocks: int) -> DataFrame:
    """``group, regex, certain, sure, n, handle`` of the patterns: the handle of each that the fewest texts have, and how many do."""
    parts = []
    for block in _blocks(patterns, blocks):
        each = block.select("group", "regex", "certain", "sure", F.explode("handles").alias("handle"))
        # The rows that are counted leave a task as one count a wanted handle.
        seen = texts.join(F.broadcast(each.select("handle").distinct()), "handle", "left_semi").groupBy("handle").agg(F.count("*").alias("n"))
        least = F.min(F.struct("n", "handle")).alias("least")
        # A handle that no text has hits nothing, so such a pattern is not looked up by another.
        sized = each.join(seen, "handle", "left").fillna(0, "n").groupBy("group", "regex", "certain", "sure").agg(least)
        parts.append(sized.select("group", "regex", "certain", "sure", "least.*").where("n > 0"))
    return reduce(DataFrame.union, parts)


def match_command_table(commands: DataFrame, keys: list[str], text: str, groups: DataFrame) -> DataFrame:
    """``commands`` with the ``group`` of every group that hits ``text``, one row per command and group.

    ``keys`` tell commands apart. Each pattern's handles are counted over all commands, and a command tries only the patterns whose
    rarest handle it has, so work grows with the commands' length and the hits of rare handles, not with commands times patterns.
    Commands are dealt out once by their keys, into tasks of about ``TASK_TRIES``, and the patterns come to them, ``BLOCK`` at a
    time: neither handles nor tries are written to disk, and what hits a command is told apart where it is found. Patterns
    without a certain word or piece may be ``MOST_LOOSE`` at most (an error otherwise).
    """
    patterns = cut_lineage(patterns_of(groups).distinct())
    bound = patterns.where(F.size("handles") > 0)
    blocks = max(1, -(-bound.count() // BLOCK))
    columns = [F.col(f"`{c}`") for c in commands.columns]
    said = commands.where(F.col(text).isNotNull())
    # ``explode_outer`` spares the test for an empty array, which would cut each text twice.
    index = cut_lineage(_looked_up(bound, said.select(F.explode_outer(handles(F.col(text))).alias("handle")), blocks))
    least = int(commands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, min(MOST_TASKS, (index.agg(F.sum("n")).first()[0] or 0) // TASK_TRIES))
    asked = said.repartition(tasks, *[F.col(f"`{k}`") for k in keys]).distinct()
    cut = asked.select(*columns, normalized(F.col(text)).alias("_plain"), handles(F.col(text)).alias("_handles"))
    each = cut.select(*columns, "_plain", F.explode_outer("_handles").alias("_handle"))
    hit = F.col("_plain").contains(F.col("_certain")) & (F.col("_sure") | F.rlike(F.col(text), F.col("_regex")))
    met = []
    for block in _blocks(index, blocks):
        tried = block.select(*[F.col(c).alias(f"_{c}") for c in ("handle", "group", "regex", "certain", "sure")])
        met.append(each.join(F.broadcast(tried), "_handle").where(hit).select(*columns, "_group"))
    loose = patterns.where(F.size("handles") == 0).select("group", "regex").limit(MOST_LOOSE + 1).collect()
    if len(loose) > MOST_LOOSE:
        raise ValueError(f"more than {MOST_LOOSE} patterns without a certain piece of {PIECE} letters")
    if loose:
        kind = patterns.schema["group"].dataType
        hits = F.array_compact(F.array(*(F.when(F.col(text).rlike(p["regex"]), F.lit(p["group"]).cast(kind)) for p in loose)))
        met.append(asked.select(*columns, F.explode(hits).alias("_group")))
    # All of a key's rows are in one task already, so this moves nothing.
    once = reduce(DataFrame.union, met).dropDuplicates([*keys, "_group"])
    return once.select(*columns, F.col("_group").alias("group"))
