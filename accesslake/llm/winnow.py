"""Winnowing fingerprints of texts, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslake.llm.common import bucket_of, partitions

#: Words a gram and grams a window: two texts that share a run of GRAM + WINDOW - 1 words share a mark.
GRAM, WINDOW = 5, 4
#: A word is at most so many characters; longer runs without white space are cut, so texts without any have marks too.
WORD = 16
_PLACE = 24


def word_hashes(text: str) -> Column:
    """A hash of each word of the text column: white space separates, longer words are cut every ``WORD`` characters."""
    words = F.regexp_extract_all(text, F.lit(rf"\S{{1,{WORD}}}"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_marks(hashes: str, gram: int = GRAM) -> Column:
    """Of an array column of word hashes: for each run of ``gram`` words its hash, and below it the place counted down.

    The lowest value of a window is thus the lowest hash and, among equals, the rightmost. Fewer words are one gram.
    """
    size = F.size(hashes)
    places = F.sequence(F.lit(0), F.greatest(size - gram, F.lit(0)))
    last = (1 << _PLACE) - 1
    value = lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(gram)))
    return F.when(size > 0, F.transform(places, lambda i: F.shiftleft(F.shiftrightunsigned(value(i), _PLACE + 1), _PLACE) + (F.lit(last) - i.bitwiseAND(F.lit(last))))).otherwise(F.array().cast("array<bigint>"))


def window_marks(grams: str, window: int = WINDOW) -> Column:
    """The lowest gram of each window of ``window`` grams, each once, by place: the winnowed marks."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(grams) - window, F.lit(0)))
    return F.when(F.size(grams) > 0, F.array_distinct(F.transform(starts, lambda i: F.least(*(F.get(grams, i + j) for j in range(window)))))).otherwise(F.array().cast("array<bigint>"))


def with_marks(df: DataFrame, columns: dict[str, str], gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``df`` with the marks of each text column: ``columns`` maps the new names to the texts'. Null texts have none."""
    keep = [F.col(c) for c in df.columns]
    df = df.select(*keep, *(F.coalesce(word_hashes(t), F.array().cast("array<bigint>")).alias(n) for n, t in columns.items()))
    df = df.select(*keep, *(gram_marks(n, gram).alias(n) for n in columns))
    return df.select(*keep, *(window_marks(n, window).alias(n) for n in columns))


def positions(marks: Column) -> Column:
    """``(hash, place)`` of each mark, place the number of the gram's first word."""
    last = (1 << _PLACE) - 1
    return F.transform(marks, lambda v: F.struct(F.shiftright(v, _PLACE).alias("hash"), (F.lit(last) - v.bitwiseAND(F.lit(last))).alias("place")))


def hashes_of(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda v: F.shiftright(v, _PLACE)))


def fingerprint(marks: str) -> Column:
    """The marks, places included, as one string of 32 hexadecimal digits."""
    part = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return F.concat(part(F.xxhash64(marks)), part(F.xxhash64(F.lit(1), F.col(marks))))


def likeness(a: str, b: str) -> Column:
    """The shared part of two sets of hashes in their union; 1 if both are empty."""
    shared, size = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(shared / (size - shared))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and the likeness to that and to the next document.

    The edited text has its last ``floor(n/2)`` characters replaced by as many first ones (or all) of the next document
    in ascending id; after the last comes the first. Documents are dealt out by quantile ranges of the id; a window
    inside each range finds the next row, and the last row of a range takes the first text of the next range by a join.

    Null text is empty; null ids come first; rows with one id follow one another by a hash of the text; repeated rows
    stay and are each other's next; an empty text has no marks, is like another empty one (1) and unlike any other (0);
    an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("bucket", bucket_of(rows, F.col("doc_id"), 2 * partitions(spark)))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    every = Window.partitionBy(F.lit(0)).orderBy("bucket")  # one row a range
    around = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("bucket", F.coalesce(F.lead("first").over(every), F.first("first").over(around)).alias("next"))
    wanted = firsts.select(F.col("bucket").alias("_after"), F.col("next.doc_id").alias("_id"), F.col("next.tie").alias("_tie"))
    starts = rows.select("doc_id", "tie", "text").join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    starts = starts.groupBy("_after").agg(F.first("text").alias("_text"))
    starts = with_marks(starts, {"_marks": "_text"}).select("_after", "_text", hashes_of(F.col("_marks")).alias("_set"))

    inside = Window.partitionBy("bucket").orderBy("doc_id", "tie")
    ordered = rows.select("*", F.lead("text").over(inside).alias("next_text"), F.lead(F.lit(1)).over(inside).isNull().alias("last"))
    joined = ordered.join(starts, (F.col("bucket") == F.col("_after")) & F.col("last"), "left")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", "_text"), half))
    joined = joined.select("bucket", "doc_id", "tie", "last", "_set", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    marked = with_marks(joined, {"marks": "text", "edited_marks": "edited"})
    marked = marked.select("bucket", "doc_id", "tie", "last", "_set", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint("marks").alias("fingerprint"), fingerprint("edited_marks").alias("edited_fingerprint"), hashes_of(F.col("marks")).alias("set"), hashes_of(F.col("edited_marks")).alias("edited_set"))
    near = marked.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("set", "edited_set").alias("near_edited"), "set", F.when(F.col("last"), F.col("_set")).otherwise(F.lead("set").over(inside)).alias("next_set"))
    return near.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness("set", "next_set").alias("near_next"))
