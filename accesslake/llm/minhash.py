"""Near-duplicate classes by circulant MinHash: two permutations, the second shifted round, give every signature coordinate."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslake.llm.common import slices, written
from accesslake.llm.links import components
from accesslake.llm.sets import WordHashes, linked, mixed, shingle_set

SHINGLE, PERCENT = 5, 85
#: Coordinates a band and bands: sets that share 0.85 of their union agree in no band in 1e-10 of cases.
ROWS, BANDS = 3, 24
#: Set members whose coordinates are computed at once.
CHUNK = 4096
_FIRST, _SECOND = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def first_permutation(values: np.ndarray) -> np.ndarray:
    """Where the first permutation puts each 64-bit number, once for all coordinates."""
    return mixed(values * np.uint64(2862933555777941757) + _FIRST)


def second_permutation(places: np.ndarray) -> np.ndarray:
    return mixed(places ^ _SECOND)


def signature(values: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k: the least of the second permutation, shifted round by k, over the places of the first."""
    places, shifts = first_permutation(values), np.arange(coordinates, dtype=np.uint64)[:, None]
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(places), CHUNK):
        least = np.minimum(least, second_permutation(places[None, low : low + CHUNK] - shifts).min(axis=1))
    return least


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates."""
    bands = least.reshape(-1, rows)
    key = np.arange(len(bands), dtype=np.uint64)
    for r in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, r])
    return key


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(texts: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """``doc_id``, the ``digest`` and ``size`` of the set of different shingles and its band ``keys`` (none for an empty set)."""

    def run(batches):
        known = WordHashes()
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, shingle, known)
                keys = band_keys(signature(found, rows * bands), rows).view(np.int64) if len(found) else np.empty(0, np.int64)
                out.append((set_digest(found), len(found), keys))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))], names=["doc_id", "digest", "size", "keys"])

    return texts.mapInArrow(run, "doc_id long, digest binary, size long, keys array<long>")


#: Bits of the map that tells which ids may be wanted: 16 MB, however many ids there are.
BITS = 1 << 27


def maybe_wanted(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``wanted``; none that is wanted is lost.

    The wanted keys' hashes set bits of a map of ``BITS`` bits, 4 KB a row and ``BITS / 32768`` rows, which is broadcast. A set bit
    may stand for another key, so an exact join must follow, by this key or by what is made of the row.
    """

    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(BITS)) + 1

    at = place(F.col(wanted_key))
    bits = wanted.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    here = rows.withColumn("_at", place(F.col(key)))
    met = here.join(F.broadcast(bits), F.bitmap_bucket_number("_at") == F.col("_bucket"))
    position = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def sets_from(texts: DataFrame, classes: DataFrame, shingle: int):
    """For ``sets.linked``: the sets of named classes, from the text of each one's smallest doc_id.

    A class is its digest, so sets move once, by the digest; what else belongs to a class waits there for them. Texts don't move.
    """

    def run(batches):
        known = WordHashes()
        for batch in slices(batches):
            found = [shingle_set(text, shingle, known) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(x) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["digest", "hashes"])

    def sets_of(named: DataFrame) -> DataFrame:
        known = classes.select("node", F.col("id").alias("_id"), F.col("digest").alias("_digest"))
        wanted = written(known.join(named, "node"), "wanted")
        read = maybe_wanted(texts, "doc_id", wanted, "_id")  # what else passes is left out by its digest
        sets = read.mapInArrow(run, "digest binary, hashes array<long>").join(wanted, F.col("digest") == F.col("_digest"))
        return sets.groupBy("digest").agg(*(F.first(c).alias(c) for c in (*named.columns, "hashes"))).drop("digest")

    return sets_of


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the smallest doc_id it reaches over documents alike.

    Documents are linked if their sets of different word shingles have ``percent`` of their union in common; every link
    is confirmed on the full sets. Bands of the signature only choose whom to compare: a pair of likeness s shares none in
    ``(1 - s**rows)**bands`` of cases (1e-10 at 0.85). Documents of one set are one class and compared once; groups of
    candidates are compared inside tasks and only the edges of their forests leave them (see ``sets.linked``).

    Null texts and texts without words have the empty set and are linked with nothing, not even each other; very long texts
    are sets like any other, their signature taken in chunks. A row with a null ``doc_id`` takes its class's component, which
    is null if no row with an id is in it; rows that share an id but not the text are classes of their own; repeated rows
    stay; an empty table gives no rows; other columns are not read.
    """
    texts = _texts(docs, id_col, text_col)
    found = written(sketches(texts, shingle, rows, bands), "sketches")
    classes = found.where("size > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = classes.select("node", "size", "keys", F.array(F.lit(0).cast("bigint")).alias("words"))
    edges = linked(nodes, sets_from(texts, classes, shingle), percent, [4, bands - 4] if bands > 4 else [bands])
    return attached(found, classes, edges).select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def attached(found: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``found`` with ``component_id``: the smallest id of all classes that its class (by ``digest``) reaches; its own where it has none."""
    roots = components(edges).select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    rooted = classes.join(roots, F.col("node") == F.col("_id"), "left").select("digest", "id", "node", F.col("_root").alias("root"))
    rooted = written(rooted, "rooted")
    joined = rooted.withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    named = joined.join(least, "root", "left").select(F.col("digest").alias("_digest"), F.when(F.col("n") > 1, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return found.join(named, F.col("digest") == F.col("_digest"), "left").select(*found.columns, F.when(F.col("_digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
