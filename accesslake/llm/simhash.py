"""SimHash fingerprints of word shingles and the near-duplicate classes they make."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.llm.common import slices, written
from accesslake.llm.links import agreeing_blocks, components, links
from accesslake.llm.minhash import set_digest, sets_from
from accesslake.llm.sets import WordHashes, linked, shingle_set

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def shingle_hashes(text: str, shingle: int):
    """XXH64 (seed 42) of each run of ``shingle`` words, in chunks; of all words if they are fewer; nothing without words.

    A-Z are lower-cased, words are what white space U+0020 and U+0009 to U+000D leaves, and one space joins them.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - size]])
    ends = ends[size - 1 :] - 1
    for low in range(0, len(starts), CHUNK):
        pairs = zip(starts[low : low + CHUNK].tolist(), ends[low : low + CHUNK].tolist())
        yield np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in pairs]), dtype=">u8").astype(np.uint64)


def spread(h: np.ndarray, k: int) -> np.ndarray:
    """A further hash of ``h``: an odd multiple, mixed twice; ``k = 0`` is ``h`` itself."""
    if not k:
        return h
    x = h + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(text: str, shingle: int, words: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint, a bit set if it is set in over half the hashes, and ``least`` independent smallest hashes."""
    return majority_of(shingle_hashes(text, shingle), words, least)


def majority_of(hashes, words: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``majority`` of hashes that come in chunks of ``CHUNK`` at most."""
    count, n = np.zeros(64 * words, dtype=np.int64), 0
    low = np.full(least, np.iinfo(np.uint64).max, dtype=np.uint64)
    for h in hashes:
        n += len(h)
        for w in range(words):
            bits = np.unpackbits(spread(h, w).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            full = len(bits) // 128 * 128
            count[64 * w : 64 * w + 64] += bits[:full].reshape(-1, 128, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            count[64 * w : 64 * w + 64] += bits[full:].sum(axis=0, dtype=np.uint8)
        for k in range(least):
            low[k] = min(low[k], spread(h, words + 1 + k).min())
    return np.packbits(2 * count > n, bitorder="little").view("<u8"), low


def fingerprints(docs: DataFrame, shingle: int = 5, words: int = 1, least: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``words`` (the fingerprint as signed 64-bit words) and ``least`` (smallest hashes) of every whole text."""

    def run(batches):
        for batch in batches:
            fps, lows = [], []
            for text in batch.column(1).to_pylist():
                fp, low = majority(text or "", shingle, words, least)
                fps.append(fp.view(np.int64).tolist())
                lows.append(low.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64())), pa.array(lows, pa.list_(pa.int64()))], names=["doc_id", "words", "least"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, words array<long>, least array<long>")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, words: int = 1, least: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, words`` and ``component_id``, the smallest doc_id it reaches over links.

    Fingerprints link if they differ in ``radius`` bits at most. With ``least = 0`` they are compared where two of
    ``radius + 2`` blocks of bits agree, which loses no link. With ``least > 0``, for radii too wide for blocks, they
    are compared where two of ``least`` smallest shingle hashes agree: documents of similarity ``s`` meet in all but
    ``(1-s)**least + least*s*(1-s)**(least-1)`` of cases (0.002 for 6 and 0.8).
    Equal fingerprints are compared once, as the class of their smallest doc_id, so copies make no pairs.

    Null and empty texts have no shingle and the fingerprint zero, and link as any other; very long texts are hashed in
    chunks; rows with a null ``doc_id`` get a fingerprint and a null ``component_id`` and link nothing; repeated rows
    stay; an empty table gives no rows; other columns are not read.
    """
    fps = written(fingerprints(docs, shingle, words, least, id_col, text_col), "simhash")
    classes = fps.where("doc_id is not null").groupBy("words", "least").agg(F.min("doc_id").alias("id"))
    if least:
        keys = [F.xxhash64(F.lit(k), F.col("least")[i], F.col("least")[j]) for k, (i, j) in enumerate((i, j) for i in range(least) for j in range(i))]
    else:
        keys = agreeing_blocks([F.col("words")[i] for i in range(words)], radius)
    classes = written(classes, "classes")
    roots = components(links(classes, keys, radius))
    rooted = classes.join(roots, "id", "left").select(F.col("words").alias("_words"), F.col("least").alias("_least"), F.coalesce("root", "id").alias("component_id"))
    same = (F.col("words") == F.col("_words")) & (F.col("least") == F.col("_least"))
    attached = fps.join(rooted, same, "left")
    return attached.select("doc_id", "words", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def sketches(rows: DataFrame, shingle: int, words: int, bands: int) -> DataFrame:
    """``doc_id, text_key``, a ``digest`` of the set of different shingles, its ``size``, the fingerprint of the set and ``bands`` keys of two smallest hashes each."""

    def run(batches):
        known = WordHashes()
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, shingle, known)
                fp, low = majority_of((found[i : i + CHUNK] for i in range(0, len(found), CHUNK)), words, 2 * bands)
                out.append((set_digest(found), len(found), fp.view(np.int64).tolist(), low.view(np.int64).tolist()))
            columns = list(zip(*out)) or [[]] * 4
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), longs, longs)))], names=["doc_id", "text_key", "digest", "size", "words", "least"])

    found = rows.mapInArrow(run, "doc_id long, text_key string, digest binary, size long, words array<long>, least array<long>")
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("least")[2 * k], F.col("least")[2 * k + 1]) for k in range(bands)))
    return found.select("doc_id", "text_key", "digest", "size", "words", keys.alias("keys"))


def similar(docs: DataFrame, percent: int = 80, radius: int = 80, shingle: int = 5, words: int = 4, bands: int = 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, component_id, component`` of every row: rows of one component reach each other over documents alike.

    ``component_id`` is the smallest doc_id of the component, ``component`` names it also where no row has an id.
    Documents are linked if their sets of different shingles have ``percent`` of their union in common, and every link is
    verified on the sets themselves. Fingerprints of the sets, compared tile by tile, and ``bands`` keys of two smallest hashes
    only choose whom to verify: a pair of likeness ``s`` shares no key in ``(1 - s*s)**bands`` of cases (6e-7 for 14 and
    0.8), and ``radius`` lies seven standard deviations above the bits that such sets differ in (five for the smallest, of
    four and five shingles). Comparison and verification both happen inside a group's task (see ``sets.linked``), which
    gives confirmed edges of a forest and no pairs. Documents of one set are one node.

    Texts without a shingle are one component; a row with a null ``doc_id`` is a document like any other, with a null ``component_id``; rows that share
    an id but not the text are apart; repeated rows stay; very long texts are sets like any other; an empty table gives
    no rows; other columns are not read.
    """
    rows = _rows(docs, id_col, text_col)
    found = written(sketches(rows, shingle, words, bands), "sketches")
    classes = found.groupBy("digest").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("size", "words", "keys")))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = classes.where("size > 0").select("node", "size", "keys", "words")
    edges = linked(nodes, sets_from(rows.select("doc_id", "text"), classes, shingle), percent, [2, bands - 2], radius)
    roots = components(edges).select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    rooted = written(classes.join(roots, F.col("node") == F.col("_id"), "left").select(F.col("digest").alias("_digest"), "id", F.coalesce("_root", "node").alias("component")), "rooted")
    least = rooted.groupBy(F.col("component").alias("_component")).agg(F.min("id").alias("_least"))
    named = rooted.join(least, F.col("component") == F.col("_component"))
    attached = found.join(named, F.col("digest") == F.col("_digest"))
    return attached.select("doc_id", "text_key", F.when(F.col("doc_id").isNotNull(), F.col("_least")).alias("component_id"), "component")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that are not the smallest of their class; rows with a null id stay."""
    gone = classes.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of ``similar``: that of the smallest id (null last), then text.

    Rows are told apart by id and text, so rows that share an id are judged each for itself; of rows that agree in both one
    stays, whichever. Columns may have any names; empty tables give empty ones.
    """
    texts = written(classes.groupBy("doc_id", "text_key", "component").agg(F.count("*").alias("n")), "texts")
    first = texts.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lacking"), "doc_id", "text_key")).alias("first"))
    judged = texts.select("doc_id", "text_key", "n", F.col("component").alias("of")).join(first, F.col("of") == F.col("component"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    judged = written(judged.select("doc_id", "text_key", stays.alias("stays"), "n"), "judged")
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("at"), text_key(F.col(f"`{text_col}`").cast("string")).alias("text_at"))
    same = F.col("at").eqNullSafe(F.col("doc_id")) & (F.col("text_at") == F.col("text_key"))
    kept = whole.join(judged.where("not stays or n > 1"), same, "left_anti")
    repeated = whole.join(judged.where("stays and n > 1"), same, "left_semi").groupBy("at", "text_at").agg(F.first("row").alias("row"))
    return kept.select("row.*").union(repeated.select("row.*"))
