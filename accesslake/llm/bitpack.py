"""Token ids in files of fixed-width bit fields, with block offsets for random access."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accesslake.llm.common import partitions, written
from accesslake.llm.tokens import encoder
from accesslake.session import shared_dir

MAGIC = b"IDBITS01"
TRAILER = struct.Struct("<QQQIIQ8s")  # ids, documents, blocks, bits an id, ids a block, where the index starts, magic
MANIFEST = "file int, path string, n_docs long, n_ids long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def width_for(vocabulary: int) -> int:
    """The bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """``ids`` as consecutive ``width``-bit fields, lowest bit first, filled up with zeros to eight fields."""
    n = -(-len(ids) // 8)
    fields = np.zeros((n, 8), dtype=np.uint64)
    fields.reshape(-1)[: len(ids)] = ids
    out = np.zeros((n, width), dtype=np.uint8)
    for i in range(8):
        byte, shift = divmod(i * width, 8)
        value = fields[:, i] << np.uint64(shift)
        for t in range((shift + width + 7) // 8):
            out[:, byte + t] |= (value >> np.uint64(8 * t)).astype(np.uint8)
    return out.tobytes()


def unpack_bits(data: bytes, width: int, count: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    out = np.empty((len(raw), 8), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(8):
        byte, shift = divmod(i * width, 8)
        value = np.zeros(len(raw), dtype=np.uint64)
        for t in range((shift + width + 7) // 8):
            value |= raw[:, byte + t].astype(np.uint64) << np.uint64(8 * t)
        out[:, i] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:count]


class Writer:
    """Writes blocks as they fill; the index of blocks and documents follows at ``close``."""

    def __init__(self, path: str, width: int, block_ids: int):
        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        self.file, self.width, self.block_ids = store.open_output_stream(at), width, block_ids
        self.held: list[np.ndarray] = []
        self.waiting, self.ids, self.at = 0, 0, 0
        self.blocks, self.docs, self.starts = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"an id of document {doc_id} needs more than {self.width} bits")
        self.docs.append(doc_id)
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.waiting += len(ids)
        self.held.append(ids)
        if self.waiting >= 64 * self.block_ids:
            self._flush(self.waiting // self.block_ids * self.block_ids)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        for low in range(0, count, self.block_ids):
            data = pack_bits(ids[low : min(count, low + self.block_ids)], self.width)
            self.blocks.append(self.at)
            self.file.write(data)
            self.at += len(data)
        self.held, self.waiting = [ids[count:]], self.waiting - count

    def close(self) -> None:
        self._flush(self.waiting)
        index = self.at
        for array in (np.array([*self.blocks, self.at], "<u8"), np.array([x is not None for x in self.docs], "u1"), np.array([x or 0 for x in self.docs], "<i8"), np.array([*self.starts, self.ids], "<u8")):
            self.file.write(array.tobytes())
        self.file.write(TRAILER.pack(self.ids, len(self.docs), len(self.blocks), self.width, self.block_ids, index, MAGIC))
        self.file.close()


class Reader:
    """Random access to the documents of one file: only the blocks asked for are read and unpacked."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        self.ids, n_docs, n_blocks, self.width, self.block_ids, index, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of bit fields")
        raw, cut = self.file.read_at(size - TRAILER.size - index, index), np.cumsum([0, 8 * (n_blocks + 1), n_docs, 8 * n_docs, 8 * (n_docs + 1)])
        blocks, known, docs, starts = (np.frombuffer(raw[a:b], t) for a, b, t in zip(cut, cut[1:], ("<u8", "u1", "<i8", "<u8")))
        self.blocks, self.starts = blocks.astype(np.int64), starts.astype(np.int64)
        self.docs = [int(d) if k else None for d, k in zip(docs, known)]

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop`` of the file."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids + 1
        low, high = int(self.blocks[first]), int(self.blocks[last])
        count = min(self.ids, last * self.block_ids) - first * self.block_ids
        return unpack_bits(self.file.read_at(high - low, low), self.width, count)[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.file.close()


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, block_ids: int = 8192, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and writes the ids; returns the written manifest, one row per file, with ``first_id`` and ``path``.

    Files follow one another in ascending ``doc_id``: the rows are dealt out by ranges and sorted inside a range, and a
    task streams its range into one file. A retried task writes a file of another name and only the manifest's names
    count, so lost executors leave no half file behind that is read. Folders may be any that pyarrow can reach.

    Null text is empty (only the end id); null ids come first and are kept as null; rows with one ``doc_id`` are ordered
    by their text; an empty table gives no file; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "ids")

    def run(batches):
        tokens, writer, path = encoder(tokenizer), None, f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.idbits"
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids_in = batch.column(0).to_pylist()
            for low in range(0, len(ids_in), 500):
                writer = writer or Writer(path, width_for(max(tokens.size, end_id + 1)), block_ids)
                texts = [x or "" for x in batch.column(1).slice(low, 500).to_pylist()]
                for doc, ids in zip(ids_in[low : low + 500], tokens.encode(texts)):
                    writer.add(doc, np.frombuffer(ids + end, dtype="<u4"))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"file": TaskContext.get().partitionId(), "path": path, "n_docs": len(writer.docs), "n_ids": writer.ids}], schema=pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("_tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(files or partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    manifest = written(ranged.mapInArrow(run, MANIFEST), "id-files")
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, window_ids: int = 1 << 20) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``, from the ids unpacked again, a window at a time."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["path"])
                starts, n = reader.starts, len(reader.docs)
                crcs, k = [0] * n, 0
                for low in range(0, reader.ids, window_ids):
                    ids = reader.span(low, min(reader.ids, low + window_ids)).astype("<u4", copy=False)
                    while k < n:
                        a, b = max(int(starts[k]), low), min(int(starts[k + 1]), low + len(ids))
                        if b > a:
                            crcs[k] = zlib.crc32(ids[a - low : b - low].tobytes(), crcs[k])
                        if int(starts[k + 1]) > low + len(ids):
                            break
                        k += 1
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array(reader.docs, pa.int64()), pa.array(row["first_id"] + starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, partitions(manifest.sparkSession))
    return manifest.select("path", "first_id").repartition(files).mapInArrow(run, DOCS)
