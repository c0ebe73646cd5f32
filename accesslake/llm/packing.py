"""Sum-of-squares online packing of token sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslake.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places pieces into windows of ``capacity`` ids, one at a time.

    ``level[h]`` counts the open windows filled up to ``h``. A piece of ``s`` ids goes from level ``h`` to ``h + s`` so
    that the sum of the squared counts becomes least; ``h = 0`` opens a window, a full window leaves the array. Ties go
    to the fuller window, then to the one opened last.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def place(self, size: int) -> int:
        """The level that a piece of ``size`` ids is put on, 0 for a new window."""
        level, top = self.level, self.capacity - size
        after = level[size : self.capacity + 1]
        cost = 2 * (after - level[: top + 1]) + 2
        cost[0] = 2 * after[0] + 1
        cost[top] -= 2 * after[-1] + 1  # a full window counts no more
        cost[1:][level[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def add(self, piece: tuple, size: int) -> list | None:
        """Puts a piece in; gives the window if that fills it."""
        at = self.place(size) if size < self.capacity else 0
        window = self.open[at].pop() if at else []
        if at:
            self.level[at] -= 1
        window.append(piece)
        if at + size == self.capacity:
            return window
        self.level[at + size] += 1
        self.open[at + size].append(window)
        return None

    def rest(self) -> list[list]:
        """The open windows, cut and joined until at most one is not full."""
        left = [p for h in sorted(self.open, reverse=True) for w in self.open[h] for p in w]
        self.open.clear()
        self.level[:] = 0
        out, window, room = [], [], self.capacity
        for doc, start, ids, total in left:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                window.append((doc, start, part, total))
                start, room = start + len(part), room - len(part)
                if not room:
                    out.append(window)
                    window, room = [], self.capacity
        return out + [window] * bool(window)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    Each input partition is packed by its own level array in one pass, so nothing is shuffled and memory holds the open
    windows only. A document longer than ``capacity`` fills whole windows and what is left over is placed. At the end
    the open windows are cut and joined, so a partition has one sequence at most that is not full. ``sequence_id`` is
    the partition's number times 2**32 plus a count.

    Null text is empty (only the end id); a null ``doc_id`` stays null; repeated rows are packed once each; an empty
    table gives no rows; other columns are not read.
    """

    def run(batches):
        tokens, packer, first = encoder(tokenizer), Packer(capacity), TaskContext.get().partitionId() << 32
        end, count = np.array([end_id], dtype="<u4").tobytes(), 0

        def rows(windows):
            nonlocal count
            columns: list[list] = [[] for _ in range(7)]
            for window in windows:
                at = 0
                for doc, start, ids, total in window:
                    for column, value in zip(columns, (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, first + count, at)):
                        column.append(value)
                    at += len(ids)
                count += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            docs_in = batch.column(0).to_pylist()
            for low in range(0, len(docs_in), 500):
                full, texts = [], [x or "" for x in batch.column(1).slice(low, 500).to_pylist()]
                for doc, ids in zip(docs_in[low : low + 500], tokens.encode(texts)):
                    ids = np.frombuffer(ids + end, dtype="<u4")
                    for start in range(0, len(ids), capacity):
                        part = ids[start : start + capacity]
                        if (window := packer.add((doc, start, part, len(ids)), len(part))) is not None:
                            full.append(window)
                yield rows(full)
        tokens.forget()
        yield rows(packer.rest())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)
