"""Cost-balanced packing of documents into fixed-length training sequences.

Attention over a document of n tokens costs about ``linear * n + n * n``. Full
lengths of long documents fill sequences of their own. The rests of a block of
documents are assigned in descending order to the sequence with the lowest cost
so far that still has room; a rest that fits nowhere whole is cut over the
sequences with most room. A block of total T opens ceil(T / length) sequences,
so at most one of them, per block, is padded.

Blocks are made of consecutive rows inside a task: nothing is shuffled, memory
is bounded by the block, and a repeated task makes the same blocks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evospark.llm.tokenizing import crc, vocabulary_path, worker_encoder

LENGTH = 1024
LINEAR = 4096
"""Linear cost per token against the quadratic one (about 4 x the model's width)."""

BLOCK_DOCS = 4096
END = 0


def assign(sizes: list[int], length: int, linear: int = LINEAR) -> list[tuple[int, int, int, int]]:
    """(item, start in the item, size, sequence) of rests shorter than ``length``; all tokens are placed once."""
    count = -(-sum(sizes) // length)
    room = [length] * count
    queue = [(0, s) for s in range(count)]  # (cost, sequence); a full sequence leaves
    out = []

    def put(item: int, start: int, size: int, cost: int, s: int) -> None:
        out.append((item, start, size, s))
        room[s] -= size
        if room[s]:
            heapq.heappush(queue, (cost + linear * size + size * size, s))

    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, passed = sizes[item], []
        while queue and room[queue[0][1]] < size:
            passed.append(heapq.heappop(queue))
        if queue:
            cost, s = heapq.heappop(queue)
            put(item, 0, size, cost, s)
            for entry in passed:
                heapq.heappush(queue, entry)
            continue
        passed.sort(key=lambda e: (-room[e[1]], e))
        start = 0
        for cost, s in passed:
            part = min(size - start, room[s])
            if part:
                put(item, start, part, cost, s)
                start += part
            else:
                heapq.heappush(queue, (cost, s))
    return out


class _Block:
    def __init__(self, length: int, first: int):
        self.length, self.next = length, first
        self.docs: list = []

    def pieces(self) -> pa.RecordBatch:
        rows: list[tuple] = []
        rests, owner = [], []
        for doc_id, ids in self.docs:
            total = len(ids)
            for start in range(0, total - total % self.length, self.length):
                rows.append((doc_id, start, self.length, crc(ids[start:start + self.length]), total, self.next, 0))
                self.next += 1
            if total % self.length:
                owner.append((doc_id, ids, total - total % self.length))
                rests.append(total % self.length)
        used: dict[int, int] = {}
        for item, start, size, s in assign(rests, self.length):
            doc_id, ids, base = owner[item]
            at = base + start
            rows.append((doc_id, at, size, crc(ids[at:at + size]), len(ids), self.next + s, used.get(s, 0)))
            used[s] = used.get(s, 0) + size
        self.next += len(used)
        self.docs = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)],
                                          names=PIECE_NAMES)


PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed_pieces(docs: DataFrame, length: int = LENGTH, block_docs: int = BLOCK_DOCS, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` ends with id 0; a null text is that id alone. Rows with
    null or repeated ids are packed like any other. sequence_id carries the task
    in its high bits. A block closes at ``block_docs`` documents or 4 million
    tokens, whichever comes first.
    """
    path = vocabulary or vocabulary_path()

    def pack(batches):
        context = TaskContext.get()
        block = _Block(length, (context.partitionId() if context else 0) << 40)
        encoder, tokens = worker_encoder(path), 0
        end = np.array([END], dtype="<u2")
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), encoder.encode_array(batch.column(1)), strict=True):
                ids = np.concatenate([data, end])
                block.docs.append((key, ids))
                tokens += len(ids)
                if len(block.docs) >= block_docs or tokens >= 4_000_000:
                    yield block.pieces()
                    tokens = 0
        yield block.pieces()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pack, ", ".join(f"{n} long" for n in PIECE_NAMES))
