"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a hash ring; a key belongs to the arc that ends
at the next point clockwise. A shard holds at most its capacity: keys beyond it
continue clockwise to the next point whose shard has room, so balance is
guaranteed and a change of the shard count moves few keys. With a slack of 1
capacities differ by at most one and add up to all rows: counts are exact.

Only the arcs' row counts (points per shard x shards, both parameters) reach the
driver, which turns them into ranges of ranks; rows are ranked inside their arc.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evospark.llm.common import mix, stored

SHARDS = 8
POINTS = 128


def ring(shards: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of the virtual nodes and their shards. A shard's points don't depend on the others."""
    owner = np.repeat(np.arange(shards), points)
    at = mix(mix(owner.astype(np.uint64) + np.uint64(1)) + np.tile(np.arange(points, dtype=np.uint64), shards))
    order = np.argsort(at, kind="stable")
    return at[order], owner[order]


def capacities(rows: int, shards: int, slack: float = 1.0) -> list[int]:
    if slack == 1.0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [ceil(slack * rows / shards)] * shards


def allotted(counts: dict[int, int], owner: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): each arc's own shard first, in ring order,
    then what overflows moves clockwise to shards with room."""
    room, used = list(room), [0] * len(room)
    out, over = [], []

    def take(arc: int, rank: int, n: int, shard: int) -> None:
        out.append((arc, rank, rank + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    for arc in range(len(owner)):
        n = counts.get(arc, 0)
        own = min(n, room[owner[arc]])
        if own:
            take(arc, 0, own, int(owner[arc]))
        if n > own:
            over.append((arc, own, n))
    for arc, rank, n in over:
        step = arc
        while rank < n:
            step = (step + 1) % len(owner)
            part = min(n - rank, room[owner[step]])
            if part:
                take(arc, rank, part, int(owner[step]))
                rank += part
    return out


def placed(docs: DataFrame, points: int, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, key, arc) of every row."""
    at, _ = ring(shards, points)

    def place(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
            crc = np.array([zlib.crc32(t) for t in texts], dtype=np.int64)
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            key = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64)
            # Rows without id are spread by their text.
            key = mix(np.where(known, mix(key), mix(crc.view(np.uint64) ^ (size.view(np.uint64) << np.uint64(32)))))
            arc = np.searchsorted(at, key) % len(at)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size), pa.array(crc), pa.array(key.view(np.int64)), pa.array(arc.astype(np.int32))],
                names=["doc_id", "size", "text_crc32", "key", "arc"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, key long, arc int")


def ring_shards(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, slack: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    size is the text's UTF-8 bytes plus one; a null text counts as empty. Law
    ``rows``: shard counts differ by at most one (with the default slack). Slots
    count a shard's rows from 0. Repeated rows take one slot each; rows without
    id are placed by their text. grown_shard is null under this law.
    """
    found = stored(placed(docs, points, shards), "placed")
    counts = {r["arc"]: r["n"] for r in found.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # points x shards rows
    _, owner = ring(shards, points)
    plan = allotted(counts, owner, capacities(sum(counts.values()), shards, slack))
    spark = docs.sparkSession
    # At most one range per arc and one more per shard and arc that overflows.
    ranges = stored(spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "arc int, lo long, hi long, shard int, slot0 long").coalesce(1), "ranges")
    rank = F.row_number().over(Window.partitionBy("arc").orderBy("key", "doc_id", "text_crc32", "size")) - 1
    ranked = found.withColumn("rank", rank)
    joined = ranked.join(ranges, (ranked["arc"] == ranges["arc"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return joined.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
