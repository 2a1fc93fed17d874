"""Shared helpers: reliable intermediate tables, word hashing, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evospark.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a run of anything but the six ASCII white-space characters."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: later work restarts from files, not from executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't use."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def shielded(docs: DataFrame, needed: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(docs)`` for work that keeps rows and columns: the columns it doesn't need travel inside one struct,
    so no name of theirs can clash with a helper column."""
    other = [c for c in docs.columns if c not in needed]
    if not other:
        return work(docs).select(*docs.columns)
    inside = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(other))).alias("other columns")
    out = work(docs.select(*(c for c in docs.columns if c in needed), inside))
    places = {c: f"c{i}" for i, c in enumerate(other)}
    return out.select(*(F.col(f"`other columns`.{places[c]}").alias(c) if c in places else c for c in docs.columns))


# --- word hashing -----------------------------------------------------------
# A word's hash is a polynomial over random byte values modulo 2**64, finished
# by a bijective mix. It is the same on every machine.

_RNG = np.random.default_rng(20240607)
_BYTE_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BLOCK = 1 << 19
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _BLOCK + 4096)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
                      for b in (_BASE, _BASE_INVERSE)]
    return _POWERS[0], _POWERS[1]


def _block_hashes(buf: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of one block; ``cuts`` are offsets at which a word ends too."""
    if lower:
        buf = _LOWER[buf]
    gap = _SPACE[buf]
    edge = np.ones(len(buf) + 1, dtype=bool)
    edge[1:-1] = gap[:-1]
    edge[cuts] = True
    start = np.flatnonzero(~gap & edge[:-1])
    edge[:-1] |= gap
    end = np.flatnonzero(edge)
    end = end[np.searchsorted(end, start, side="right")]
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * up[:len(buf)], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    return mix(value + (end - start).astype(np.uint64)), start, end


def word_hashes(data: bytes | np.ndarray, cuts: np.ndarray | None = None, lower: bool = True,
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of UTF-8 ``data``, block by block."""
    buf = np.frombuffer(data, dtype=np.uint8) if isinstance(data, bytes) else data
    cuts = np.zeros(0, dtype=np.int64) if cuts is None else cuts
    parts, at = [], 0
    while at < len(buf):
        to = min(at + _BLOCK, len(buf))
        while to < len(buf) and not _SPACE[buf[to]]:  # a block ends before white space
            ahead = np.flatnonzero(_SPACE[buf[to:to + 4096]])
            to = to + int(ahead[0]) if len(ahead) else min(to + 4096, len(buf))
        inside = cuts[np.searchsorted(cuts, at, "left"):np.searchsorted(cuts, to, "left")] - at
        h, s, e = _block_hashes(buf[at:to], inside, lower)
        parts.append((h, s + at, e + at))
        at = to
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of the whole sequence when it is shorter; none without words."""
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i:i + len(out)]
    return mix(out + np.uint64(size))


class Words(NamedTuple):
    """Words of the texts from row ``at`` on: their hashes, starts and ends in ``data``; offset and first word of each text, then the ends."""

    at: int
    data: np.ndarray
    cuts: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def word_blocks(texts: pa.Array, lower: bool = True) -> Iterator[Words]:
    """The words of an Arrow string array, in groups of texts of about one block together; a null text has none."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BLOCK, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        cuts = offsets[at:to + 1] - lo
        hashes, start, end = word_hashes(raw[lo:hi], np.unique(cuts[:-1]), lower)
        yield Words(at, raw[lo:hi], cuts, hashes, start, end, np.searchsorted(start, cuts, side="left"))
        at = to


def batch_words(texts: pa.Array, lower: bool = True):
    """For each text of an Arrow string array: its word hashes with starts and ends in bytes of that text."""
    for block in word_blocks(texts, lower):
        for cut, a, b in zip(block.cuts, block.first[:-1], block.first[1:], strict=False):
            yield block.hashes[a:b], block.start[a:b] - cut, block.end[a:b] - cut


# --- bit tables -------------------------------------------------------------


class Marks:
    """Bit table of hashes behind a broadcast variable. It only saves work: a value that was not marked may pass."""

    def __init__(self, bits: int, sent: Broadcast):
        self.bits, self.sent = bits, sent

    def __call__(self, values: np.ndarray) -> np.ndarray:
        slot = (values.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.sent.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def marks(values: DataFrame, column: str, bits: int = 26) -> Marks:
    """The hashes of a column as 2**bits bits (8 MB), whatever their number; at most one row per 64 bits reaches the driver."""
    slot = F.shiftrightunsigned(column, 64 - bits)
    word = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - bits}) & 63 as int))")
    rows = values.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(word).alias("word")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[np.asarray(rows.column("at"), dtype=np.int64)] = np.asarray(rows.column("word"), dtype=np.int64).view(np.uint64)
    return Marks(bits, values.sparkSession.sparkContext.broadcast(table))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node: the smallest node it reaches.

    Alternating star contraction: every node hands its neighbours the smallest
    node it knows. Minima are grouped before the join, and the join's large
    keys (hubs) can be split by AQE; every round is written to the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    edges = stored(edges, "links")
    seen = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        spread = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        spread = stored(spread, "spread")
        least = spread.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = spread.join(least, "hi")
        edges = stored(
            joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(least.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = state
