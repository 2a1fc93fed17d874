"""Classes of near copies among the distinct lines of a corpus, by MinHash banding.

A line is its set of ``n``-word shingles. Bands of ``ROWS`` minima are tuned to
``RECALL`` at the similarity; lines of one bucket are candidates. Buckets of up
to ``CROWDED`` lines give their pairs, larger ones the pairs with their first
line. Parities of the shingles rule out most pairs exactly, the others are
verified on whole sets. Where a larger bucket then still holds lines of several
components, its lines go through the exact join of ``ngram_join``. So a pair of
one bucket is verified, ruled out exactly, or in one component already. Equal lines are one from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evospark.llm.common import Marks, components, marks, mix, stored
from evospark.llm.ngram_join import ngram_components

RECALL = 0.97
ROWS = 3
CROWDED = 16
PARITY_WORDS = 4
BLOCK = 1 << 18
"""Shingles hashed together; a line is never split, so a longer one is a block of its own."""


def tuned_bands(percent: int, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` minima that find a pair at the similarity with at least this probability."""
    return max(1, ceil(log(1 - recall) / log(1 - (percent / 100) ** rows)))


#: Yields (bytes, fingerprints, shingles, first shingle of each line, starts and ends in the bytes) per group of a batch's texts.
Lines = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


def _blocks(batches: Iterator[pa.RecordBatch], lines: Lines, wanted: Marks | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(fp, size, elements): lines new to this task with their sorted distinct shingles, end to end."""
    seen: set[int] = set()
    fps, parts, counts, total = [], [], [], 0

    def block():
        size = np.concatenate(counts)
        owner = np.repeat(np.arange(len(size)), size)
        elements = np.concatenate(parts)
        order = np.lexsort((elements, owner))
        owner, elements = owner[order], elements[order]
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (elements[1:] != elements[:-1])
        return np.concatenate(fps), np.bincount(owner[new], minlength=len(size)), elements[new]

    for batch in batches:
        for _, fp, shingles, first, _, _ in lines(batch):
            size = np.diff(np.append(first, len(shingles)))
            chosen = np.arange(len(fp)) if wanted is None else np.flatnonzero(wanted(fp))
            ids, at = np.unique(fp.view(np.int64)[chosen], return_index=True)
            new = np.array([i not in seen for i in ids.tolist()], dtype=bool)
            if not new.any():
                continue
            ids, chosen = ids[new], chosen[at[new]]
            seen.update(ids.tolist())
            fps.append(ids)
            counts.append(size[chosen])
            total += (more := int(counts[-1].sum()))
            start = np.cumsum(counts[-1]) - counts[-1]
            parts.append(shingles[np.repeat(first[chosen] - start, counts[-1]) + np.arange(more)])
            if total >= BLOCK:
                yield block()
                fps, parts, counts, total = [], [], [], 0
        if len(seen) > 1_000_000:  # the same line may then pass twice; the shuffle drops it
            seen.clear()
    if fps:
        yield block()


def _sketches(rows: DataFrame, lines: Lines, bands: int) -> DataFrame:
    """(fp, size, p0.., s0..) of each distinct line: size of its set, parities, band signatures."""
    names = ["fp", "size", *(f"p{i}" for i in range(PARITY_WORDS)), *(f"s{i}" for i in range(bands))]
    seeds = mix(np.arange(1, 2 * bands * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, bands, ROWS)

    def sign(batches):
        for fp, size, elements in _blocks(batches, lines):
            at = np.cumsum(size) - size
            place = (elements >> np.uint64(56)).astype(np.int64)
            bit = np.uint64(1) << (elements >> np.uint64(56) & np.uint64(63))
            out = [fp, size]
            out += [np.bitwise_xor.reduceat(np.where(place >> 6 == i, bit, np.uint64(0)), at) for i in range(PARITY_WORDS)]
            for band in range(bands):
                sig = np.full(len(fp), band + 1, dtype=np.uint64)
                for flip, odd in zip(seeds[0, band], seeds[1, band] | np.uint64(1), strict=True):
                    sig = mix(sig + np.minimum.reduceat((elements ^ flip) * odd, at))
                out.append(sig)
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in out], names=names)

    signed = rows.mapInArrow(sign, ", ".join(f"{c} long" for c in names))
    return signed.groupBy("fp").agg(*(F.first(c).alias(c) for c in names[1:]))


def _sets(rows: DataFrame, lines: Lines, wanted: DataFrame) -> DataFrame:
    """(fp, elements) of the wanted lines, as sorted 64-bit words."""
    live = marks(wanted, "fp")

    def sets(batches):
        for fp, size, elements in _blocks(batches, lines, live):
            stops = np.append(0, np.cumsum(size)) * 8
            data = elements.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp), pa.array([data[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)], pa.binary())], names=["fp", "elements"])

    found = rows.mapInArrow(sets, "fp long, elements binary").join(wanted, "fp", "left_semi")
    return stored(found.groupBy("fp").agg(F.min("elements").alias("elements")), "sets")


def _line_texts(rows: DataFrame, lines: Lines, wanted: DataFrame) -> DataFrame:
    """(doc_id, text): the wanted lines, their fingerprints as ids."""
    live = marks(wanted, "fp")

    def pick(batches):
        for batch in batches:
            ids, texts = [], []
            for data, fp, _, _, start, end in lines(batch):
                chosen = np.flatnonzero(live(fp)).tolist()
                ids += fp.view(np.int64)[chosen].tolist()
                texts += [data[start[i]:end[i]].tobytes().decode(errors="replace") for i in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["fp", "text"])

    found = rows.mapInArrow(pick, "fp long, text string").join(wanted, "fp", "left_semi")
    return stored(found.groupBy(F.col("fp").alias("doc_id")).agg(F.min("text").alias("text")), "line_texts")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets meet the similarity."""

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * shared >= percent * (len(left) + len(right) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sides = [sets.select(F.col("fp").alias(s), F.col("elements").alias(f"of_{s}")) for s in "ab"]
    return pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "of_a", "of_b").mapInArrow(check, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()


def line_classes(rows: DataFrame, lines: Lines, n: int, percent: int) -> DataFrame:
    """(fp, class) of every distinct line of ``rows`` (doc_id, text): the smallest fingerprint reachable by links."""
    bands = tuned_bands(percent)
    known = stored(_sketches(rows, lines, bands), "sketches")
    keys = known.select("fp", F.explode(F.array(*(f"s{i}" for i in range(bands)))).alias("sig"))
    buckets = keys.groupBy("sig").agg(F.count("*").alias("n"), F.min("fp").alias("lead")).where("n > 1")
    members = stored(keys.join(stored(buckets, "buckets"), "sig"), "members")
    few, many = members.where(F.col("n") <= CROWDED), members.where(F.col("n") > CROWDED)
    pairs = few.select("sig", F.col("fp").alias("a")).join(few.select("sig", F.col("fp").alias("b")), "sig").where("a < b").select("a", "b")
    pairs = pairs.unionByName(many.where("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b"))).distinct()
    of = [known.select(F.col("fp").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("size", *(f"p{i}" for i in range(PARITY_WORDS))))) for s in "ab"]
    # A shingle in one set only flips one parity, so their number bounds the difference from below.
    apart = sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PARITY_WORDS)), F.lit(0))
    near = (100 + percent) * apart <= (100 - percent) * (F.col("size_a") + F.col("size_b"))
    alike = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    pairs = stored(pairs.join(of[1], "b").join(of[0], "a").where(alike & near).select("a", "b"), "candidates")
    links = stored(_verified(pairs, _sets(rows, lines, stored(_ends(pairs), "ends")), percent), "links")
    root = components(links)

    rooted = many.join(root, F.col("fp") == F.col("node"), "left").select("sig", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = rooted.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
    rest = stored(many.join(mixed, "sig", "left_semi").select("fp").distinct(), "rest")
    if not rest.isEmpty():
        exact = ngram_components(_line_texts(rows, lines, rest), n, percent)
        more = exact.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return known.select("fp").join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("class"))
