"""Repeated passages by paragraph.

Lines and, inside them, chunks are compared. Distinct lines are banded, verified
and joined into components by ``line_classes``. A line of a component that
spans documents is a repeat. Other lines are
cut at content-defined places (a word pair whose hash is the least among its
neighbours), so that an exact passage is found wherever it stands inside them.
Of all repeats of a component but the first are removed, where repeats stand in
a row of at least ``RUN_WORDS`` words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evospark.llm.common import Marks, Words, marks, mix, stored, word_blocks
from evospark.llm.line_classes import line_classes

NGRAM = 5
PERCENT = 75
NEIGHBOURS = 5
RUN_WORDS = 25


LINES, CHUNKS = 0, 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MOST = np.uint64(2**64 - 1)


class Paragraphs(NamedTuple):
    """Paragraphs of texts: first shingle in ``shingles``, fingerprint, words, row of the text, bytes, place and length in the text's order."""

    shingles: np.ndarray
    first: np.ndarray
    fp: np.ndarray
    words: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    place: np.ndarray | None
    span: np.ndarray | None


def found_in(block: Words, n: int, part: int, placed: bool = True) -> Paragraphs | None:
    """Lines or chunks of ``n`` words or more of a group of texts; None where there are none.

    The texts are handled together, but nothing crosses from one to the next.
    Places number the chunks, and the lines without any, in each text's order; a
    line has the place of its first chunk and spans all of them. Lines that need
    no place are found without their chunks.
    """
    if len(block.hashes) < n:
        return None
    breaks = np.zeros(len(block.hashes) + 1, dtype=bool)
    breaks[block.first] = True
    breaks = breaks[:-1]
    line = np.searchsorted(np.flatnonzero(block.data == 10), block.start)
    breaks[1:] |= line[1:] != line[:-1]
    line_first, line_words = _long(breaks, n)
    if part == LINES and not placed:
        return _units(block, line_first, line_words, n)
    first, words = _long(_opens(block) | breaks, n)
    lo, hi = np.searchsorted(first, line_first), np.searchsorted(first, line_first + line_words)
    bare = lo == hi
    skipped = np.append(0, np.cumsum(bare))
    # Chunks and bare lines of the texts before.
    passed = np.searchsorted(first, block.first) + skipped[np.searchsorted(line_first, block.first)]
    if part == LINES:
        return _units(block, line_first, line_words, n, passed, lo + skipped[:-1], np.maximum(hi - lo, 1))
    place = np.arange(len(first)) + skipped[np.searchsorted(line_first, first, side="right")]
    return _units(block, first, words, n, passed, place, np.ones(len(first), np.int64))


def _opens(block: Words) -> np.ndarray:
    """Whether a chunk may begin at a word: its pair's hash is the least among its neighbours in the text."""
    pair = np.full(len(block.hashes), _MOST)
    pair[:-1] = mix(block.hashes[:-1] * _STEP + block.hashes[1:])
    pair[block.first[1:][block.first[1:] > 0] - 1] = _MOST  # the last word of a text begins no pair
    texts = len(block.first) - 1
    slot = np.arange(len(pair)) + NEIGHBOURS * np.repeat(np.arange(1, texts + 1), np.diff(block.first))
    padded = np.full(len(pair) + NEIGHBOURS * (texts + 1), _MOST)
    padded[slot] = pair
    least = padded[:len(padded) - NEIGHBOURS + 1].copy()
    for i in range(1, NEIGHBOURS):
        np.minimum(least, padded[i:i + len(least)], out=least)
    return (pair < least[slot - NEIGHBOURS]) & (pair <= least[slot + 1])


def _long(opens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the parts with ``n`` words or more."""
    first = np.flatnonzero(opens)
    words = np.diff(np.append(first, len(opens)))
    return first[words >= n], words[words >= n]


def _units(block: Words, first: np.ndarray, words: np.ndarray, n: int, passed: np.ndarray | None = None,
           place: np.ndarray | None = None, span: np.ndarray | None = None) -> Paragraphs | None:
    if not len(first):
        return None
    run = np.zeros(len(block.hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        run *= _STEP
        run += block.hashes[i:i + len(run)]
    run = mix(run + np.uint64(n))
    counts = words - n + 1
    at = np.cumsum(counts) - counts
    shingles = run[np.repeat(first - at, counts) + np.arange(counts.sum())]
    fp = mix(np.add.reduceat(mix(shingles + np.uint64(0x51ED270B)), at) + words.astype(np.uint64))
    row = np.searchsorted(block.first, first, side="right") - 1
    cut = block.cuts[row]
    if place is not None:
        place = place - passed[row]
    return Paragraphs(shingles, at, fp, words, row + block.at, block.start[first] - cut, block.end[first + words - 1] - cut, place, span)


def split(text: str | None, n: int = NGRAM) -> tuple[Paragraphs | None, Paragraphs | None]:
    """Lines and chunks of ``n`` words or more of a whole text; None where there are none."""
    block = next(word_blocks(pa.array([text], pa.large_string())))
    return found_in(block, n, LINES), found_in(block, n, CHUNKS)


def whole_lines(text: str | None, n: int = NGRAM) -> Paragraphs | None:
    """The lines of a text."""
    return split(text, n)[0]


def paragraphs(text: str | None, n: int = NGRAM) -> Paragraphs | None:
    """The content-defined chunks of a text."""
    return split(text, n)[1]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _long_batches(rows: Iterator[list[np.ndarray]], names: list[str], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    held, count = [], 0
    for row in rows:
        held.append(row)
        count += len(row[0])
        if count >= size:
            yield _batch(held, names)
            held, count = [], 0
    if held:
        yield _batch(held, names)


def _batch(held: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64, copy=False)) for c in zip(*held, strict=True)], names=names)


def _linked(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(fp, class) of the distinct lines."""

    def lines(batch):
        for block in word_blocks(batch.column(1)):
            found = found_in(block, n, LINES, placed=False)
            if found is not None:
                cut = block.cuts[found.row - block.at]
                yield block.data, found.fp, found.shingles, found.first, found.start + cut, found.end + cut

    return stored(line_classes(docs, lines, n, percent), "linked")


UNIT = ["fp", "doc_id", "place", "span", "words", "start", "stop"]


def _unit_batches(batches: Iterator[pa.RecordBatch], n: int, part: int, wanted: Marks | None = None, names: list[str] = UNIT) -> Iterator[pa.RecordBatch]:
    """The columns ``names`` of all lines or all chunks of (doc_id, text) batches, or of those that pass ``wanted``."""

    def rows():
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for block in word_blocks(batch.column(1)):
                found = found_in(block, n, part)
                if found is None:
                    continue
                chosen = slice(None) if wanted is None else wanted(found.fp)
                columns = found.fp.view(np.int64), ids[found.row], found.place, found.span, found.words, found.start, found.end
                yield [c[chosen] for c in columns[:len(names)]]

    return _long_batches(rows(), names)


def _all(docs: DataFrame, n: int, part: int, wanted: Marks | None = None, names: list[str] = UNIT) -> DataFrame:
    """``names`` (the first of ``UNIT``) of all lines or all chunks, or of those that pass ``wanted``."""
    return docs.mapInArrow(lambda batches: _unit_batches(batches, n, part, wanted, names), ", ".join(f"{c} long" for c in names))


def _repeated(docs: DataFrame, n: int) -> DataFrame:
    """``UNIT`` rows of the chunks that stand in several documents, counted before their places are moved."""
    counted = _all(docs, n, CHUNKS, names=UNIT[:2]).groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    spread = stored(counted.where("lo < hi").select("fp"), "spread_chunks")
    return _all(docs, n, CHUNKS, marks(spread, "fp")).join(spread, "fp", "left_semi")


def _first_kept(units: DataFrame, *order: str) -> DataFrame:
    """The units whose ``class`` spans documents; ``removed`` is false for the first of each class only."""
    first = F.struct(*order, "doc_id", "place")
    spread = units.groupBy("class").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(first).alias("head")).where("lo < hi")
    return units.join(spread, "class").select(
        *units.columns, ((F.col("doc_id") != F.col("head.doc_id")) | (F.col("place") != F.col("head.place"))).alias("removed"))


def repeated_passages(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, run_words: int = RUN_WORDS) -> DataFrame:
    """One row per passage that other documents hold too: doc_id, start, stop (bytes of the UTF-8
    text), n_words, n_paragraphs, n_removed, component_id.

    A paragraph is a line in a component that spans documents, or else a chunk
    that stands in other documents too. A passage is a row of neighbouring ones
    with ``run_words`` words or more. n_removed counts those that are not the
    first of their component (smallest doc_id, then place; for chunks, those
    outside removed lines go first); component_id is that of the passage's first
    paragraph. Rows without id or words take no part; a repeated doc_id counts as
    one document, so its repeats alone make no passage.
    """
    rows = _rows(docs)
    linked = _linked(rows, n, percent)
    lines = stored(_first_kept(stored(_all(rows, n, LINES).distinct().join(linked, "fp"), "classed")), "lines")
    chunks = stored(_repeated(rows, n).distinct().withColumn("class", F.col("fp")), "repeated")
    covered = lines.select("doc_id", F.explode(F.sequence("place", F.col("place") + F.col("span") - 1)).alias("place"), "removed")
    # Repeated rows of one doc_id with different texts may share places.
    covered = covered.groupBy("doc_id", "place").agg(F.max("removed").alias("in_removed"))
    chunks = stored(chunks.join(covered, ["doc_id", "place"], "left").select(
        *UNIT, "class", F.col("in_removed").isNotNull().alias("in_line"), F.coalesce("in_removed", F.lit(False)).alias("in_removed")), "chunks")
    kept = _first_kept(chunks, "in_removed").where("not in_line").select(*lines.columns)
    of_doc = Window.partitionBy("doc_id").orderBy("place", "start", "stop", "fp")
    reached = F.max(F.col("place") + F.col("span")).over(of_doc.rowsBetween(Window.unboundedPreceding, -1))
    opened = stored(lines.unionByName(kept), "kept").withColumn("opens", (F.col("place") > F.coalesce(reached, F.lit(-1))).cast("long"))
    island = opened.withColumn("island", F.sum("opens").over(of_doc))
    return island.groupBy("doc_id", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"), F.count("*").alias("n_paragraphs"),
        F.count_if("removed").alias("n_removed"), F.min_by("class", F.struct("place", "start")).alias("component_id"),
    ).where(F.col("n_words") >= run_words).drop("island")
