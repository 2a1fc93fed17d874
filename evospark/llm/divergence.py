"""Divergence of sources from each other and from their language, over terms found by iceberg prefix refinement.

A term is kept in a language when at least ``support`` of its documents hold it.
Prefixes of terms grow level by level: the documents that hold a prefix are
counted, and only terms whose prefix reaches the support go on to the next
level, until complete terms are counted. The live prefixes of a level travel
as a bit table of fixed size; a full table only lets dead terms through to the
complete count, which is exact.

Divergences need no dense (source, term) table: the part of a pair of sources
where one of them lacks the term depends only on the other one's histogram of
shares, and the rest is summed over the terms that both have.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evospark.llm.common import mix, stored
from evospark.llm.terms import batch_runs, codes, distinct

SUPPORT = 3
LEVELS = (4, 8)
"""Bytes of the prefixes that are counted before the complete terms."""

BITS = 26
"""Binary logarithm of the size of the bit table (8 MB), whatever the input."""

SCALE = 1_000_000_000
TOP_TERMS = 200
_CHUNK = 1 << 21
"""Bytes of text whose counts are summed before they leave a task."""

_PAIRS = 1 << 20


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest()))


def _slots(prefixes: np.ndarray, seeds: np.ndarray, bits: int) -> np.ndarray:
    return (mix(prefixes ^ seeds) >> np.uint64(64 - bits)).astype(np.int64)


def _mask(level: int) -> np.uint64:
    return np.uint64((1 << 64) - (1 << (64 - 8 * level)))


class _Live:
    """Bit table of the live prefixes of one level, behind a broadcast variable."""

    def __init__(self, level: int, bits: int, sent: Broadcast):
        self.level, self.bits, self.sent = level, bits, sent

    def __call__(self, packed: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        slot = _slots(packed & _mask(self.level), seeds, self.bits)
        return (self.sent.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def _chunks(batch: pa.RecordBatch, live: _Live | None):
    """(runs, chosen runs, packed prefixes of the chosen, language names, language of each text) per chunk of a batch
    (text, lang, ...)."""
    lang, names = codes(batch.column(1))
    seeds = np.array([_seed(x) for x in names.to_pylist()], dtype=np.uint64)
    for runs in batch_runs(batch.column(0), _CHUNK):
        if not len(runs.start):
            continue
        own = lang[runs.first:runs.first + runs.count]
        packed = runs.packed()
        chosen = np.ones(len(packed), bool) if live is None else live(packed, seeds[own[runs.text]])
        yield runs, chosen, packed[chosen], names, own


def _prefix_counts(texts: DataFrame, level: int, live: _Live | None) -> DataFrame:
    """(lang, prefix, docs): documents per prefix of ``level`` bytes, of the terms that pass ``live``."""

    def count(batches):
        for batch in batches:
            for runs, chosen, packed, names, own in _chunks(batch, live):
                code, prefixes = codes(pa.array(packed & _mask(level)))
                size = max(1, len(prefixes))
                pairs, _ = distinct(runs.text[chosen] * size + code)  # a document counts once
                cells, docs = distinct(own[pairs // size] * size + pairs % size)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(cells // size)).cast(pa.string()),
                     pa.array(np.asarray(prefixes)[cells % size].view(np.int64)), pa.array(docs)],
                    names=["lang", "prefix", "docs"])

    return (texts.select("text", "lang").mapInArrow(count, "lang string, prefix long, docs long")
            .groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")))


def _live_prefixes(texts: DataFrame, level: int, live: _Live | None, support: int, bits: int) -> _Live:
    """The prefixes of ``level`` bytes in at least ``support`` documents, as a bit table (at most 2**bits bits on the driver)."""

    def words(batches):
        table = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for batch in batches:
            lang, names = codes(batch.column(0))
            seeds = np.array([_seed(x) for x in names.to_pylist()], dtype=np.uint64)
            slot = _slots(np.asarray(batch.column(1)).view(np.uint64), seeds[lang], bits)
            np.bitwise_or.at(table, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], names=["at", "word"])

    alive = _prefix_counts(texts, level, live).where(F.col("docs") >= support).select("lang", "prefix")
    rows = alive.mapInArrow(words, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[np.asarray(rows.column("at"), dtype=np.int64)] = np.asarray(rows.column("word"), dtype=np.int64).view(np.uint64)
    return _Live(level, bits, texts.sparkSession.sparkContext.broadcast(table))


def kept_terms(docs: DataFrame, support: int = SUPPORT, levels: tuple[int, ...] = LEVELS, bits: int = BITS) -> DataFrame:
    """(lang, term, lang_n, held): every kept term with its occurrences in the language and, as an array of
    (source, n), in every source that holds it.

    ``docs`` has text, lang and source; null is ''. Every row is a document of
    its own, also rows with equal ids or texts. A term is a run of ASCII letters
    and non-ASCII characters with A-Z lower-cased, of any length.
    """
    texts = _texts(docs)
    live = None
    for level in levels:
        live = _live_prefixes(texts, level, live, support, bits)

    def count(batches):
        for batch in batches:
            source, sources = codes(batch.column(2))
            for runs, chosen, _, names, own in _chunks(batch, live):
                code, terms = codes(runs.strings(chosen))
                size = max(1, len(terms))
                pairs, n = distinct(runs.text[chosen] * size + code)
                text = pairs // size
                group = own[text] * len(sources) + source[runs.first + text]
                cell = group * size + pairs % size
                order = np.argsort(cell, kind="stable")
                cell, first = np.unique(cell[order], return_index=True)
                group, docs_in = cell // size, np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(group // len(sources))).cast(pa.string()), sources.take(pa.array(group % len(sources))).cast(pa.string()),
                     terms.take(pa.array(cell % size)).cast(pa.string()),
                     pa.array(np.add.reduceat(n[order], first) if len(order) else n), pa.array(docs_in)],
                    names=["lang", "source", "term", "n", "docs"])

    counts = texts.mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(  # one entry per source of the language
        F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("held"))
    return stored(kept.where(F.col("docs") >= support).select("lang", "term", "lang_n", "held"), "kept")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(n + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergences(docs: DataFrame, support: int = SUPPORT, top: int = TOP_TERMS, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Shares are p = 1 + floor(10**9 (n + 1) / (N + V)) for the V kept terms of a
    language, N their occurrences in the group; the distance of p from q is
    floor((p - q)**2 / q). Part ``pair`` ranks every other source of the language
    by the distances summed over all kept terms; part ``term`` ranks the terms
    more frequent in the source than in the language, up to ``top``. A language
    without kept terms has pairs of value 0 and no terms. Ties go to the
    smaller item in byte order. No rows for an empty table.
    """
    kept = kept_terms(docs, support, levels)
    each = kept.select("lang", "term", "lang_n", F.explode("held").alias("h")).select("lang", "term", "lang_n", "h.*")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    zero = F.lit(0).cast("long")
    groups = (_texts(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
              .select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "held", "v", "lang_total"))))
    groups = stored(groups.select("*", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long").alias("sid"),
                                  F.when(F.col("v") > 0, _share(zero, F.greatest(F.col("total") + F.col("v"), F.lit(1)))).alias("p0")), "groups")
    own = groups.select("lang", "source", "sid", "p0", (F.col("total") + F.col("v")).alias("of"), (F.col("lang_total") + F.col("v")).alias("lang_of"))
    shares = each.join(own, ["lang", "source"]).select(
        "lang", "source", "sid", "term", "p0", _share(F.col("n"), F.col("of")).alias("p"), _share(F.col("lang_n"), F.col("lang_of")).alias("q"))
    shares = stored(shares, "shares")
    return _terms(shares, top).unionByName(_pairs(shares, groups))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    ranked = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    a = groups.select("lang", F.col("sid").alias("a"), "source", F.col("p0").alias("a0"), F.col("held").alias("a_held"), "v")
    b = groups.select("lang", F.col("sid").alias("b"), F.col("source").alias("item"), F.col("p0").alias("b0"), F.col("held").alias("b_held"))
    # Terms that only one side holds: one row per source and distinct share, not per term.
    held = stored(shares.groupBy("lang", "sid", "p").agg(F.count("*").alias("m")), "histogram")
    one_sided = held.join(b, "lang").where("sid <> b").groupBy("lang", F.col("sid").alias("a"), "b").agg(
        F.sum(F.col("m") * _distance(F.col("p"), F.col("b0"))).alias("value"))
    other_sided = held.join(a, "lang").where("sid <> a").groupBy("lang", "a", F.col("sid").alias("b")).agg(
        F.sum(F.col("m") * _distance(F.col("a0"), F.col("p"))).alias("value"))
    together = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "p0")).alias("held")).where(F.size("held") > 1)
    both = together.select("lang", "held").mapInArrow(_common, "lang string, a long, b long, value long")
    values = one_sided.unionByName(other_sided).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    neither = (F.col("v") - F.col("a_held") - F.col("b_held")) * _distance(F.col("a0"), F.col("b0"))
    pairs = a.join(b, "lang").where("a <> b").join(values, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        (F.coalesce(neither, F.lit(0).cast("long")) + F.coalesce("value", F.lit(0).cast("long"))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(order))


def _common(batches):
    """For every ordered pair of sources that hold a term: its distance less what the one-sided sums have for it,
    summed per batch."""

    def distance(p, q):
        return (p - q) * (p - q) // q

    for batch in batches:
        lang, names = codes(batch.column(0))
        lists = batch.column(1)
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        flat = lists.flatten()
        sid, p, p0 = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
        begin = np.cumsum(sizes) - sizes
        sources, sid = np.unique(sid, return_inverse=True)
        found: dict[int, int] = {}
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            step = max(1, _PAIRS // int(size * size))
            for part in (rows[i:i + step] for i in range(0, len(rows), step)):
                at = begin[part][:, None] + np.arange(size)
                x, y, x0, y0 = p[at][:, :, None], p[at][:, None, :], p0[at][:, :, None], p0[at][:, None, :]
                value = distance(x, y) - distance(x, y0) - distance(x0, y) + distance(x0, y0)
                cell = (lang[part][:, None, None] * len(sources) + sid[at][:, :, None]) * len(sources) + sid[at][:, None, :]
                cells, inverse = np.unique(cell.ravel(), return_inverse=True)
                sums = np.zeros(len(cells), dtype=np.int64)
                np.add.at(sums, inverse, value.ravel())
                for c, v in zip(cells.tolist(), sums.tolist(), strict=True):
                    found[c] = found.get(c, 0) + v
        cell = np.fromiter(found, np.int64, len(found))
        value = np.fromiter(found.values(), np.int64, len(found))
        a, b = cell // len(sources) % max(1, len(sources)), cell % max(1, len(sources))
        cell, value, a, b = (x[a != b] for x in (cell, value, a, b))
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(cell // max(1, len(sources)) ** 2)).cast(pa.string()), pa.array(sources[a]), pa.array(sources[b]), pa.array(value)],
            names=["lang", "a", "b", "value"])
