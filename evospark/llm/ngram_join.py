"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two sets
of sizes r >= s that meet the similarity t differ in at most
``H = floor((r + s) * (1 - t) / (1 + t))`` elements. The hash universe of each
size band is cut into segments; among any H + 1 disjoint segments at least one
is then equal on both sides.

* Allocation: a set signs its first ``H + 1`` non-empty segments and a few spare
  ones. Empty segments are free to skip, because an equal segment is empty on
  both sides.
* A set with too few non-empty segments signs all of them together with their
  one-deletion neighbourhoods, where a segment of two or more elements counts
  twice; where even that falls short (tiny sets only) it signs its subsets with
  up to H deletions.
* Cost: a signature's cost is its measured frequency. A set whose frequent
  signatures fit into its spare ones leaves them all out.
* The other sets are allocated anew with one segment per element. What a pair
  can share is then bounded by its shared rare elements plus the smaller number
  of frequent ones, so only sets that consist of frequent elements for the most
  part meet through those, and only by their rarest ones (prefix filter with
  positions). Parity bits of the sets, which differ in no more places than the
  sets differ in elements, rule out most of what is left.
* A linked pair whose sets have spare signatures shares more than one of them,
  so the number of shared signatures rules out most chance pairs.
* Candidates are first compared along a few pairs per set (the partner with most
  shared signatures, the first member of a frequent group); after that only
  pairs in different components are. All comparisons are exact on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evospark.llm.common import batch_words, components, mix, ngram_hashes, stored

NGRAM = 5
PERCENT = 75
FREQUENT = 16
"""Groups above this size count as frequent (a cost, not a cap: see the module text)."""

SEGMENT_FILL = 1.8
"""Elements per segment for the largest set of a band."""


class Bands:
    """Size bands and the number of segments and signatures in each."""

    def __init__(self, percent: int = PERCENT):
        if not 70 <= percent <= 100:  # below, sets of one and two elements could link
            raise ValueError("percent must be from 70 to 100")
        self.percent = percent
        self.edges = [1, 3, 6, 12]

    def top(self, band: int) -> int:
        """Size just above the band."""
        while len(self.edges) <= band + 1:
            self.edges.append(self.edges[-1] * 2)
        return self.edges[band + 1]

    def of(self, size: int) -> int:
        band = 0
        while self.top(band) <= size:
            band += 1
        return band

    def segments(self, band: int) -> int:
        top = self.top(band) - 1
        return 1 if top < 6 else 3 if top < 12 else ceil(top / SEGMENT_FILL) + 4

    def differences(self, a: int, b: int) -> int:
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def spare(self, band: int) -> int:
        return ceil(0.1 * self.differences(self.top(band), self.top(band))) + 1

    def roles(self, size: int) -> list[tuple[int, int]]:
        """(band, signatures needed) of each segmentation a set of this size takes part in."""
        own = self.of(size)
        largest = size * 100 // self.percent
        out = [(own, self.differences(size, largest) + 1)]
        smallest = -(-size * self.percent // 100)
        for band in range(own - 1, 0, -1):
            if self.top(band) - 1 < smallest:
                break
            out.append((band, self.differences(size, self.top(band) - 1) + 1))
        return out


def _salted(sums: np.ndarray, band: int, segment: np.ndarray) -> np.ndarray:
    return mix(sums ^ mix(segment.astype(np.uint64) + np.uint64((band + 1) << 40)))


def signatures(elements: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one sorted set, and for each how many frequent ones its role can spare."""
    values = mix(elements)
    out, spare = [], []
    for band, need in bands.roles(len(elements)):
        count = bands.segments(band)
        segment = ((elements >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        first = np.concatenate([[0], np.flatnonzero(segment[1:] != segment[:-1]) + 1])
        sums = np.add.reduceat(values, first)
        ids = segment[first]
        total = need + bands.spare(band)
        if len(first) >= need:
            signed = _salted(sums[:total], band, ids[:total])
            out.append(signed)
            # All sets of a band spare the same number, or none at all.
            spare.append(np.full(len(signed), total - need if len(first) >= total else -1, np.int32))
            continue
        sizes = np.diff(np.append(first, len(elements)))
        own = np.repeat(np.arange(len(first)), sizes)
        several = sizes[own] > 1
        signed = np.concatenate([_salted(sums, band, ids),
                                 _salted(sums[own] - values, band, ids[own])[several]])
        if len(first) + int((sizes > 1).sum()) < need:
            most = need - 1
            full = sum(values.tolist())
            less = [(full - sum(c)) % 2**64 for k in range(min(most, len(values) - 1) + 1) for c in combinations(values.tolist(), k)]
            signed = np.concatenate([signed, _salted(np.array(less, np.uint64), band, np.full(len(less), 1 << 30))])
        out.append(signed)
        spare.append(np.full(len(signed), -1, np.int32))
    return np.concatenate(out), np.concatenate(spare)


def _sets(batch: pa.RecordBatch, n: int, text: str = "text") -> Iterator[np.ndarray]:
    for words, _, _ in batch_words(batch.column(text)):
        yield np.unique(ngram_hashes(words, n))


def _fingerprint(elements: np.ndarray) -> tuple[int, int]:
    if not len(elements):
        return 0, 0
    a = mix(elements + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
    b = mix(elements ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def set_profiles(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """doc_id, n_shingles and a 128-bit fingerprint of every document's set."""

    def profile(batches):
        for batch in batches:
            rows = [(len(s), *_fingerprint(s)) for s in _sets(batch, n)]
            cols = np.array(rows, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(cols[:, i]) for i in range(3))],
                names=["doc_id", "n_shingles", "fp_a", "fp_b"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        profile, "doc_id long, n_shingles long, fp_a long, fp_b long")


def _signed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(sig, set, spare): signatures with the first half of the set's fingerprint; a task signs each distinct set once."""

    def sign(batches):
        bands, seen = Bands(percent), set()
        for batch in batches:
            rows: list[list[np.ndarray]] = []
            for elements in _sets(batch, n):
                if len(elements) < 3:
                    continue
                mark = _fingerprint(elements)
                if mark in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(mark)
                sig, spare = signatures(elements, bands)
                rows.append([sig.view(np.int64), np.full(len(sig), mark[0], np.int64), spare])
                if len(rows) == 512:
                    yield _batch(rows, ["sig", "set", "spare"])
                    rows = []
            if rows:
                yield _batch(rows, ["sig", "set", "spare"])

    rows = docs.where("doc_id is not null").select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sign, "sig long, set long, spare int")


def _elements(docs: DataFrame, n: int) -> DataFrame:
    """(sig, set, spare): every element of every set, with the document as the set."""

    def spread(batches):
        for batch in batches:
            rows: list[list[np.ndarray]] = []
            for doc_id, elements in zip(batch.column("doc_id").to_pylist(), _sets(batch, n), strict=True):
                rows.append([elements.view(np.int64), np.full(len(elements), doc_id, np.int64), np.zeros(len(elements), np.int32)])
                if len(rows) == 256:
                    yield _batch(rows, ["sig", "set", "spare"])
                    rows = []
            if rows:
                yield _batch(rows, ["sig", "set", "spare"])

    return docs.select("doc_id", "text").mapInArrow(spread, "sig long, set long, spare int")


PARITY_WORDS = 8
"""64-bit words of a set's parity bits."""


def _parities(docs: DataFrame, n: int) -> DataFrame:
    """(doc, bits): for each of the bits, whether an odd number of elements falls on it."""

    def fold(batches):
        for batch in batches:
            bits = []
            for elements in _sets(batch, n):
                odd = np.bincount((mix(elements ^ np.uint64(0x2545F491)) >> np.uint64(40)).astype(np.int64) % (64 * PARITY_WORDS),
                                  minlength=64 * PARITY_WORDS) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits, pa.list_(pa.int64()))], names=["doc", "bits"])

    return docs.select("doc_id", "text").mapInArrow(fold, "doc long, bits array<long>")


def _batch(rows: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=names)


def _grouped(signed: DataFrame) -> DataFrame:
    """Sets that share a signature, from one pass over sorted partitions.

    Groups of up to ``FREQUENT`` sets give their pairs (kind 0: x and y are sets),
    larger ones their members (kind 1: x is the signature, y a set). A task holds
    one batch and at most ``FREQUENT`` rows of the group before it.
    """
    names = ["kind", "x", "y", "spare"]

    def out(kind: int, x: np.ndarray, y: np.ndarray, spare: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y), pa.array(spare)], names=names)

    def whole(sig: np.ndarray, sets: np.ndarray, spare: np.ndarray):
        """Complete groups."""
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(first, len(sig)))
        each = np.repeat(size, size)
        if (large := each > FREQUENT).any():
            yield out(1, sig[large], sets[large], spare[large])
        for step in range(1, min(FREQUENT, int(size.max()))):
            i = np.flatnonzero((sig[step:] == sig[:-step]) & ~large[step:])
            if len(i):
                yield out(0, sets[i], sets[i + step], np.minimum(spare[i], spare[i + step]))

    def group(batches):
        held, hot, passed = None, None, None  # rows of the last group; or its signature and last set, if it is large already
        for batch in batches:
            rows = [np.asarray(batch.column(i)) for i in range(3)]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            sig, sets, spare = rows
            new = np.append(True, (sig[1:] != sig[:-1]) | (sets[1:] != sets[:-1]))
            if hot is not None:
                more = (sig == hot) & new & (sets != passed)
                if more.any():
                    yield out(1, sig[more], sets[more], spare[more])
                    passed = sets[more][-1]
                new &= sig != hot
            sig, sets, spare = sig[new], sets[new], spare[new]
            held = None
            if len(sig):
                cut = int(np.flatnonzero(sig != sig[-1])[-1]) + 1 if sig[0] != sig[-1] else 0
                if cut:
                    yield from whole(sig[:cut], sets[:cut], spare[:cut])
                hot = passed = None
                if len(sig) - cut > FREQUENT:
                    yield out(1, sig[cut:], sets[cut:], spare[cut:])
                    hot, passed = sig[-1], sets[-1]
                else:
                    held = [sig[cut:], sets[cut:], spare[cut:]]
        if held is not None:
            yield from whole(*held)

    return signed.repartition("sig").sortWithinPartitions("sig", "set").mapInArrow(group, "kind int, x long, y long, spare int")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets meet the similarity."""

    def check(batches):
        last, kept = None, None
        for batch in batches:
            good = []
            left = batch.column("text_a")
            for i, other in enumerate(_sets(batch, n, "text_b")):
                text = left[i].as_py()
                if kept is None or text != last:  # the rows of one ``a`` come together
                    last, kept = text, next(_sets(pa.record_batch([left.slice(i, 1)], names=["text"]), n))
                shared = len(np.intersect1d(kept, other, assume_unique=True))
                good.append(100 * shared >= percent * (len(kept) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def ngram_components(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id of every row of ``docs`` (doc_id, text, ...).

    Two documents link when ``100 * shared >= percent * union`` of their sets.
    component_id is the smallest doc_id reachable by links, set_id the smallest
    doc_id with an equal set. Null or empty texts have an empty set and are
    linked with nothing; rows without doc_id are returned with null ids. Rows
    that repeat a doc_id count as one node that owns all their texts. Other
    columns are ignored.
    """
    Bands(percent)
    profile = stored(set_profiles(docs, n), "profiles")
    named = profile.where("doc_id is not null and n_shingles > 0")
    sets = stored(named.groupBy("fp_a", "fp_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "sets")
    found = stored(_grouped(_signed(docs, n, percent)), "grouped")

    # Frequent signatures of a set, against those it can spare; the sets that
    # signed everything (-1) can spare none and meet every member.
    frequent = found.where("kind = 1").select(F.col("x").alias("sig"), F.col("y").alias("set"), "spare")
    load = stored(frequent.groupBy("set").agg(F.count("*").alias("load"), F.min("spare").alias("least")), "load")
    pairs = found.where("kind = 0").groupBy("x", "y").agg(F.count("*").alias("shared"), F.min("spare").alias("spare"))
    pairs = (pairs.join(load.select(F.col("set").alias("x"), F.col("load").alias("load_x")), "x", "left")
             .join(load.select(F.col("set").alias("y"), F.col("load").alias("load_y")), "y", "left")
             .where(F.col("shared") > F.col("spare") - F.least(F.coalesce("load_x", F.lit(0)), F.coalesce("load_y", F.lit(0)))))
    set_of = sets.select(F.col("fp_a").alias("set"), F.col("rep").alias("doc"), F.col("n_shingles").alias("size"))

    def alike() -> Column:
        return 100 * F.least("size", "o_size") >= percent * F.greatest("size", "o_size")

    other = set_of.select(F.col("set").alias("y"), F.col("doc").alias("o_doc"), F.col("size").alias("o_size"))
    pairs = stored(pairs.join(set_of.withColumnRenamed("set", "x"), "x").join(other, "y").where(alike()).select(
        F.least("doc", "o_doc").alias("a"), F.greatest("doc", "o_doc").alias("b"), "shared").where("a < b"), "pairs")

    frequent = frequent.join(load, "set").select(
        "sig", "set", (F.col("least") < 0).alias("short"), (F.col("load") > F.col("least")).alias("full"))
    with_short = frequent.where("short").select("sig").distinct()
    crowded = frequent.where("full").unionByName(frequent.where("not full").join(with_short, "sig", "left_semi"))
    crowded = stored(crowded.select("set").distinct().join(set_of, "set").select("doc", "size"), "crowded")
    wanted = crowded.select("doc").union(pairs.select("a")).union(pairs.select("b")).distinct().withColumnRenamed("doc", "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = stored(texts.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), "texts")

    # The crowded sets, element by element.
    single = stored(_grouped(_elements(texts.join(crowded.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi"), n)), "single")
    common = single.where("kind = 1").select(F.col("x").alias("sig"), F.col("y").alias("doc")).distinct()
    load = stored(common.groupBy("doc").agg(F.count("*").alias("load")).join(crowded, "doc"), "load")
    loads = [crowded.join(load.select("doc", "load"), "doc", "left").select(
        F.col("doc").alias(s), F.col("size").alias(f"size_{s}"), F.coalesce("load", F.lit(0)).alias(f"load_{s}")) for s in "xy"]
    found = single.where("kind = 0").groupBy("x", "y").agg(F.count("*").alias("shared")).join(loads[0], "x").join(loads[1], "y")
    found = found.where((100 + percent) * (F.col("shared") + F.least("load_x", "load_y")) >= percent * (F.col("size_x") + F.col("size_y")))
    pairs = stored(pairs.unionByName(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared"))
                   .groupBy("a", "b").agg(F.max("shared").alias("shared")), "candidates")
    needed = F.ceil(F.col("size") * percent / 100)
    frequency = common.groupBy("sig").agg(F.count("*").alias("frequency"))
    ranked = common.join(load.where(F.col("load") >= needed), "doc").join(frequency, "sig").withColumn(
        "rank", F.row_number().over(Window.partitionBy("doc").orderBy("frequency", "sig")))
    heavy = ranked.where(F.col("rank") <= F.col("load") - needed + 1).select("sig", "doc", "size", "load", "rank")
    parities = _parities(texts.join(load.where(F.col("load") >= needed).select(F.col("doc").alias("doc_id")), "doc_id", "left_semi"), n)
    active = stored(heavy.join(parities.groupBy("doc").agg(F.when(F.count("*") == 1, F.first("bits")).alias("bits")), "doc"), "active")
    centre = active.groupBy("sig").agg(F.min(F.struct("doc", "size")).alias("c"))
    stars = active.join(centre, "sig").withColumn("o_size", F.col("c.size")).where("doc <> c.doc").where(alike()).select(
        F.least("doc", "c.doc").alias("a"), F.greatest("doc", "c.doc").alias("b"))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    first = stored(stars.unionByName(best).distinct(), "first")
    links = stored(_verified(first, texts, n, percent), "links")

    # What is left: pairs in different components.
    root = components(links)
    rooted = stored(active.join(root, F.col("doc") == F.col("node"), "left").withColumn("root", F.coalesce("root", "doc")).drop("node"), "rooted")
    mixed = rooted.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
    rooted = rooted.join(mixed, "sig", "left_semi")
    others = rooted.select("sig", *(F.col(c).alias(f"o_{c}") for c in ("doc", "size", "load", "root", "rank", "bits")))
    # All that two sets share of their frequent elements comes from the first shared one on.
    left = 1 + F.least(F.col("load") - F.col("rank"), F.col("o_load") - F.col("o_rank"))
    enough = (100 + percent) * left >= percent * (F.col("size") + F.col("o_size"))
    apart_bits = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("o_bits")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    near = (100 + percent) * apart_bits <= (100 - percent) * (F.col("size") + F.col("o_size"))
    crossing = rooted.join(others, "sig").where("doc < o_doc and root <> o_root").where(alike() & enough & F.coalesce(near, F.lit(True))).select(
        F.col("doc").alias("a"), F.col("o_doc").alias("b"))
    ends = [root.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab"]
    apart = pairs.select("a", "b").join(ends[0], "a", "left").join(ends[1], "b", "left").where(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    rest = stored(crossing.unionByName(apart).distinct().join(first, ["a", "b"], "left_anti"), "rest")
    # The components so far are links to their roots.
    links = stored(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_verified(rest, texts, n, percent)), "links")

    root = components(links).withColumnRenamed("node", "rep")
    # A repeated doc_id joins the sets of its rows.
    owner = named.join(sets, ["fp_a", "fp_b", "n_shingles"]).select("doc_id", "rep").distinct()
    several = owner.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id")
    joined = stored(owner.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "joined")
    if not joined.isEmpty():
        root = components(links.unionByName(joined)).withColumnRenamed("node", "rep")
    rooted_sets = sets.join(root, "rep", "left").select(
        "fp_a", "fp_b", "n_shingles", F.col("rep").alias("set_id"), F.coalesce("root", "rep").alias("component_id"))
    return profile.join(rooted_sets, ["fp_a", "fp_b", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("set_id", "doc_id")).alias("set_id"))


def one_of_each_group(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The document with the smallest doc_id of every component; rows without doc_id stay."""
    found = ngram_components(docs, n, percent).where("doc_id = component_id").select("doc_id").distinct()
    lead = docs.join(found.hint("shuffle_hash"), "doc_id", "left_semi")
    return lead.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
