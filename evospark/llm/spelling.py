"""Grouping of spelling variants by dense prefix-suffix tiling.

A tile holds the words of length L and L - 1 that agree outside a window of
positions: a pair that differs by one edit inside the window meets there. Tiles
begin with the halves of a word; a tile of too many words is split into the two
halves of its window until every tile is small enough or the window is a single
position, where the letters of the alphabet bound it. Words of a tile become
padded matrices of code points, one from the front and one from the back, in blocks;
block pairs are compared densely. Two words are one edit apart when their common
prefix and suffix together reach the longer length minus one. A pair counts in
the one tile whose window holds the position after its common prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evospark.llm.common import stored

LETTERS = r"[A-Za-z\x{00C0}-\x{00FF}]"
DELETE_ONE_IN = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5
"""A form is at least this many times as frequent as its variant."""

TILE_WORDS = 512
BLOCK_WORDS = 32
_CELLS = 1 << 22


def damaged_runs(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word) per letter run of whole texts: A-Z lower-cased, one code point deleted in the runs that the
    checksum of ``<doc_id>:<run>`` picks (null doc_id: nothing before the colon); words under
    ``least_length`` code points are left out, null texts have none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # A run only gets shorter, so shorter ones need not leave the text.
    runs = F.regexp_extract_all(lowered, F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    prefix = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    word = F.transform(runs, lambda r: _damaged(r, F.crc32(F.concat(prefix, r).cast("binary"))))
    return docs.select(F.explode(word).alias("word")).where(F.length("word") >= least_length)


def _damaged(run: Column, h: Column) -> Column:
    at = (h % F.length(run)).cast("int")
    return F.when(h % DELETE_ONE_IN == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted_words(runs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur ``least_count`` times or more."""
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _tile_rows(words: DataFrame, windows: Column) -> DataFrame:
    """One row per word and window (size, lo, hi); ``tile`` is what the word has outside the window."""
    w = words.withColumn("at", F.explode(windows)).select("word", "n", "at.size", "at.lo", "at.hi")
    after = F.col("size") - F.col("hi")
    outside = F.concat(F.substring(F.col("word"), F.lit(1), F.col("lo")), F.lit("\0"),
                       F.when(after > 0, F.substring(F.col("word"), F.length("word") - after + 1, after)).otherwise(""))
    return w.withColumn("tile", F.xxhash64("size", "lo", outside))


def _window(size: Column, lo: Column, hi: Column) -> Column:
    return F.struct(size.cast("int").alias("size"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def tiles(words: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """(word, n, size, lo, hi, tile): every tile has at most ``tile_words`` words or a window of one position.

    Tiles of a single word are left out: it has no partner in that window.
    """
    length = F.length("word")

    def halves(size: Column) -> list[Column]:
        return [_window(size, F.lit(0), F.ceil(size / 2)), _window(size, F.ceil(size / 2), size)]

    rows = stored(_tile_rows(words, F.array(*halves(length), *halves(length + 1))), "tiles")
    done = None
    while True:
        sizes = rows.groupBy("size", "lo", "hi", "tile").agg(F.count("*").alias("members"))
        large = (F.col("members") > tile_words) & (F.col("hi") - F.col("lo") > 1)
        sized = stored(rows.join(sizes.where("members > 1"), ["size", "lo", "hi", "tile"]).withColumn("large", large), "sized")
        small = sized.where("not large").select("word", "n", "size", "lo", "hi", "tile")
        done = small if done is None else done.unionByName(small)
        if sized.where("large").limit(1).count() == 0:
            return done
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        parts = F.array(_window(F.col("size"), F.col("lo"), middle), _window(F.col("size"), middle, F.col("hi")))
        rows = stored(_tile_rows(sized.where("large").select("word", "n", parts.alias("parts")), F.col("parts")), "tiles")


def near_pairs(words: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """(word, n, other, other_n): both orders of every pair of distinct words one edit apart, each once."""
    placed = tiles(words, tile_words)
    # A tile is small by construction, so a task never holds more than some of them.
    dealt = placed.repartition("size", "lo", "hi", "tile").sortWithinPartitions("size", "lo", "hi", "tile", "word")
    return dealt.mapInArrow(_compared, "word string, n long, other string, other_n long")


def _compared(batches) -> Iterator[pa.RecordBatch]:
    """Pairs of the tiles in sorted rows; a tile that a batch cuts is finished with the next one."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        border = _borders(rest)
        if len(border) > 1:  # the last tile may go on
            yield _tile_pairs(rest.slice(0, border[-1]), border)
            rest = rest.slice(border[-1])
    if rest is not None and rest.num_rows:
        yield _tile_pairs(rest, np.append(_borders(rest), rest.num_rows))


def _borders(rows: pa.Table) -> np.ndarray:
    """First row of each tile."""
    key = [np.asarray(rows.column(c).combine_chunks()) for c in ("size", "lo", "hi", "tile")]
    change = np.any([k[1:] != k[:-1] for k in key], axis=0) if rows.num_rows > 1 else np.zeros(0, bool)
    return np.concatenate(([0], np.flatnonzero(change) + 1)) if rows.num_rows else np.zeros(0, np.int64)


def _tile_pairs(rows: pa.Table, border: np.ndarray) -> pa.RecordBatch:
    """Pairs of whole tiles; ``border`` has the first row of each and the end of the last."""
    words, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
    text = words.to_pylist()
    tile = {c: np.asarray(rows.column(c).combine_chunks()).astype(np.int64)[border[:-1]] for c in ("size", "lo", "hi")}
    members = np.diff(border)
    width = (tile["size"] + 7) // 8 * 8
    # Blocks as high as the tile, within bounds; tiles of one height and width are compared together.
    limit = 2 ** np.floor(np.log2(np.maximum(4, _CELLS // width)) / 2).astype(np.int64)
    height = np.minimum(np.minimum(BLOCK_WORDS, limit), 2 ** np.ceil(np.log2(np.maximum(members, 2))).astype(np.int64))
    found = [(np.zeros(0, np.int64),) * 2]
    for h, w in np.unique(np.stack([height, width]), axis=1).T.tolist():
        chosen = np.flatnonzero((height == h) & (width == w))
        blocks = -(-members[chosen] // h)
        pairs = np.array([(t, i, j) for t, k in zip(chosen.tolist(), blocks.tolist(), strict=True) for i in range(k) for j in range(i, k)])
        step = max(1, _CELLS // (h * h * w))
        for part in (pairs[i:i + step] for i in range(0, len(pairs), step)):
            found.append(_block_pairs(text, border, tile, part, h, w))
    x, y = (np.concatenate(side) for side in zip(*found, strict=True))
    left, right = pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x]))
    return pa.RecordBatch.from_arrays([words.take(left), n.take(left), words.take(right), n.take(right)],
                                      names=["word", "n", "other", "other_n"])


def _block_pairs(text: list[str], border: np.ndarray, tile: dict[str, np.ndarray], pairs: np.ndarray, h: int, w: int,
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the words one edit apart in block pairs (tile, block, block) of ``h`` words of up to ``w`` code points."""
    t, sides = pairs[:, 0], []
    for k in (1, 2):
        row = (border[t] + pairs[:, k] * h)[:, None] + np.arange(h)
        used = row < border[t + 1][:, None]
        row = np.where(used, row, border[t][:, None])
        sides.append((row, used, *_matrices(text, row, w)))
    (a, a_used, a_len, a_left, a_right), (b, b_used, b_len, b_left, b_right) = sides

    def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        differ = x[:, :, None, :] != y[:, None, :, :]
        return np.where(differ.any(-1), differ.argmax(-1), w)

    longer = np.maximum(a_len[:, :, None], b_len[:, None, :])
    shorter = np.minimum(a_len[:, :, None], b_len[:, None, :])
    prefix = np.minimum(agreeing(a_left, b_left), shorter)
    suffix = np.minimum(agreeing(a_right, b_right), shorter)
    size, lo, hi = (tile[c][t][:, None, None] for c in ("size", "lo", "hi"))
    near = ((prefix + suffix >= longer - 1) & (longer - shorter <= 1) & (longer == size) & (prefix >= lo) & (prefix < hi)
            & a_used[:, :, None] & b_used[:, None, :] & (a[:, :, None] < b[:, None, :]))
    k, i, j = np.nonzero(near)
    return a[k, i], b[k, j]


def _matrices(text: list[str], row: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and padded code-point matrices, from the front and from the back, of the words in ``row``."""
    used, inverse = np.unique(row, return_inverse=True)
    words = [text[i] for i in used.tolist()]
    length = np.array([len(x) for x in words], dtype=np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
    front, back = np.zeros((2, len(words), w), dtype=np.uint16)
    front[owner, at] = points
    back[owner, length[owner] - 1 - at] = points
    inverse = inverse.reshape(row.shape)
    return length[inverse], front[inverse], back[inverse]


def spelling_groups(docs: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES, tile_words: int = TILE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word.

    ``form`` is the most frequent near word (ties: smallest in code-point order)
    if it is ``times`` as frequent; ``root`` follows forms to the last. Counts
    rise along forms, so there are no circles and the rounds are few. Nothing
    for an empty table or for texts without letters; repeated rows count again.
    """
    words = stored(counted_words(damaged_runs(docs), least_count), "words")
    near = near_pairs(words, tile_words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    named = words.join(near, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    forms = stored(named.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(forms.where("form is not null").select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root) at the end of every chain of (word, root) steps, by pointer doubling."""
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(steps.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.where("moved").limit(1).count() == 0:
            return steps
