import random
import re
import zlib
from collections import Counter

import pytest

from evospark.llm import spelling

CAPITALS = {c: c + 32 for c in range(65, 91)}


def brute_force(rows):
    """The definition, word by word and pair by pair."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if a == b or len(b) - len(a) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    partners = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, others in partners.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(partners[w]), n.get(form[w]))
    return out


def edited(rng, word):
    i = rng.randrange(len(word) + 1)
    c = rng.choice("abcéÿ")
    return rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1:], word[:i] + c + word[i + 1:]])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([6, 6, 7, 8, 9, 14]))) for _ in range(40)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaab", "baaaaa", "ÀÖØÞß÷×", "àöøþß÷×", "l" * 3000, "l" * 2999]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 5, 30, 200])
        for _ in range(6):
            words += [edited(rng, w)] * rng.choice([2, 5, 8])
    words += ["Capital", "capital", "CAPITAL", "capital", "capitäl", "capital"] * 3
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::50])) for i in range(50)]
    return [*rows, (None, "capital,capital;capitol"), (None, None), (7, ""), (7, "12 . 34"), (8, rows[3][1]), (8, rows[3][1])]


@pytest.mark.parametrize("tile_words", [1, 3, 512])
def test_against_all_pairs(spark, rows, tile_words):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = spelling.spelling_groups(docs, tile_words=tile_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = got.collect()
    assert len(found) == len({r.word for r in found})
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == brute_force(rows)


def test_tiles_are_bounded(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = spelling.counted_words(spelling.damaged_runs(docs))
    tiles = spelling.tiles(words, 4).groupBy("size", "lo", "hi", "tile").count()
    assert all(r["count"] <= 4 or r.hi - r.lo == 1 for r in tiles.collect())


def test_nothing_to_group(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(empty).collect() == []
    assert spelling.spelling_groups(spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id long, text string")).collect() == []
