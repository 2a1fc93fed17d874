import random
from collections import defaultdict

import numpy as np
import pytest

from evospark.llm import ngram_join
from evospark.llm.common import components, ngram_hashes, word_hashes
from evospark.llm.ngram_join import Bands, ngram_components, one_of_each_group, signatures
from tests.llm.conftest import prose, rows_of


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets, parent = {}, {}
    for r in rows:
        if r["doc_id"] is not None:
            sets.setdefault(r["doc_id"], []).append(shingles(r["text"]))
            parent[r["doc_id"]] = r["doc_id"]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def check(documents, rows):
    got = ngram_components(documents(rows)).collect()
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
    counts = defaultdict(list)
    for r in rows:
        counts[r["doc_id"]].append(len(shingles(r["text"])))
    seen = defaultdict(list)
    for r in got:
        seen[r.doc_id].append(r.n_shingles)
    assert {k: sorted(v) for k, v in counts.items()} == {k: sorted(v) for k, v in seen.items()}


def test_against_all_pairs(documents, corpus):
    check(documents, corpus)


@pytest.mark.parametrize("limit", [1, 2])
def test_frequent_groups_are_exact(documents, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "FREQUENT", limit)  # nearly every group takes the path of the frequent ones
    rng = random.Random(3)
    passage = prose(rng, 30).split()
    texts = []
    for _ in range(25):
        texts.append(" ".join(passage + prose(rng, rng.choice([2, 4, 8, 40])).split()))
        w = list(passage)
        w[rng.randrange(30)] = "changed"
        texts.append(" ".join(w))
    check(documents, rows_of(texts))


def test_empty_table_and_repeated_ids(documents):
    assert ngram_components(documents([])).collect() == []
    rows = rows_of(["one two three four five six", "other words stand here and there", "one two three four five six"])
    rows.append({"doc_id": 1, "text": rows[0]["text"]})  # one id, two texts
    check(documents, rows)


def test_one_of_each_group_keeps_columns_and_rows_without_id(documents, corpus):
    docs = documents(corpus)
    out = one_of_each_group(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    want = {root for root in expected(corpus).values()}
    assert sorted(k for k in kept if k is not None) == sorted(want)
    assert kept.count(None) == 2


def test_signatures_always_meet():
    """Pigeonhole: sets within the allowed difference share a signature."""
    rng = np.random.default_rng(1)
    bands = Bands(75)
    for size in [3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 17, 23, 24, 40, 47, 48, 100, 300]:
        for _ in range(40):
            small = rng.integers(0, 2**64, size, dtype=np.uint64)
            drop = rng.integers(0, bands.differences(size, size) + 1)
            add = next(a for a in range(drop + size, -1, -1) if 100 * (size - drop) >= 75 * (size + a)) if 100 * (size - drop) >= 75 * size else None
            if add is None:
                continue
            large = np.concatenate([small[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)])
            a, b = (signatures(np.unique(s), bands)[0] for s in (small, large))
            assert len(np.intersect1d(a, b)), (size, drop, add)


def test_hashes_don_t_depend_on_blocks(monkeypatch):
    from evospark.llm import common

    text = (" é" + "x" * 50 + "\tab\n").encode() * 40
    whole = ngram_hashes(word_hashes(text)[0], 5)
    monkeypatch.setattr(common, "_BLOCK", 64)
    assert (ngram_hashes(word_hashes(text)[0], 5) == whole).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 201: 200}
