import random

import numpy as np
import pyarrow as pa
import pytest

from evospark.llm import licenses, paragraph_dedup
from evospark.llm.common import mix, word_hashes
from evospark.llm.licenses import TEMPLATES, document_paths, licensed
from evospark.llm.line_classes import tuned_bands
from evospark.llm.paragraph_dedup import paragraphs, repeated_passages
from tests.llm.conftest import prose, rows_of


def test_bands_reach_the_recall():
    for rows in (2, 3):
        for recall in (0.9, 0.97, 0.99):
            b = tuned_bands(75, recall, rows)
            assert 1 - (1 - 0.75**rows) ** b >= recall > 1 - (1 - 0.75**rows) ** (b - 1)


def test_passages_inside_lines_are_found(documents):
    rng = random.Random(8)
    passages = [prose(rng, n, 5000) for n in (51, 60, 90)]
    texts = [prose(rng, 150, 5000) for _ in range(40)]  # clean
    for p in passages:
        for _ in range(4):
            w = prose(rng, 120, 5000).split()
            texts.append(" ".join(w[:50]) + " " + p.upper() + "\n" + " ".join(w[50:]))
    texts += [None, "", "short", "of " * 300, f"{texts[0]}"]
    rows = rows_of(texts)
    got = repeated_passages(documents([*rows, dict(rows[5]), {"doc_id": None, "text": texts[1]}])).collect()
    assert {r.doc_id for r in got} == {*range(40, 52), 0, len(texts) - 1}
    for i, p in enumerate(passages):
        members = [r for r in got if 40 + 4 * i <= r.doc_id < 44 + 4 * i]
        first = [r for r in members if r.doc_id == 40 + 4 * i]
        assert all(r.n_removed == 0 for r in first) and all(r.n_removed == r.n_paragraphs for r in members if r not in first)
        for r in members:
            assert len(rows[r.doc_id]["text"].encode()[r.start:r.stop].split()) == r.n_words
            assert rows[r.doc_id]["text"].encode()[r.start:r.stop].decode().split()[2] in p.upper()


def test_near_paragraphs_join_a_component(documents, monkeypatch):
    monkeypatch.setattr(paragraph_dedup, "NEIGHBOURS", 400)  # whole lines
    rng = random.Random(6)
    line = prose(rng, 60, 5000).split()
    other = [*line[:-2], "new", "end"]
    got = repeated_passages(documents(rows_of([" ".join(line), "x y z\n" + " ".join(other), prose(rng, 60, 5000)]))).collect()
    assert {r.doc_id for r in got} == {0, 1} and len({r.component_id for r in got}) == 1


def brute_force_classes(sets):
    """Components of the sets (fp -> set of shingles) by comparing all pairs."""
    root = {fp: fp for fp in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(sets)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {fp: find(fp) for fp in sets}


def test_near_copies_in_a_crowded_bucket_are_linked(spark):
    rng = random.Random(12)
    common = prose(rng, 30, 5000)  # most bands of all these lines collide
    texts = [f"{tail} {common} {end}" for tail in (prose(rng, 12, 5000) for _ in range(80)) for end in ("left", "right")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = {}
    for t in texts:
        found = paragraph_dedup.whole_lines(t)
        stops = [*found.first[1:].tolist(), len(found.shingles)]
        for fp, a, b in zip(found.fp.view("int64").tolist(), found.first.tolist(), stops, strict=True):
            sets[fp] = set(found.shingles[a:b].tolist())
    assert {r.fp: r["class"] for r in paragraph_dedup._linked(docs, 5, 75).collect()} == brute_force_classes(sets)


def test_recall_of_the_bands_against_brute_force(spark):
    """Pairs just at the similarity, each in a component of its own, with production parameters."""
    rng = random.Random(31)
    texts, linked = [], 0
    for _ in range(600):
        line = prose(rng, 40, 50_000).split()
        edited = list(line)
        edited[rng.randrange(6, 34)] = "new"  # Jaccard 31 / 41
        texts += [" ".join(line), " ".join(edited[:rng.choice([40, 39])])]
    shingles = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    linked = sum(100 * len(a & b) >= 75 * len(a | b) for a, b in zip(shingles[::2], shingles[1::2], strict=True))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = paragraph_dedup._linked(docs, 5, 75)
    assert linked >= 250
    found = sum(1 for r in got.groupBy("class").count().collect() if r["count"] == 2)
    assert 0.95 * linked <= found <= linked


def test_edited_lines_are_found_with_production_parameters(documents):
    rng = random.Random(21)
    line = prose(rng, 100, 5000).split()
    edited = list(line)
    edited[33], edited[66] = "new", "words"  # Jaccard 86 / 106
    short = prose(rng, 30, 5000).split()
    cut = short[:27]
    texts = ["\n".join(["a b", " ".join(line), prose(rng, 40, 5000)]), prose(rng, 50, 5000) + "\n" + " ".join(edited),
             " ".join(short), "one two\n" + " ".join(cut), prose(rng, 60, 5000)]
    got = {r.doc_id: r for r in repeated_passages(documents(rows_of(texts))).collect()}
    assert {d: (r.n_words, r.n_paragraphs, r.n_removed) for d, r in got.items()} == {0: (100, 1, 0), 1: (100, 1, 1), 2: (30, 1, 0), 3: (27, 1, 1)}
    assert got[0].component_id == got[1].component_id != got[2].component_id == got[3].component_id
    assert texts[1].encode()[got[1].start:got[1].stop].decode() == " ".join(edited)


def test_lines_and_chunks_share_one_order():
    rng = random.Random(4)
    for _ in range(200):
        text = "\n".join(prose(rng, rng.choice([1, 4, 5, 6, 8, 9, 20, 60]), 5000) for _ in range(rng.randrange(1, 9)))
        lines, chunks = paragraph_dedup.split(text)
        places = set() if chunks is None else set(chunks.place.tolist())
        for i in range(0 if lines is None else len(lines.fp)):
            inside = [] if chunks is None else [p for p, s in zip(chunks.place, chunks.start, strict=True) if lines.start[i] <= s < lines.end[i]]
            own = range(lines.place[i], lines.place[i] + lines.span[i])
            assert list(own) == (inside or [lines.place[i]])
            places |= set(own)
        assert places == set(range(len(places)))


def test_texts_of_a_batch_are_split_together(monkeypatch):
    """A batch's units are those of its texts one by one, with hashing calls for the batch and not for each text."""
    rng = random.Random(13)
    texts = ["\n".join(prose(rng, rng.choice([0, 1, 4, 5, 6, 30]), 7) for _ in range(rng.randrange(5))) for _ in range(1500)]
    texts[::50] = [None, "", " \n\t", "a b c", "é ü\xa0ß x y z"] * 6
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 1600)), pa.array(texts)], names=["doc_id", "text"])
    for part in (paragraph_dedup.LINES, paragraph_dedup.CHUNKS):
        alone = []
        for doc_id, text in enumerate(texts, 100):
            found = paragraph_dedup.split(text)[part]
            if found is not None:
                alone += zip(found.fp.view("int64").tolist(), [doc_id] * len(found.fp),
                             *(c.tolist() for c in (found.place, found.span, found.words, found.start, found.end)), strict=True)
        calls, mix = [], paragraph_dedup.mix
        with monkeypatch.context() as patch:
            patch.setattr(paragraph_dedup, "mix", lambda x: calls.append(1) or mix(x))
            got = pa.Table.from_batches(paragraph_dedup._unit_batches(iter([batch]), 5, part))
        assert len(alone) > 1000 and list(zip(*(c.to_pylist() for c in got.columns), strict=True)) == alone
        assert len(calls) < 10
        few = pa.Table.from_batches(paragraph_dedup._unit_batches(iter([batch]), 5, part, lambda fp: fp % np.uint64(3) == 0, paragraph_dedup.UNIT[:2]))
        assert list(zip(*(c.to_pylist() for c in few.columns), strict=True)) == [u[:2] for u in alone if u[0] % 2**64 % 3 == 0]


def test_chunks_against_plain_windows():
    rng = random.Random(17)
    for _ in range(60):
        text = "\n".join(prose(rng, rng.choice([3, 8, 40]), 30) for _ in range(rng.randrange(1, 5)))
        hashes = word_hashes(text.encode())[0]
        pair = mix(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:]).tolist()
        near = paragraph_dedup.NEIGHBOURS
        opens = [all(p < q for q in pair[max(0, i - near):i]) and all(p <= q for q in pair[i + 1:i + 1 + near]) for i, p in enumerate(pair)]
        at, sizes = 0, []
        for line in text.split("\n"):
            words, to = line.split(), at + len(line.split())
            cuts = [at, *(i for i in range(at + 1, to) if i < len(opens) and opens[i]), to]
            sizes += [b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a >= 5]
            at += len(words)
        found = paragraphs(text)
        assert ([] if found is None else found.words.tolist()) == sizes


def test_paragraphs_shift_with_their_passage():
    rng = random.Random(1)
    p = prose(rng, 80, 5000)
    alone, inside = paragraphs(p), paragraphs(prose(rng, 33, 5000) + " " + p + " " + prose(rng, 9, 5000))
    assert len(set(alone.fp.tolist()) & set(inside.fp.tolist())) >= len(alone.fp) - 3
    assert paragraphs(None) is None and paragraphs("one two") is None


def test_empty_tables(documents):
    assert repeated_passages(documents([])).collect() == []
    assert licensed(document_paths(documents([]))).collect() == []


def test_licenses_and_inheritance(spark):
    rng = random.Random(2)
    text = lambda: prose(rng, 40)
    files = [
        (1, "a/LICENSE", text() + "\n" + TEMPLATES["MIT"] + "\n"), (2, "a/x.py", text()), (3, "a/b/c/y.py", text()),
        (4, "a/b/COPYING.txt", TEMPLATES["GPL-3.0"]), (5, "a/b/z.py", "# " + TEMPLATES["Apache-2.0"].lower()),
        (6, "other/q.py", text()), (7, None, None), (8, "ab/n.py", ""), (9, "a/b/in.py", text() + " " + TEMPLATES["CC-BY-NC-4.0"] + " " + text()),
        (10, "x.py", text()), (10, "x.py", text()),
    ]
    got = {r.doc_id: r for r in licensed(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {d: (r.license, r.origin) for d, r in got.items()} == {
        1: ("MIT", "file"), 2: ("MIT", "directory"), 3: ("GPL-3.0", "directory"), 4: ("GPL-3.0", "file"), 5: ("Apache-2.0", "file"),
        6: (None, None), 7: (None, None), 8: (None, None), 9: ("CC-BY-NC-4.0", "file"), 10: (None, None)}
    assert got[3].from_dir == "a/b" and got[1].line == 1


def matcher():
    words = {w for t in TEMPLATES.values() for w in licenses.words_of(t)}
    return licenses.Matcher({w: 300 if w in ("the", "of", "and", "in", "under") else 60 for w in words}, 10_000)


def test_notices_inside_lines_of_any_length():
    rng, found = random.Random(3), matcher()
    assert found.best("(c) 2021 Foo. Released under the MIT License.")[:2] == (pytest.approx(1), "MIT")
    for name, notice in TEMPLATES.items():
        size = len(licenses.words_of(notice))
        for length in range(size, 41):
            before = rng.randrange(length - size + 1)
            line = f"{prose(rng, before)} {notice} {prose(rng, length - size - before)}"
            assert found.best("one\n" + line) == (pytest.approx(1), name, 1)


def test_windows_against_plain_vectors():
    rng, found = random.Random(5), matcher()
    vocabulary = [*licenses.words_of(" ".join(TEMPLATES.values())), *prose(rng, 30).split()]
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 45))]
        scores = [0.0]
        for size in found.sizes:
            for i in range(1 - size, len(words)):
                part = found._vector(words[max(0, i):i + size])
                scores += [sum(v * t.get(w, 0) for w, v in part.items()) for t in found.templates.values()]
        assert found._slid(words, 0.0)[0] == pytest.approx(max(scores), abs=1e-8)


def test_wrapped_notices_headers_and_full_texts():
    rng, found = random.Random(7), matcher()
    for name, notice in [*TEMPLATES.items(), *licenses.HEADERS.items()]:
        words = notice.split()
        wrapped = "\n".join(" * " + " ".join(words[i:i + 3]) for i in range(0, len(words), 3))
        score, got, line = found.best(f"{prose(rng, 30)}\n{prose(rng, 9)}\n{wrapped}\n{prose(rng, 200)}")
        assert score >= 0.8 and got == name and line >= 1
    for name in licenses.FULL_TEXTS:
        assert found.best("Copyright (c) 2020 Foo\n" + licenses.full_text(name))[1] == name
    assert found.best(prose(rng, 500) + " the license of the work is under use")[0] < 0.8


def test_long_license_files_govern_their_shelf(spark):
    text = licenses.full_text("Apache-2.0")
    docs = spark.createDataFrame([(1, text, "en", "web"), (2, "plain words only", "en", "web")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.license, r.origin) for r in licensed(document_paths(docs)).collect()}
    assert got == {1: ("Apache-2.0", "file"), 2: ("Apache-2.0", "directory")}
