import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from evospark.llm.packing import assign, packed_pieces
from evospark.llm.sharding import allotted, capacities, ring, ring_shards
from evospark.llm.token_output import compress, decode_range, expand, packed, read_documents, unpacked, write_shards
from evospark.llm.tokenizing import WordCachedEncoder, vocabulary_path


def tokenizer():
    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return t


def test_shards_are_balanced_and_gapless(documents, corpus):
    got = ring_shards(documents(corpus)).collect()
    assert len(got) == len(corpus)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = defaultdict(list)
    for r in corpus:
        data = (r["text"] or "").encode()
        texts[r["doc_id"]].append((len(data) + 1, zlib.crc32(data)))
    for r in got:
        assert (r["size"], r.text_crc32) in texts[r.doc_id] and r.law == "rows" and r.grown_shard is None


def test_one_more_shard_moves_little(documents):
    docs = documents([{"doc_id": i, "text": "t"} for i in range(4000)])
    before = {r.doc_id: r.shard for r in ring_shards(docs).collect()}
    after = {r.doc_id: r.shard for r in ring_shards(docs, 9).collect()}
    moved = sum(before[d] != after[d] for d in before) / len(before)
    assert 1 / 9 - 0.01 <= moved < 0.4
    loose = Counter(r.shard for r in ring_shards(docs, slack=1.25).collect())
    assert max(loose.values()) <= 625


def test_overflow_moves_clockwise():
    _, owner = ring(3, 4)
    counts = {0: 100}
    out = allotted(counts, owner, capacities(100, 3))
    assert sum(b - a for _, a, b, _, _ in out) == 100
    assert sorted(Counter({s: b - a for _, a, b, s, _ in out}).values()) == [33, 33, 34]
    assert out[0][3] == owner[0]


def test_empty_tables(documents):
    assert ring_shards(documents([])).collect() == []
    assert packed_pieces(documents([])).collect() == []
    assert read_documents(write_shards(documents([]))).collect() == []


def test_cached_words_give_the_tokenizers_ids(monkeypatch):
    from evospark.llm import tokenizing

    monkeypatch.setattr(tokenizing, "CACHED_WORDS", 50)
    rng = random.Random(2)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "1", "'s", ".", "\xa0", "𝒳", "<|endoftext|>", " x", "\t", "!", "don't", "\x1c", " "]
    texts = [None, "", " ", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(600))]
    texts += [" ".join(rng.choice(["the", "of,", "x\ny", "it's", "1,5"]) for _ in range(30)) for _ in range(50)]
    encoder, plain = WordCachedEncoder(vocabulary_path()), tokenizer()
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == (plain.encode(text, add_special_tokens=False).ids if text else [])


def test_pieces(documents, corpus):
    rows = packed_pieces(documents(corpus), block_docs=40).collect()
    plain, want = tokenizer(), Counter()
    for r in corpus:
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want[r["doc_id"], tuple(ids)] += 1
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    single = {d: ids for (d, ids), n in want.items() if n == 1 and d is not None}
    for d, ids in single.items():
        at = 0
        for r in sorted(docs[d], key=lambda r: r.start):
            part = np.array(ids[at:at + r.length], dtype="<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())


@pytest.mark.parametrize("seed", range(5))
def test_assignment_fills_all_but_one(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 1024) for _ in range(rng.choice([1, 7, 300]))]
    out = assign(sizes, 1024)
    fill, parts = Counter(), defaultdict(list)
    for item, start, size, s in out:
        fill[s] += size
        parts[item].append((start, size))
    assert all(v <= 1024 for v in fill.values()) and len(fill) == -(-sum(sizes) // 1024)
    for item, pieces in parts.items():
        at = 0
        for start, size in sorted(pieces):
            assert start == at
            at += size
        assert at == sizes[item]


def test_grammar_round_trip():
    rng = np.random.default_rng(3)
    ids = np.tile(rng.integers(0, 50, 400), 30).astype("<u2")
    lengths = np.array([1, 11_000, 999, 0 + len(ids) - 12_000])
    rules, sizes, sequence = compress(ids, lengths, least=2)
    assert len(sequence) < len(ids) / 3
    assert (expand(sequence, rules) == ids).all()
    assert (unpacked(packed(sequence)) == sequence).all()
    for a, b in [(0, 1), (5, 5), (10, 4000), (len(ids) - 3, len(ids))]:
        assert (decode_range(sequence, rules, sizes, a, b) == ids[a:b]).all()
    assert len(compress(np.array([7], "<u2"), np.array([1]))[2]) == 1


def test_files_give_every_document_back(documents, corpus):
    shards = write_shards(documents(corpus).repartition(5), shard_ids=2000)
    assert shards.count() > 3
    got = sorted(read_documents(shards).collect(), key=lambda r: r.start)
    plain, want = tokenizer(), Counter()
    for r in corpus:
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)


def test_names_of_special_tokens_give_the_plain_tokenizers_ids(documents, monkeypatch):
    from evospark.llm import tokenizing

    plain = Tokenizer.from_file(vocabulary_path())
    texts = ["<|endoftext|>", "one <|endoftext|> two", "in<|endoftext|>side", "after <|endoftext|>", "x\n<|endoftext|>\ny <|endoftext|><|endoftext|>"]
    ids = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[1] == [505, 220, 50256, 734]
    docs = documents([{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    files = {r.doc_id: r for r in read_documents(write_shards(docs)).collect()}
    pieces = {r.doc_id: r for r in packed_pieces(docs, block_docs=40).collect()}
    at = 0
    for i, want in enumerate(ids):
        sums = [zlib.crc32(np.array([*want, end], "<u4").tobytes()) for end in (2, 0)]
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (at, len(want) + 1, sums[0])
        assert (pieces[i].doc_tokens, pieces[i].ids_crc32) == (len(want) + 1, sums[1])
        at += len(want) + 1
    monkeypatch.setattr(tokenizing, "CACHED_WORDS", 50)
    rng = random.Random(6)
    alphabet = ["a", "B", "é", " ", " ", "\n", "'s", "<|endoftext|>", " <|endoftext|>", " x", "\t", "don't", "\xa0"]
    mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    for text, got in zip(mixed, WordCachedEncoder(vocabulary_path(), spelt_out=False).encode(mixed), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
