"""Token ids by the ``tokenizers`` library, with a bounded table of words seen before."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from evospark.llm.common import mix

VOCABULARY = "byte_bpe_50k.json"
CACHED_WORDS = 1_200_000
OPENERS = ("Ġ", "Ċ")
"""How byte-level vocabularies write a space and a line break."""

KEPT_BYTES = 64
"""Longer units are encoded each time, not kept in the table."""

_SLOT_BITS = 21
_STEP = 1 << 17
"""Units that are looked up together."""

_SLICE = 1 << 20
"""Bytes of text that are cut into units together, unless one text is longer."""

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, 0x0A]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ",.;:!?"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 ``data`` belong to white space, ASCII or not."""
    out = _WHITE[data]
    at = np.flatnonzero(_LEADS[data])
    if len(at):
        wide = np.append(data, np.zeros(2, np.uint8))
        a, b, c = (wide[at + i].astype(np.int64) for i in range(3))
        code = ((a & 15) << 12) | ((b & 63) << 6) | (c & 63)
        two = at[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
        three = at[(a != 0xC2) & (((code >= 0x2000) & (code <= 0x200A)) | np.isin(code, [0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))]
        for i in range(2):
            out[two + i] = True
        for i in range(3):
            out[three + i] = True
    return out


def _hashes(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes (never 0) of byte ranges; ``words`` are the bytes as little-endian 64-bit integers, one to spare."""
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    todo, at, left = np.arange(len(start)), start, size
    while len(todo):
        first, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        value = (words[first] >> shift) | ((words[first + 1] << (np.uint64(63) - shift)) << np.uint64(1))
        out[todo] = mix(out[todo] ^ (value & _LOW_BYTES[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return np.maximum(out, np.uint64(1))


class _Table:
    """Open-addressing table: hash of a unit -> its ids."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << _SLOT_BITS, dtype=np.uint64)
        self.entry = np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        self.begin = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype="<u2")
        self.used = self.filled = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        todo = np.arange(len(hashes))
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        while len(todo):
            key = self.keys[slot]
            hit = key == hashes[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << _SLOT_BITS) - 1)
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> None:
        """New distinct hashes with their ids, cut at ``cuts`` (first 0, last the number of ids)."""
        n = len(hashes)
        while self.used + n > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled:self.filled + len(ids)] = ids
        self.begin[self.used:self.used + n] = self.filled + cuts[:-1]
        self.size[self.used:self.used + n] = np.diff(cuts)
        entry = np.arange(self.used, self.used + n, dtype=np.int32)
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        while len(slot):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = hashes[free]  # the last one of equal slots stays
            done = np.zeros(len(slot), dtype=bool)
            done[free] = self.keys[slot[free]] == hashes[free]
            self.entry[slot[done]] = entry[done]
            slot, hashes, entry = (slot[~done] + 1) & ((1 << _SLOT_BITS) - 1), hashes[~done], entry[~done]
        self.used += n
        self.filled += len(ids)


class WordCachedEncoder:
    """Ids (16-bit) of whole texts, as the tokenizer gives them without adding special tokens.

    ``spelt_out`` encodes the names of special tokens inside a text letter by
    letter; without it they give their own ids, as in a plain call of the library.

    The tokenizer never joins characters across the start of one space or line
    break that stands between two characters other than white space, nor between
    an ASCII letter and one of ``,.;:!?`` after it, so texts are cut there into
    units. Units of up to ``KEPT_BYTES`` bytes are known by a 64-bit hash of
    their bytes and length and looked up many at a time; new ones, and all longer
    ones, are encoded by the library. A full table is emptied.
    """

    def __init__(self, path: str, spelt_out: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spelt_out
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary must fit 16 bits")
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids whose bytes begin with a space or a line break
        self.opens[[i for token, i in vocabulary.items() if token.startswith(OPENERS)]] = True
        self.table = _Table()

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")

    def _learn(self, hashes: np.ndarray, units: list[bytes], joinable: np.ndarray) -> None:
        """Joinable units begin with a space or a line break and hold no other white space: only their first id begins with one."""
        together = np.flatnonzero(joinable)
        if len(together):
            ids = self._plain(b"".join(units[i] for i in together.tolist()).decode())
            self.table.add(hashes[together], ids, np.append(np.flatnonzero(self.opens[ids]), len(ids)))
        alone = np.flatnonzero(~joinable)
        if len(alone):
            each = [self._plain(units[i].decode()) for i in alone.tolist()]
            self.table.add(hashes[alone], np.concatenate(each), np.cumsum([0, *map(len, each)]))

    def _units(self, data: np.ndarray, words: np.ndarray, start: np.ndarray, size: np.ndarray, whites: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit)."""
        kept = np.flatnonzero(size <= KEPT_BYTES)
        hashes = _hashes(words, start[kept], size[kept])
        entry = self.table.find(hashes)
        if (entry < 0).any():
            fresh, first = np.unique(hashes[entry < 0], return_index=True)
            at = kept[entry < 0][first]
            if self.table.used and self.table.used + len(fresh) > CACHED_WORDS:
                self.table.clear()
                fresh, first = np.unique(hashes, return_index=True)
                at = kept[first]
            units = [data[a:a + n].tobytes() for a, n in zip(start[at].tolist(), size[at].tolist(), strict=True)]
            inside = whites[start[at] + size[at]] - whites[start[at]]
            self._learn(fresh, units, _BREAK[data[start[at]]] & (inside == 1))
            entry = self.table.find(hashes)
        count = np.zeros(len(start), dtype=np.int64)
        count[kept] = self.table.size[entry]
        long = np.flatnonzero(size > KEPT_BYTES).tolist()
        spelt = [self._plain(data[start[i]:start[i] + size[i]].tobytes().decode()) for i in long]
        count[long] = [len(x) for x in spelt]
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]), dtype="<u2")
        begin = ends[kept] - count[kept]
        step = np.repeat(self.table.begin[entry] - np.cumsum(count[kept]) + count[kept], count[kept]) + np.arange(int(count[kept].sum()))
        if long:
            out[np.repeat(begin - np.cumsum(count[kept]) + count[kept], count[kept]) + np.arange(len(step))] = self.table.ids[step]
            for i, x in zip(long, spelt, strict=True):
                out[ends[i] - len(x):ends[i]] = x
        else:
            out[:] = self.table.ids[step]
        return out, count

    def encode_array(self, texts: pa.Array):
        """The ids of each text of an Arrow string array, in order; a null text has none."""
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        raw = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, side="right")) - 1)
            lo, hi = int(offsets[at]), int(offsets[to])
            borders = offsets[at:to + 1] - lo
            data = raw[lo:hi]
            yield from self._slice(data, borders) if hi > lo else (np.zeros(0, "<u2") for _ in range(at, to))
            at = to

    def _slice(self, data: np.ndarray, borders: np.ndarray):
        white = _white(data)
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[borders] = True
        if len(data) > 2:  # a space at the end of a text starts nothing
            cut[1:-2] |= _BREAK[data[1:-1]] & ~white[:-2] & ~white[2:] & ~cut[2:-1]
            cut[1:-1] |= _STOP[data[1:]] & _LETTER[data[:-1]]
        start = np.flatnonzero(cut[:-1])
        size = np.diff(np.append(start, len(data)))
        whites = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(white, out=whites[1:])
        words = np.zeros(len(data) // 8 + 2, dtype=np.uint64)
        words.view(np.uint8)[:len(data)] = data
        found = [self._units(data, words, start[i:i + _STEP], size[i:i + _STEP], whites) for i in range(0, len(start), _STEP)]
        ids, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = np.append(0, np.cumsum(counts))[np.searchsorted(start, borders, side="left")]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield ids[a:b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids as little-endian bytes."""
        return [x.tobytes() for x in self.encode_array(pa.array(texts, pa.large_string()))]


_ENCODERS: dict[tuple[str, bool], WordCachedEncoder] = {}


def worker_encoder(path: str, spelt_out: bool = False) -> WordCachedEncoder:
    """The encoder of this Python worker: tasks that follow each other in it share the table."""
    if (path, spelt_out) not in _ENCODERS:
        _ENCODERS[path, spelt_out] = WordCachedEncoder(path, spelt_out)
    return _ENCODERS[path, spelt_out]


def crc(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
