"""Letter runs of UTF-8 texts as byte positions and packed prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PACKED = 8
"""Bytes of a packed prefix: the first byte is the most significant, missing bytes are 0."""

_CHUNK = 1 << 20
_TERM = np.zeros(256, dtype=bool)
_TERM[ord("A"):ord("Z") + 1] = _TERM[ord("a"):ord("z") + 1] = _TERM[0x80:] = True
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(PACKED + 1)], dtype=np.uint64)
_SPACE_AFTER = np.array([0x20 << 8 * n for n in range(PACKED)] + [0], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


@dataclass
class Runs:
    """The runs of some consecutive texts: lower-cased bytes, run starts and ends, and the text of each run."""

    first: int  # index of the first text of this chunk
    count: int  # texts in it
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    def packed(self, size: int = PACKED, closed: bool = False) -> np.ndarray:
        """The first ``size`` bytes of every run; ``closed`` puts a space behind a run that is shorter."""
        length = self.end - self.start
        words = np.zeros(len(self.data) // 8 + 2, dtype="<u8")
        words.view(np.uint8)[:len(self.data)] = self.data
        first, shift = self.start >> 3, ((self.start & 7) << 3).astype(np.uint64)
        out = (words[first] >> shift) | ((words[first + 1] << (np.uint64(63) - shift)) << np.uint64(1))
        out &= _LOW_BYTES[np.minimum(length, size)]
        if closed:
            out |= _SPACE_AFTER[np.where(length < size, length, PACKED)]
        return out.byteswap()

    def strings(self, chosen: np.ndarray) -> pa.Array:
        """The chosen runs as an Arrow string array."""
        start, length = self.start[chosen], (self.end - self.start)[chosen]
        offsets = np.zeros(len(start) + 1, dtype=np.int64)
        np.cumsum(length, out=offsets[1:])
        at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(self.data[at].tobytes()))


def batch_runs(texts: pa.Array, chunk: int = _CHUNK) -> Iterator[Runs]:
    """Runs of ``[A-Za-z]`` and all non-ASCII characters of an Arrow string array (null: none), A-Z
    lower-cased, in chunks of whole texts of about ``chunk`` bytes. A run never crosses two texts."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, side="right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        part = _LOWER[raw[lo:hi]]
        cuts = offsets[at:to + 1] - lo
        inside = np.concatenate(([False], _TERM[part], [False]))
        edge = inside[1:] != inside[:-1]
        edge[cuts] = inside[1:][cuts] | inside[:-1][cuts]  # a text's border ends a run
        bounds = np.flatnonzero(edge)
        start = bounds[inside[1:][bounds]]
        end = bounds[np.searchsorted(bounds, start, side="right")] if len(start) else start
        owner = np.searchsorted(cuts, start, side="right") - 1
        yield Runs(at, to - at, part, start, end, owner)
        at = to


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code per value, distinct values): exact dictionary encoding."""
    found = values.dictionary_encode()
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return np.asarray(found.indices).astype(np.int64), found.dictionary


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often each occurs)."""
    counts = pa.array(values).value_counts()
    return np.asarray(counts.field("values")), np.asarray(counts.field("counts"))
