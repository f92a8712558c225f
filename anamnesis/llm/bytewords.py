"""Words of whole batches of texts as numpy arrays over their UTF-8 bytes.

A batch is read in runs of whole texts of about ``RUN_BYTES``; a longer text is a run of its own.
A word is hashed as a polynomial over its bytes modulo 2**64, then mixed. Equal words have equal
hashes; two different ones of a billion agree with a chance of about 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))

# The bytes that words may hold.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64; kept for the next call."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, RUN_BYTES + 1), base, dtype=U)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if len(kept) <= 8 * RUN_BYTES:
            _powers[int(base)] = kept
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of whole texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    ends = ends[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


class Words:
    """Words of a run: ``start`` and ``end`` byte, ``row`` of each, ``first`` word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = letters[data]
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        begin[edges] = inside[edges]
        stop[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte range."""
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, dtype=U)
            np.cumsum((self.data.astype(U) + U(1)) * powers(BASE, len(self.data)), out=self._sums[1:])
        raw = (self._sums[end] - self._sums[start]) * powers(INVERSE, len(self.data) + 1)[start]
        return mix(raw + (end - start).astype(U))

    def hashes(self) -> np.ndarray:
        return self.slices(self.start, self.end)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


#: Odd multipliers by place in a window.
_PLACES = mix(np.arange(1, 65, dtype=U) * BASE) | U(1)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive words; windows may cross texts, which callers mask."""
    count = max(len(h) - n + 1, 0)
    out = np.zeros(count, dtype=U)
    for k in range(n):
        out += h[k : k + count] * (_PLACES[k] if k < len(_PLACES) else mix(np.full(1, U(k) * BASE))[0] | U(1))
    return mix(out)


def inside_rows(words: Words, n: int) -> np.ndarray:
    """Which of the windows of ``windows`` lie in one text."""
    count = max(len(words) - n + 1, 0)
    return words.row[:count] == words.row[n - 1 : n - 1 + count]
