"""Vectorised word hashing of Arrow batches of texts.

Words are runs of bytes other than U+0020 and U+0009..U+000D. A word's hash is polynomial in random
64-bit values of its bytes, taken as a difference of prefix sums, so no Python object is made per word;
windows of k words are hashed the same way over the word hashes.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASES = [int(x) | 1 for x in _RNG.integers(2**61, 2**63, 3, dtype=np.uint64)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of text that are hashed at once, unless a single text is longer.
SLICE = 1 << 20


def give_back() -> None:
    """Return to the machine what a finished task held: Python workers are used again, by other operators
    too, and the allocators of Arrow and C keep freed memory until they are asked."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it; elsewhere freed memory stays as it is
    if trim:
        trim(0)


def task(run):
    """run, a function of batches for mapInArrow, which gives its memory back when the task ends."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


_given = [0.0]


def rested(out):
    """out, the result for one group, after memory is given back now and then: a function of groups isn't
    told which is a task's last."""
    if time.monotonic() - _given[0] > 1:
        give_back()
        _given[0] = time.monotonic()
    return out


class Memo(dict):
    """A dict of bounded size in bytes, roughly counted. When half of the bound is reached its entries become
    those of `old`, whose own are forgotten; what is forgotten is worked out again. cost: bytes of an entry
    besides the strings' or bytes' own."""

    def __init__(self, most: int, cost: int = 250):
        super().__init__()
        self.half, self.cost, self.held, self.old = most // 2, cost, 0, {}

    def keep(self, key, value, size: int):
        self.held += size + self.cost
        if self.held > self.half:
            self.old = dict(self)
            self.clear()
            self.held = size + self.cost
        self[key] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i up to n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16) * 2
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[which] = have = (out[0], out[1])
    return have


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    power, inverse = _powers(which, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def as_binary(texts) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.cast(pa.large_binary())


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each text and the end, the index of its first word. Null: none."""
    texts = as_binary(texts)
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    at = at - at[0]
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    word = ~_SPACE[raw]
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[at] = True
    before = np.zeros(len(raw), bool)
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | breaks[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | breaks[1:])) + 1
    return _spans(_BYTE[raw], start, end, 0), np.searchsorted(start, at)


def windows(hashes: np.ndarray, first: np.ndarray, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words that lie in one text, and their first words' indices."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    start = np.arange(n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = start[text[:n] == text[k - 1 :]]
    return _spans(mix(hashes + np.uint64(7)) if second else hashes, start, start + k, 2 if second else 1), start


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.diff(np.frombuffer(as_binary(batch.column(column)).buffers()[1], np.int64)[: batch.num_rows + 1])
        group = np.cumsum(size) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
