"""Words, word hashes and word shingles of whole Arrow batches, computed with numpy over the UTF-8 bytes.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D, so multi-byte characters stay whole. Hashes are 64 bits wide: a
word's is a polynomial over random byte values, mixed; two different sequences share one with a chance of about 2**-64.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1
COEF = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what a step holds beside its batch stays small. Freed memory goes back when they end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(max(n, CHUNK) + 1, b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes; a null counts as an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    start = np.flatnonzero(word & (~before | cut[:-1]))
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * COEF[7])


def shingle_sets(texts: pa.Array, k: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased first. With fewer than k words, the one sequence of them all."""
    for _, data, offsets in chunks(texts):
        data = LOWER[data] if lower else data
        start, end, row = spans(data, offsets)
        h = hashes(data, start, end)
        first = np.searchsorted(row, np.arange(len(offsets)))
        grams = np.zeros(0, np.uint64)
        if len(h) >= k:
            grams = sum((h[j : len(h) - k + 1 + j] * COEF[j] for j in range(1, k)), h[: len(h) - k + 1] * COEF[0])
            grams = mix(grams)
        for d in range(len(offsets) - 1):
            a, b = first[d], first[d + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield mix((h[a:b] * COEF[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * COEF[5])
            else:
                yield grams[:0]
