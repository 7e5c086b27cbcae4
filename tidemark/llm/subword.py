"""Subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 6 bytes of " word ", lower-cased), each a row of one hashed embedding table; a
window of words is the mean of its words. Since the softmax is linear in that mean, the trained model folds into one score for each
table row and class, and scoring whole texts is a few vector operations per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.words import BASE, BYTE, chunks, hashes

BITS = 18
SIZES = (3, 4, 5, 6)
# Digits and signs that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FOLD = np.full(256, 32, np.uint8)
FOLD[48:58] = np.arange(48, 58)
FOLD[65:91] = np.arange(97, 123)
FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
for _a, _b in DISGUISE.items():
    FOLD[ord(_a)] = ord(_b)
_STEP = [np.uint64(pow(BASE, j, 1 << 64)) for j in range(max(SIZES))]
_TOP = np.uint64(64 - BITS)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def folded(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, word starts, row of each word, rows) of runs of whole texts: words lower-cased, folded, without doubled letters and parted by one space."""
    blank = pa.scalar(" ", pa.large_string())
    texts = pc.binary_join_element_wise(blank, pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), ""), blank, pa.scalar("", pa.large_string()))
    for _, data, offsets in chunks(texts):
        rows = len(offsets) - 1
        data = FOLD[data]
        row = np.repeat(np.arange(rows), np.diff(offsets))
        space = data == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[1:] &= (data[1:] != data[:-1]) | (data[1:] < 97) | (data[1:] > 122)  # doubled letters count once
        keep[0] = True
        data, row = data[keep], row[keep]
        space = data == 32
        start = np.flatnonzero(~space[1:] & space[:-1]) + 1
        yield data, start, row[start], rows


def grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the table row of the n-gram at each position, and whether it lies within one word and its spaces."""
    n = len(data)
    v = BYTE[data]
    count = np.concatenate([[0], np.cumsum(data == 32)])
    h = v.copy()
    for size in range(2, max(SIZES) + 1):
        if size > n:
            return
        h = h[: n - size + 1] + v[size - 1 :] * _STEP[size - 1]
        if size in SIZES:
            inside = count[size - 1 : n] - count[1 : n - size + 2]
            yield ((h * _ODD) >> _TOP).astype(np.int32), inside == 0


def word_scores(data: np.ndarray, start: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean over each word's n-grams of ``table`` (rows, or rows x classes)."""
    flat = table.reshape(len(table), -1)
    total = np.zeros((len(data), flat.shape[1]), np.float32)
    count = np.zeros(len(data), np.float32)
    for rows, ok in grams(data):
        total[: len(rows)] += np.where(ok[:, None], flat[rows], np.float32(0))
        count[: len(rows)] += ok
    if not len(start):
        return np.zeros((0, flat.shape[1]), np.float32)
    return np.add.reduceat(total, start - 1, axis=0) / np.maximum(np.add.reduceat(count, start - 1), 1)[:, None]


def bags(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams' table rows, ordered by word, and how many each word has."""
    ids, word = [], []
    at = np.zeros(len(data), np.int64)
    at[start - 1] = 1
    owner = np.cumsum(at) - 1
    for rows, ok in grams(data):
        ids.append(rows[ok])
        word.append(owner[: len(rows)][ok])
    word = np.concatenate(word) if word else np.zeros(0, np.int64)
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    ids, word = ids[word >= 0], word[word >= 0]
    order = np.argsort(word, kind="stable")
    return ids[order], np.bincount(word, minlength=len(start))


def text_counts(ids: np.ndarray, size: np.ndarray, word: np.ndarray, rows: np.ndarray, run: int = 50_000) -> np.ndarray:
    """In how many texts each n-gram occurs. ``ids``: of the distinct words, ``size`` of each; ``word`` and ``rows``: of every word, its
    place among them and its text, texts in order. Runs of whole texts keep what is expanded small."""
    edge, count = np.concatenate([[0], np.cumsum(size)]), np.zeros(1 << BITS, np.int64)
    at = 0
    while at < len(rows):
        to = int(np.searchsorted(rows, rows[min(at + run, len(rows)) - 1], side="right"))
        pair = np.unique((rows[at:to] - rows[at]) * len(size) + word[at:to])
        r, w = pair // len(size), pair % len(size)
        n = size[w]
        where = np.repeat(edge[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.unique(np.repeat(r, n) * (1 << BITS) + ids[where])
        count += np.bincount(cell & ((1 << BITS) - 1), minlength=1 << BITS)
        at = to
    return count


def unique_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct folded words of all texts, as (bytes with a space around each, start of each), and of every word its place among
    them and its text. Words are told apart by 64-bit hashes, which are the same in every process."""
    parts, keys, owners, base = [], [], [], 0
    known: dict[int, int] = {}
    for data, start, row, n in folded(pa.array(texts, pa.string())):
        ends = np.flatnonzero(data == 32)
        end = ends[np.searchsorted(ends, start)] if len(start) else start
        h = hashes(data, start, end)
        own, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        for key, k in zip(own.tolist(), first.tolist(), strict=True):
            if key not in known:
                known[key] = len(known)
                parts.append(data[start[k] : end[k] + 1])
        keys.append(np.array([known[key] for key in own.tolist()], np.int64)[inverse])
        owners.append(row + base)
        base += n
    data = np.concatenate([FOLD[:1], *parts])
    start = np.cumsum([1, *map(len, parts)])[:-1]
    return data, start, np.concatenate(keys) if keys else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


class Trainer:
    """Full-batch Adam on the cross-entropy of words. Equal words of one class are one example with their weights added up, so the work
    depends on distinct words; n-grams of fewer than ``least_texts`` texts aren't learnt, so nothing is remembered of single texts."""

    def __init__(self, texts: list[str], classes: int, dim: int = 3, seed: int = 11, least_texts: int = 4):
        data, start, self.word, self.text = unique_words(texts)
        ids, size = bags(data, start)
        self.size = np.maximum(size, 1).astype(np.float32)[:, None]
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        common = text_counts(ids, size, self.word, self.text) >= least_texts
        ids, owner = ids[common[ids]], owner[common[ids]]
        self.used, self.slot = np.unique(ids, return_inverse=True)
        order = np.argsort(self.slot, kind="stable")
        self.by_slot = owner[order]
        self.word_edge, self.slot_edge = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (owner, self.slot[order]))
        self.has = owner[self.word_edge]
        rng = np.random.default_rng(seed)
        self.embed = (rng.random((len(self.used), dim)) - 0.5).astype(np.float32) / dim
        self.out = ((rng.random((dim, classes)) - 0.5) / dim).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)
        self.state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.embed, self.out, self.bias)]
        self.step = 0

    @staticmethod
    def _runs(values: np.ndarray, edge: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
        """Sums of runs of rows that begin at ``edge``, put at rows ``at`` of n."""
        out = np.zeros((n, values.shape[1]), np.float32)
        if len(edge):
            out[at] = np.add.reduceat(values, edge, axis=0)
        return out

    def logits(self) -> tuple[np.ndarray, np.ndarray]:
        """(mean vector, logits) of each distinct word."""
        mean = self._runs(self.embed[self.slot], self.word_edge, len(self.size), self.has) / self.size
        return mean, mean @ self.out + self.bias

    def fit(self, label: np.ndarray, weight: np.ndarray, epochs: int, rate: float = 0.1, decay: float = 1e-6) -> None:
        """``label`` and ``weight`` are of the words of the texts, one after another."""
        classes = self.out.shape[1]
        cell = np.bincount(self.word * classes + label, weight / weight.sum(), len(self.size) * classes).reshape(-1, classes).astype(np.float32)
        total = cell.sum(1, keepdims=True)
        for _ in range(epochs):
            mean, z = self.logits()
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p * total - cell
            g_word = (g @ self.out.T) / self.size
            g_embed = self._runs(g_word[self.by_slot], self.slot_edge, len(self.used), np.arange(len(self.used))) + decay * self.embed
            self.step += 1
            for p_, g_, s in zip((self.embed, self.out, self.bias), (g_embed, mean.T @ g, g.sum(0)), self.state, strict=True):
                s[0] += 0.1 * (g_ - s[0])
                s[1] += 0.001 * (g_ * g_ - s[1])
                p_ -= rate * (s[0] / (1 - 0.9**self.step)) / (np.sqrt(s[1] / (1 - 0.999**self.step)) + 1e-8)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each table row and class, bias): n-grams never met in training score 0."""
        full = np.zeros((1 << BITS, self.out.shape[1]), np.float32)
        full[self.used] = self.embed @ self.out
        return full, self.bias.copy()
