"""Words as bags of character n-grams: hashed features of many words at once, and sparse means over them."""

from __future__ import annotations

import string

import numpy as np

from .common import mix64

_EDGE = string.punctuation + "«»“”„’‘…–—¡¿"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def features(words: list[str], grams: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket): the hashed byte n-grams of each word between < and >, and the word itself; punctuation at its ends is off."""
    raw = [b"<" + (w.strip(_EDGE) or w).encode("utf-8", "replace") + b">" for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(buf))  # bytes from here to the word's end
    owners, found = [], []
    rolling = np.zeros(len(buf), np.uint64)
    for n in range(1, max(grams) + 1):
        m = len(buf) - n + 1
        if m <= 0:
            break
        rolling = rolling[:m] * np.uint64(0x100000001B3) + buf[n - 1 :] + np.uint64(1)
        if n in grams:
            inside = left[:m] >= n
            owners.append(owner[:m][inside])
            found.append(mix64(rolling[inside] ^ np.uint64(n << 56)))
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(raw) else np.zeros(0, np.int64)
    # the whole word: a position-weighted sum of its bytes
    place = np.arange(len(buf)) - np.repeat(start, size)
    whole = np.add.reduceat(mix64(buf * np.uint64(257) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), start) if len(raw) else np.zeros(0, np.uint64)
    owners.append(np.arange(len(raw)))
    found.append(mix64(whole))
    return np.concatenate(owners), (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)


def word_means(owner: np.ndarray, bucket: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Mean of the rows of ``table`` over each word's features: (n, columns)."""
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    return np.stack([np.bincount(owner, weights=table[bucket, c], minlength=n) / count for c in range(table.shape[1])], axis=1)


def scatter_means(owner: np.ndarray, bucket: np.ndarray, grad: np.ndarray, buckets: int) -> np.ndarray:
    """The gradient of word_means for the table."""
    count = np.maximum(np.bincount(owner, minlength=len(grad)), 1)
    return np.stack([np.bincount(bucket, weights=(grad[:, c] / count)[owner], minlength=buckets) for c in range(grad.shape[1])], axis=1)


class Adam:
    def __init__(self, rate: float):
        self._rate, self._m, self._v, self._t = rate, {}, {}, 0

    def tick(self) -> None:
        self._t += 1

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
        m = self._m[name] = 0.9 * self._m.get(name, 0.0) + 0.1 * grad
        v = self._v[name] = 0.999 * self._v.get(name, 0.0) + 0.001 * grad * grad
        return value - self._rate * (m / (1 - 0.9**self._t)) / (np.sqrt(v / (1 - 0.999**self._t)) + 1e-8)


class Vocabulary:
    """Distinct words of a training sample, and each text as numbers of words."""

    def __init__(self, texts: list[str]):
        seen: dict[str, int] = {}
        self.texts = [np.fromiter((seen.setdefault(w, len(seen)) for w in words_of(t)), np.int64) for t in texts]
        self.words = list(seen)


class WordScores:
    """Memo of words' scores under a fixed bucket table; new words are hashed together, a text batch at a time."""

    def __init__(self, table: np.ndarray, grams: tuple[int, ...], limit: int = 400_000):
        self._table, self._grams, self._limit = table, grams, limit
        self._at: dict[str, int] = {}
        self._rows = np.zeros((0, table.shape[1]), np.float32)

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """One row of scores for each word of the texts, in order."""
        new = list({w for t in texts for w in t if w not in self._at})
        if new:
            if len(self._at) + len(new) > self._limit and self._at:
                self._at, self._rows = {}, self._rows[:0]
                new = list({w for t in texts for w in t})
            for i in range(0, len(new), 20_000):
                some = new[i : i + 20_000]
                owner, bucket = features(some, self._grams, len(self._table))
                self._at.update(zip(some, range(len(self._rows), len(self._rows) + len(some))))
                self._rows = np.concatenate([self._rows, word_means(owner, bucket, len(some), self._table).astype(np.float32)])
        at = self._at
        n = sum(map(len, texts))
        return self._rows[np.fromiter((at[w] for t in texts for w in t), np.int64, n)]
