"""Word n-gram sets and their MinHash sketches, vectorised with numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"\w+")
_CACHE_WORDS = 120_000


class WordHashes(dict):
    """64-bit hash of a word, remembered between documents and dropped whole when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = WordHashes()


def forget() -> None:
    _hashes.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_ids(text: str) -> np.ndarray:
    """Hashes of the lower-cased words of a text, in text order."""
    words = _WORD.findall(text.lower())
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def ngram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; a text with fewer words is one run of all its words."""
    if not len(ids):
        return ids
    n = min(n, len(ids))
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
    return mix(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; empty for a null text or one without words."""
    if not text:
        return np.empty(0, np.uint64)
    out = ngram_hashes(word_ids(text), n)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) else out


def sketch(shingles: np.ndarray, size: int) -> np.ndarray:
    """MinHash sketch of ``size`` 16-bit values by rounds of binning.

    In each round every shingle falls with a fresh hash into one of the bins; a bin keeps its smallest
    value of the earliest round that reached it. Two sets agree in a bin with a probability equal to
    their Jaccard similarity, and about size * ln(size) hashes are computed however large the set.
    """
    low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    if not len(shingles):
        return np.zeros(size, np.uint16)
    block = max(1, -(-2 * size // len(shingles)))
    at = 0
    while True:
        rounds = np.arange(at, at + block, dtype=np.uint64)
        h = mix(shingles[:, None] + mix(rounds + np.uint64(1))[None, :])
        bins = ((h >> np.uint64(40)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(low, bins.ravel(), ((h & np.uint64(0xFFFFFFFFFF)) + (rounds << np.uint64(40))[None, :]).ravel())
        at += block
        # a few shingles miss a bin for long, so the rounds go on until every bin is reached
        if (low < np.iinfo(np.uint64).max).all():
            break
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
