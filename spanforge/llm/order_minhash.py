"""Document fingerprints by Order MinHash: sketches whose agreement follows edit distance, not only content.

Every k-mer of words is numbered by its occurrence, so repeats differ. Under each hash function the smallest
``length`` of them are selected and put back in text order; the hash of that tuple is one signature value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import map_batches, take_memory
from spanforge.llm.shingles import forget, mix, ngram_hashes, word_ids

K = 3
LENGTH = 2
SIZE = 64
_CELLS = 1 << 17


def multipliers(size: int, seed: int = 23) -> np.ndarray:
    """(2, size): the offset and the odd factor of every hash function."""
    out = np.random.default_rng(seed).integers(0, 2**32, (2, size), dtype=np.uint32)
    out[1] |= 1
    return out


def occurrence_numbers(x: np.ndarray) -> np.ndarray:
    """0 for the first occurrence of a value, 1 for its second, and so on."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(new)
    out = np.empty(len(x), np.uint64)
    out[order] = np.arange(len(x)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(x)]))))
    return out


def signature(text: str, k: int, length: int, factors: np.ndarray) -> np.ndarray:
    """One value for each factor; empty for a text without words."""
    kmers = ngram_hashes(word_ids(text), k)
    if not len(kmers):
        return np.empty(0, np.uint64)
    keys = (mix(kmers + occurrence_numbers(kmers) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    take = min(length, len(kmers))
    size = factors.shape[1]
    out = np.empty(size, np.uint64)
    step = max(1, _CELLS // len(kmers))
    for at in range(0, size, step):
        # two rounds, so that high bits reach low ones too
        h = (keys[None, :] ^ factors[0, at : at + step, None]) * factors[1, at : at + step, None]
        h ^= h >> np.uint32(16)
        h *= factors[1, at : at + step, None]
        rows = np.arange(len(h))
        chosen = np.empty((len(h), take), np.int64)
        for j in range(take):
            chosen[:, j] = h.argmin(axis=1)
            h[rows, chosen[:, j]] = np.iinfo(np.uint32).max
        chosen.sort(axis=1)
        value = np.zeros(len(h), np.uint64)
        for j in range(take):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + kmers[chosen[:, j]] + np.uint64(1))
        out[at : at + step] = value
    return out


def order_minhash(docs: DataFrame, k: int = K, length: int = LENGTH, size: int = SIZE) -> DataFrame:
    """(doc_id, signature) of every document; ``signature`` is an array of ``size`` hashes.

    A text of fewer than k words is one k-mer, and one with fewer than ``length`` k-mers gives tuples of all
    of them. Texts of any length are read whole. Equal k-mers are told apart by their number, so ties don't occur but
    by equal hashes, of which the first in the text counts. Null and empty texts, and those without words, have a null
    signature. Repeated rows and null ids
    are kept, other columns are ignored, and an empty table gives no rows.
    """
    factors = multipliers(size)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        take_memory("shingles", forget)
        texts = batch.column("text").to_pylist()
        values = [signature(t, k, length, factors) if t else np.empty(0, np.uint64) for t in texts]
        flat = np.concatenate(values) if values else np.empty(0, np.uint64)
        offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
        mask = pa.array([not len(v) for v in values])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)), mask=mask)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "signature"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, signature array<bigint>")


def agreement(a: Column, b: Column) -> Column:
    """Share of equal values of two signatures: an estimate of order-aware similarity; null if either is."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
