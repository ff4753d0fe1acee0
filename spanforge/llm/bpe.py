"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

The leaves of the tree hold, for every token of a word, the rank of its pair with the next token; the root
yields the leftmost pair of lowest rank. A merge changes three leaves, each a point update of logarithmic
cost, until the root has no mergeable pair. Short words share numpy matrices with one tree in each row.
"""

from __future__ import annotations

import base64
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanforge.llm.common import map_batches, take_memory, vocabulary_file

VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CHUNK = re.compile(r"\s*\S+|\s+")
#: Remembered chunks at which a generation of them is full; cells of the matrices, and characters of the texts, that are encoded at once.
_CACHE, _CELLS, _CHARACTERS = 60_000, 1 << 17, 1 << 18
_INF = np.int64(1) << np.int64(60)
_NONE = (1 << 21) - 1


class SegmentTree:
    """Minimum over values at positions; ties go to the leftmost."""

    def __init__(self, values: list[int], none: int) -> None:
        self.size = 1 << max(0, (len(values) - 1).bit_length())
        self.nodes = [(none, k) for k in range(2 * self.size)]
        self.nodes[self.size : self.size + len(values)] = [(v, k) for k, v in enumerate(values)]
        for k in range(self.size - 1, 0, -1):
            self.nodes[k] = min(self.nodes[2 * k], self.nodes[2 * k + 1])

    def root(self) -> tuple[int, int]:
        return self.nodes[1]

    def update(self, at: int, value: int) -> None:
        nodes, k = self.nodes, at + self.size
        nodes[k] = (value, at)
        while k > 1:
            k //= 2
            nodes[k] = min(nodes[2 * k], nodes[2 * k + 1])


class Bpe:
    """Encoder and decoder for a vocabulary file of base64 tokens with their ranks."""

    widths = (8, 16, 32, 64)

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {k: x for x, k in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for x, rank in self.ranks.items():
            for cut in range(1, len(x)):
                a, b = self.ranks.get(x[:cut]), self.ranks.get(x[cut:])
                if a is not None and b is not None:
                    keys.append((a << 21) | b)
                    values.append(rank)
        self._table(np.array(keys, np.int64), np.array(values, np.int64))
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing over pair keys, for lookups of whole arrays."""
        bits = (4 * len(keys)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _INF, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """Ranks of pairs, for words longer than the matrices; made when the first such word comes."""
        at = self.keys != -1
        keys = self.keys[at]
        return dict(zip(zip((keys >> 21).tolist(), (keys & _NONE).tolist()), self.values[at].tolist()))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 21) | b
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _INF)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """One word of any length, with one tree."""
        ids = [int(self.byte_ids[b]) for b in word]
        if len(ids) < 2:
            return ids
        none = 1 << 60
        tree = SegmentTree([self.pairs.get(p, none) for p in zip(ids, ids[1:])], none)
        following, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        while (top := tree.root())[0] < none:
            rank, at = top
            gone = following[at]
            after, left = following[gone], before[at]
            ids[at], ids[gone] = rank, -1
            following[at] = after
            if after < len(ids):
                before[after] = at
            if gone < len(ids) - 1:
                tree.update(gone, none)
            if at < len(ids) - 1:
                tree.update(at, self.pairs.get((rank, ids[after]), none) if after < len(ids) else none)
            if left >= 0:
                tree.update(left, self.pairs.get((ids[left], rank), none))
        return [x for x in ids if x >= 0]

    def _encode_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Words of at most ``width`` bytes, a power of two; each as the bytes of its int32 ids."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        columns = np.arange(width)
        tok = np.full((n, width + 1), _NONE, np.int64)
        tok[:, :width] = np.where(columns < lengths[:, None], self.byte_ids[raw], _NONE)
        following = np.minimum(np.arange(1, width + 2), width)[None, :].repeat(n, 0)
        following = np.where(following < lengths[:, None], following, width)
        before = np.arange(-1, width)[None, :].repeat(n, 0)
        before[:, 0] = width
        tree = np.full((n, 2 * width), _INF, np.int64)
        ranks = self.pair_ranks(tok[:, :-1].ravel(), tok[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(ranks < _INF, ranks * width + columns, _INF)
        low = width // 2
        while low:
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
            low //= 2
        tok_, following_, before_, tree_ = tok.ravel(), following.ravel(), before.ravel(), tree.ravel()
        active = np.arange(n)
        while True:
            root = tree_[active * (2 * width) + 1]
            live = root < _INF
            active, root = active[live], root[live]
            if not len(active):
                break
            base, top = active * (width + 1), active * (2 * width)
            at, rank = root % width, root // width
            gone = following_[base + at]
            after, left = following_[base + gone], before_[base + at]
            tok_[base + at], tok_[base + gone] = rank, _NONE
            following_[base + at] = after
            before_[base + after] = at
            new = self.pair_ranks(rank, tok_[base + after])
            tree_[top + width + at] = np.where(new < _INF, new * width + at, _INF)
            tree_[top + width + gone] = _INF
            has = left < width
            new = self.pair_ranks(tok_[base + left], rank)
            tree_[(top + width + left)[has]] = np.where(new < _INF, new * width + left, _INF)[has]
            for node, rows in ((width + at, top), (width + gone, top), ((width + left)[has], top[has])):
                while node[:1].size and node[0] > 1:
                    node = node >> 1
                    tree_[rows + node] = np.minimum(tree_[rows + 2 * node], tree_[rows + 2 * node + 1])
        stay = (tok[:, :width] != _NONE) & (columns < lengths[:, None])
        ends = (4 * np.cumsum(stay.sum(axis=1))).tolist()
        flat = tok[:, :width][stay].astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        lower = 0
        for width in self.widths:
            at = [k for k, w in enumerate(words) if lower < len(w) <= width]
            step = _CELLS // width
            for start in range(0, len(at), step):
                part = at[start : start + step]
                for k, ids in zip(part, self._encode_rows([words[k] for k in part], width)):
                    out[k] = ids
            lower = width
        for k, w in enumerate(words):
            if len(w) > lower:
                out[k] = np.array(self.encode_word(w), "<i4").tobytes()
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as int32 bytes; texts are encoded together up to a number of characters, a longer one alone."""
        out: list[bytes] = []
        group: list[str] = []
        held = 0
        for text in texts:
            if group and held + len(text) > _CHARACTERS:
                out += self._encode_group(group)
                group, held = [], 0
            group.append(text)
            held += len(text)
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        """Ids of every text.

        Blanks after a non-blank always start a token, so a text can be cut there, and what follows up to the
        next such place is encoded once and remembered. A full generation becomes the older one, from which what
        is met again moves to the new one; so frequent chunks stay and few of the others are held.
        """
        chunks = [_CHUNK.findall(t) for t in texts]
        if len(self.cache) > _CACHE:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        missing = []
        for c in set().union(*chunks):
            if c not in cache:
                if (ids := older.get(c)) is None:
                    missing.append(c)
                else:
                    cache[c] = ids
        parts = [[x.encode("utf-8", "replace") for x in self.pattern.findall(c)] for c in missing]
        words = list(set().union(*parts))
        known = dict(zip(words, self.encode_words(words)))
        for c, p in zip(missing, parts):
            cache[c] = known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p))
        return [b"".join(map(cache.__getitem__, c)) for c in chunks]

    def decode(self, ids) -> str:
        """Text of ids; bytes that aren't UTF-8 become replacement characters, unknown ids an error."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def _lists(ids: list[bytes | None]) -> pa.Array:
    flat = np.frombuffer(b"".join(x or b"" for x in ids), "<i4")
    offsets = np.concatenate(([0], np.cumsum([len(x or b"") // 4 for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in ids]) if any(x is None for x in ids) else None)


def _encode(path: str, verify: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        take_memory("bpe", load.cache_clear)
        bpe, texts = load(path), batch.column("text").to_pylist()
        given = bpe.encode_batch([t for t in texts if t is not None])
        each = iter(given)
        ids = [next(each) if t is not None else None for t in texts]
        columns = [batch.column("doc_id"), _lists(ids), pa.array([None if x is None else len(x) // 4 for x in ids], pa.int32())]
        names = ["doc_id", "tokens", "n_tokens"]
        if verify:
            columns.append(pa.array([None if x is None else bpe.decode(np.frombuffer(x, "<i4").tolist()) == t for x, t in zip(ids, texts)], pa.bool_()))
            names.append("round_trip")
        return pa.RecordBatch.from_arrays(columns, names)

    return run


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, verify: bool = True, rows: int = 500) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) of every document.

    ``vocabulary`` is the path of a file of base64 tokens and ranks. ``round_trip`` says that decoding the
    tokens gave the text again. A null text has null tokens, count and round trip; an empty one has no tokens. Texts
    and words of any length are encoded whole. Of pairs of one rank the leftmost merges first.
    Repeated rows and null ids are kept, other columns are ignored, and an empty table gives no rows.
    """
    path = vocabulary or vocabulary_file(VOCABULARY)
    schema = "doc_id bigint, tokens array<int>, n_tokens int" + (", round_trip boolean" if verify else "")
    return map_batches(docs.select("doc_id", "text"), _encode(path, verify), schema, rows)


def with_tokens(docs: DataFrame, vocabulary: str | None = None, rows: int = 500) -> DataFrame:
    """The documents with all their columns and, in place of any of these names, ``tokens`` and ``n_tokens``."""
    path = vocabulary or vocabulary_file(VOCABULARY)
    kept = docs.drop("tokens", "n_tokens")
    encode = _encode(path, False)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = encode(batch)
        return pa.RecordBatch.from_arrays([*batch.columns, new.column("tokens"), new.column("n_tokens")], [*batch.schema.names, "tokens", "n_tokens"])

    return map_batches(kept, run, T.StructType([*kept.schema.fields, T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())]), rows)


def bpe_decode(encoded: DataFrame, vocabulary: str | None = None, rows: int = 500) -> DataFrame:
    """(doc_id, text) of rows with ``tokens``; null tokens give a null text."""
    path = vocabulary or vocabulary_file(VOCABULARY)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        take_memory("bpe", load.cache_clear)
        bpe = load(path)
        texts = [None if x is None else bpe.decode(x) for x in batch.column("tokens").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "tokens"), run, "doc_id bigint, text string", rows)
