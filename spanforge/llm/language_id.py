"""Language identification by unigrams over the pieces of a fixed vocabulary, marginalised over segmentations.

A word's probability in a language is the sum, over all ways to cut it into pieces, of the products of the
pieces' probabilities there; a forward algorithm computes it. Words are independent, since no piece goes over
a blank, so each distinct word is scored once and remembered.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import take_memory, vocabulary_file

VOCABULARY = "piece_bpe_32k.model"
SMOOTHING = 0.1
_CACHE = 400_000
#: Texts whose words are looked up together.
_ROWS = 2000
#: Characters after which the forward sums are brought back to 1, so that they don't underflow.
_RESCALE = 8
#: Forward sums held at once, unless one word has more.
_CELLS = 2_000_000
_MARK = "▁"


def words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words between blanks, in lower case; the number of each word of the texts, one text after the other;
    and where each text's words begin, with the end. Characters stay as they are, as the vocabulary's own
    segmentation leaves them."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    flat = split.flatten().dictionary_encode()
    names, at = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    ends = np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy())))
    if "" in names:
        # what blanks at the ends of a text leave
        real = at != names.index("")
        ends = np.concatenate(([0], np.cumsum(real)))[ends]
        at = at[real]
    return names, at, ends


class Pieces:
    """Pieces of a SentencePiece model: number of each, and its own segmentation for the counts."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        special = [self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_byte(k) for k in range(self.size)]
        names = [self.model.id_to_piece(k) for k in range(self.size)]
        # a piece with the word mark inside would go over a blank
        self.numbers = {x: k for k, (x, out) in enumerate(zip(names, special)) if not out and _MARK not in x[1:]}
        self.longest = max(map(len, self.numbers))
        self.counted: dict[str, bytes] = {}

    def segment(self, names: list[str]) -> list[bytes]:
        """The pieces of each word as the bytes of int32 numbers; words are remembered."""
        if len(self.counted) > _CACHE:
            self.counted.clear()
        if fresh := [w for w in names if w not in self.counted]:
            self.counted.update(zip(fresh, (array("i", c).tobytes() for c in self.model.encode(fresh, num_threads=1))))
        return list(map(self.counted.__getitem__, names))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_memory("language", _release)
        p = pieces(path)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                names, each, ends = words(part.column("text"))
                langs = part.column("lang").dictionary_encode()
                of_word = np.repeat(langs.indices.to_numpy(), np.diff(ends))
                cut = p.segment(names)
                ids = np.frombuffer(b"".join(cut), np.int32)
                lengths = np.fromiter(map(len, cut), np.int64, len(cut)) // 4
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    weight = np.repeat(np.bincount(each[of_word == k], minlength=len(names)), lengths)
                    sums[lang] = sums.get(lang, 0) + np.bincount(ids, weight, p.size)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["lang", "piece", "n"])

    return run


def train(docs: DataFrame, vocabulary: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and their counts by piece, from all documents with a language and a text."""
    path = vocabulary or vocabulary_file(VOCABULARY)
    texts = docs.where("lang is not null and text is not null").select("lang", "text")
    rows = texts.mapInArrow(_count(path), "lang string, piece int, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((pieces(path).size, len(languages)))
    at = {x: k for k, x in enumerate(languages)}
    counts[rows.column("piece").to_numpy(), [at[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    return languages, counts


class Trie:
    """Pieces by their characters, as a hash table from (node, character) to the next node, for walks of whole arrays."""

    def __init__(self, numbers: dict[str, int]) -> None:
        children: dict[tuple[int, int], int] = {}
        self.piece = [-1]
        for name, number in numbers.items():
            node = 0
            for c in map(ord, name):
                following = children.get((node, c))
                if following is None:
                    following = children[node, c] = len(self.piece)
                    self.piece.append(-1)
                node = following
            self.piece[node] = number
        self.piece = np.array(self.piece, np.int64)
        bits = (4 * max(1, len(children))).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        keys = np.array([(n << 21) | c for n, c in children], np.int64)
        values = np.array(list(children.values()), np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next node of each, -1 where there is none."""
        keys = (nodes << 21) | codes
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Scorer:
    """Log-probabilities of words in every language, by the forward algorithm over many words at once."""

    def __init__(self, p: Pieces, counts: np.ndarray, smoothing: float) -> None:
        usable = np.zeros(p.size, bool)
        usable[list(p.numbers.values())] = True
        total = counts[usable].sum(axis=0) + smoothing * (usable.sum() + 1)
        # row size: an unknown character
        self.probability = np.vstack([np.where(usable[:, None], (counts + smoothing) / total, 0), smoothing / total])
        self.longest, self.unknown = p.longest, p.size
        self.trie = Trie(p.numbers)
        self.rows: dict[str, int] = {}
        self.values = np.zeros((1024, counts.shape[1]))

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in the characters of words; ``left`` counts those of the word from each on."""
        starts = np.arange(len(codes))
        nodes = np.zeros(len(codes), np.int64)
        out = []
        for k in range(1, self.longest + 1):
            stay = left[starts] >= k
            starts, nodes = starts[stay], nodes[stay]
            nodes = self.trie.step(nodes, codes[starts + k - 1])
            on = nodes >= 0
            if k == 1:
                # a character without a piece is an unknown one
                piece = np.where(on, self.trie.piece[nodes], -1)
                out.append((starts, np.full(len(starts), 1), np.where(piece >= 0, piece, self.unknown)))
            starts, nodes = starts[on], nodes[on]
            if not len(starts):
                break
            if k > 1:
                piece = self.trie.piece[nodes]
                ends = piece >= 0
                out.append((starts[ends], np.full(int(ends.sum()), k), piece[ends]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def forward(self, words: list[str]) -> np.ndarray:
        """One row a word, of any length. Every ``_RESCALE`` characters the sums are brought back to 1."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        offset = np.arange(len(codes)) - first[word]
        starts, lengths, piece = self.edges(codes, sizes[word] - offset)
        # places of the sums: one more a word than it has characters
        place = starts + word[starts]
        order = np.lexsort((lengths, offset[starts]))
        place, lengths, piece, at = place[order], lengths[order], piece[order], offset[starts[order]]
        key = at * (self.longest + 1) + lengths
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)
        alpha = np.zeros((len(codes) + len(words), self.probability.shape[1]))
        begin = first + np.arange(len(words))
        alpha[begin] = 1
        scale = np.zeros((len(words), alpha.shape[1]))
        by_size = np.argsort(-sizes, kind="stable")
        sorted_sizes = -sizes[by_size]
        last = 0
        for a, b in zip(cuts, cuts[1:]):
            i = int(at[a])
            if i != last and i % _RESCALE == 0:
                # what is behind i has been added on already, so the rest may be in units of it
                alive = by_size[: np.searchsorted(sorted_sizes, -i, side="left")]
                here = begin[alive] + i
                unit = np.where(alpha[here] > 0, alpha[here], 1)
                scale[alive] += np.log(unit)
                room = sizes[alive] - i
                for k in range(self.longest):
                    inside = room >= k
                    alpha[here[inside] + k] /= unit[inside]
            last = i
            # equal offset and length: no two of these edges end in one place
            start = place[a:b]
            alpha[start + lengths[a]] += alpha[start] * self.probability[piece[a:b]]
        return np.log(alpha[begin + sizes]) + scale

    def learn(self, words: list[str]) -> None:
        words.sort(key=len)
        cells = _CELLS // self.values.shape[1]
        at = 0
        while at < len(words):
            # words of like length, as many as the block holds
            end = at + 1
            while end < len(words) and (end + 1 - at) * (len(words[end]) + 2) <= cells:
                end += 1
            part = words[at:end]
            start = len(self.rows)
            while start + len(part) > len(self.values):
                self.values = np.vstack([self.values, np.zeros_like(self.values)])
            self.values[start : start + len(part)] = self.forward([_MARK + w for w in part])
            self.rows.update(zip(part, range(start, start + len(part))))
            at = end

    def score(self, texts: pa.Array) -> list[np.ndarray]:
        """Sum over a text's words of their log-probabilities."""
        if len(self.rows) > _CACHE:
            self.rows.clear()
        names, at, ends = words(texts)
        self.learn([w for w in names if w and w not in self.rows])
        rows = np.fromiter((self.rows.get(w, 0) for w in names), np.int64, len(names))[at]
        return [self.values[rows[a:b]].sum(axis=0) for a, b in zip(ends, ends[1:])]


_scorers: dict[str, Scorer] = {}


def _release() -> None:
    _scorers.clear()
    pieces.cache_clear()


def _scorer(token: str, path: str, counts, smoothing: float) -> Scorer:
    """The scorer of a run, kept by the worker for its later tasks."""
    take_memory("language", _release)
    if token not in _scorers:
        _scorers.clear()
        _scorers[token] = Scorer(pieces(path), counts.value, smoothing)
    return _scorers[token]


def identify_languages(docs: DataFrame, vocabulary: str | None = None, smoothing: float = SMOOTHING, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, lang, predicted, log_probability, margin) of every document.

    ``lang`` is the stated language and ``predicted`` the one of highest probability (the first by name of
    equals) under equal priors; ``margin`` is its lead over the second, in nats a character. Piece counts come
    from all documents with a stated language, with additive smoothing; ``model`` may give them instead.

    Null, empty and blank texts have null results, as have all documents when none states a language. Texts and
    words of any length are scored whole, all by the same sums. Repeated rows and null ids are kept, other columns
    are ignored, and an empty table gives no rows.
    """
    path = vocabulary or vocabulary_file(VOCABULARY)
    languages, counts = model or train(docs, path)
    schema = "doc_id bigint, lang string, predicted string, log_probability double, margin double"
    if not languages:
        return docs.select("doc_id", "lang", F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("log_probability"), F.lit(None).cast("double").alias("margin"))
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(token, path, shared, smoothing)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = [t if t and not t.isspace() else None for t in part.column("text").to_pylist()]
                each = iter(scorer.score(pa.array([t for t in texts if t is not None], pa.string())))
                out: list[list] = [[], [], []]
                for t in texts:
                    if t is None:
                        row = (None, None, None)
                    else:
                        s = next(each)
                        order = np.argsort(-s, kind="stable")
                        row = (languages[order[0]], float(s[order[0]]), float(s[order[0]] - s[order[1]]) / len(t) if len(s) > 1 else None)
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())], ["doc_id", "lang", "predicted", "log_probability", "margin"])

    return docs.select("doc_id", F.col("lang").cast("string"), "text").mapInArrow(run, schema)
