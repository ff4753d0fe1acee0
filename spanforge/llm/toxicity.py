"""Toxicity of texts after noisy-channel deobfuscation.

Leetspeak, spacing and repetition make a character lattice; Viterbi decoding under a character language model
of the corpus picks the likeliest reading, and the restored words are scored by a classifier of labelled
documents. A word without such marks has a lattice of one path and is its own reading.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import map_batches, take_memory

#: Labelled documents, at most, on which the classifier is fitted: those of smallest hash of doc_id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
THRESHOLD = 0.5
ORDER = 4
_CACHE = 200_000
#: Distinct words whose character runs are counted at once, and results that are held before they are added up.
_FOLD, _HELD = 80_000, 8
_WORD = re.compile(r"[^\W\d_]+")
#: What a symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Marks that may be put between letters.
GAPS = " .-_*~'’·"
_READ, _BREAK = math.log(0.5), math.log(0.5)
_JOIN, _SPLIT = math.log(0.9), math.log(0.1)
_ONE, _TWO = math.log(0.6), math.log(0.4)
#: Costs of reading a run of signs once or twice, or as often as it stands there.
_SHARE = (math.log(0.4), math.log(0.2))
_SYMBOLS = "".join(re.escape(x) for x in LEET)
_GAP = "[" + re.escape(GAPS) + "]"
#: Three single characters or more with gaps between them, one of the gaps in a row or several.
_SPACED = re.compile(rf"(?<![^\s])(?:[^\W_]|[{_SYMBOLS}])(?:{_GAP}+(?:[^\W_]|[{_SYMBOLS}])){{2,}}(?![^\s.,;:!?])")
_SUSPECT = re.compile(rf"[{_SYMBOLS}]|([^\W\d_])\1\1|[^\W\d_]{_GAP}[^\W\d_]")
_LETTER = re.compile(r"[^\W\d_]")
#: Plain numbers, amounts and dates: nobody reads words in them.
_NUMBER = re.compile(r"[-+$€£(]*\d[\d.,:/+-]*[%€£$)]*")
_EDGE = re.compile(r"^(?:([^\w\s@$|+(€£])\1{2,}|[\"«»“”#%&,;:?)\]}>])+|(?:([^\w\s@$|+(€£])\2{2,}|[\"«»“”#%&,;:?!.)\]}>])+$")


_scorers: dict[str, Scorer] = {}


#: Bits of a character: histories of ORDER - 1 of them are exact in 63 bits.
_BITS = 21
_CODE = (1 << _BITS) - 1
_BLANK = 32
_START = sum(_BLANK << (_BITS * k) for k in range(ORDER - 1))
_HISTORY = (1 << (_BITS * (ORDER - 1))) - 1


def _summed(heads: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (history, character), in their order."""
    order = np.lexsort((codes, heads))
    heads, codes, counts = heads[order], codes[order], counts[order]
    if not len(heads):
        return heads, codes, counts
    first = np.flatnonzero(np.concatenate(([True], (heads[1:] != heads[:-1]) | (codes[1:] != codes[:-1]))))
    return heads[first], codes[first], np.add.reduceat(counts, first)


def ngram_counts(words: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters after each history of ORDER - 1 of them in words, which have blanks before and one behind: histories, characters, counts."""
    if not words:
        return (np.empty(0, np.int64),) * 3
    pad = " " * (ORDER - 1)
    padded = [pad + w + " " for w in words]
    x = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(p) for p in padded])
    head = np.zeros(len(x) - ORDER + 1, np.int64)
    for k in range(ORDER - 1):
        head = (head << _BITS) | x[k : len(x) - ORDER + 1 + k]
    # a run that ends in the blanks before the next word is no run of this one
    last = x[ORDER - 1 :]
    real = (last != _BLANK) | (x[ORDER - 2 : -1] != _BLANK)
    return _summed(head[real], last[real], weight[ORDER - 1 :][real])


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _summed(*(np.concatenate(x) for x in zip(*parts)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_memory("toxicity", _scorers.clear)
    words: Counter = Counter()
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for text in batch.column("text").to_pylist():
            words.update(text.lower().split())
            if len(words) > _FOLD:
                parts.append(ngram_counts(words))
                words.clear()
                if len(parts) > _HELD:
                    parts = [_added(parts)]
    heads, codes, counts = _added([*parts, ngram_counts(words)])
    yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(codes.astype(np.int32)), pa.array(counts)], ["head", "code", "n"])


def character_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters after histories in the words of all documents, with their counts.

    Distinct runs of four characters come to the driver: their number follows the alphabets of a corpus, with the
    power 0.3 of its size in measured tables, and each is 20 bytes there and in a worker.
    """
    rows = docs.where("text is not null").select("text").mapInArrow(_count, "head bigint, code int, n bigint").groupBy("head", "code").agg(F.sum("n").alias("n")).toArrow()
    return _summed(rows.column("head").to_numpy(), rows.column("code").to_numpy().astype(np.int64), rows.column("n").to_numpy())


class CharacterModel:
    """Character probabilities after a history, interpolated from the full order down to single characters.

    Every order is a sorted array, not a dictionary, so that a worker holds few bytes a run.
    """

    def __init__(self, heads: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
        self.levels = []
        for order in range(1, ORDER + 1):
            h, c, n = _summed(heads & ((1 << (_BITS * (order - 1))) - 1), codes, counts)
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
            totals = np.add.reduceat(n, first) if len(h) else n
            self.levels.append((h[first], np.append(first, len(h)), totals, c.astype(np.int32), n))
        self.known: dict[tuple[int, int], float] = {}

    def log_probability(self, history: int, code: int) -> float:
        """``history`` holds the last ORDER - 1 codes."""
        at = (history, code)
        if at not in self.known:
            p = 1 / 4096
            for order, (heads, first, totals, codes, counts) in enumerate(self.levels, 1):
                head = history & ((1 << (_BITS * (order - 1))) - 1)
                k, n, total = int(heads.searchsorted(head)), 0, 0
                if k < len(heads) and heads[k] == head:
                    total = int(totals[k])
                    j = int(first[k] + codes[first[k] : first[k + 1]].searchsorted(code))
                    n = int(counts[j]) if j < first[k + 1] and codes[j] == code else 0
                p = (n + 5 * p) / (total + 5)
            if len(self.known) > _CACHE:
                self.known.clear()
            self.known[at] = math.log(p)
        return self.known[at]


def lattice(span: str, breaks: bool = True) -> list[list[tuple[str, float]]]:
    """Readings of every place of a span with their channel costs. A run of three or more equal letters, or signs, is
    one place. With ``breaks`` a sign may also stand between words."""
    out: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(span):
        c = span[k]
        run = k + 1
        while run < len(span) and span[run] == c:
            run += 1
        if c in LEET:
            each = [*((x, _READ - math.log(len(LEET[c]))) for x in LEET[c]), *([(" ", _BREAK)] if breaks else [])]
            # a long run is a repetition of one sign, or each of its signs is meant
            out.extend([each] * (run - k) if run - k < 3 else [[(x * n, s + _SHARE[n > 2]) for x, s in each for n in (1, 2, run - k) if x != " " or n == 1]])
        elif c in GAPS:
            out.append([("", _JOIN), (" ", _SPLIT)])
        elif run - k >= 3:
            out.append([(c, _ONE), (c + c, _TWO)])
        elif c.isalpha():
            out.extend([[(c, 0.0)]] * (run - k))
        else:
            out.append([(" ", 0.0)])
        k = run
    return out


def _spelt(node: tuple | None) -> str:
    out = []
    while node is not None:
        node, c = node
        out.append(c)
    return "".join(reversed(out))


def decode(span: str, model: CharacterModel, breaks: bool = True) -> str:
    """The likeliest reading of a span, words apart by single blanks. Viterbi over character histories; ties go to the reading that sorts first."""
    # a reading is a chain of its characters from the last one back, so that a long span isn't copied at every place
    best: dict[int, tuple[float, tuple | None]] = {_START: (0.0, None)}
    for place in [*lattice(span, breaks), [(" ", 0.0)]]:
        after: dict[int, tuple[float, tuple | None]] = {}
        for history, (score, chain) in best.items():
            for reading, cost in place:
                h, s, t = history, score + cost, chain
                for c in reading:
                    if c == " " and h & _CODE == _BLANK:
                        continue
                    code = ord(c)
                    s += model.log_probability(h, code)
                    h, t = (_START if c == " " else ((h << _BITS) | code) & _HISTORY), (t, c)
                old = after.get(h)
                if old is None or s > old[0] + 1e-12 or (abs(s - old[0]) <= 1e-12 and _spelt(t) < _spelt(old[1])):
                    after[h] = (s, t)
        best = after
    return max(((s, _spelt(t)) for s, t in best.values()))[1].strip()


def restored_words(token: str, model: CharacterModel) -> list[str]:
    """Words of a lower-case token, read through the channel if it has marks of it."""
    core = _EDGE.sub("", token)
    if core and _SUSPECT.search(core) and not _NUMBER.fullmatch(core):
        # a token of signs alone is read as a word or not at all: breaks at each of them would always be likelier
        return [*_WORD.findall(token), *decode(core, model, bool(_LETTER.search(core))).split()]
    return _WORD.findall(token)


def word_features(word: str) -> list[str]:
    """The word and its leading letters, which join the forms of one stem."""
    return [word, *("^" + word[:k] for k in (4, 5, 6) if len(word) > k)]


def _stem(feature: str) -> str:
    return feature.lstrip("^")


def fit(texts: list[str], toxic: list[int]) -> tuple[dict[str, float], float]:
    """Weights of features, and the bias of a document without any.

    Candidates are features ten times likelier in toxic documents. By greedy cover, the one is chosen next that
    is in most toxic documents with fewer than two chosen features, so that words which explain the labels are
    taken and their chance companions aren't. Weights are smoothed log-odds, as in naive Bayes.
    """
    kept = sorted({t: y for t, y in sorted(zip(texts, toxic))}.items())
    n1 = sum(y for _, y in kept)
    n0 = len(kept) - n1
    if not n1 or not n0:
        return {}, 0.0
    of = lambda t: {f for w in set(_WORD.findall(t.lower())) for f in word_features(w)}
    positive: Counter = Counter()
    for t, y in kept:
        if y:
            positive.update(of(t))
    least = max(4, -(-n1 // 200))
    candidates = {f for f, c in positive.items() if c >= least}
    negative: Counter = Counter()
    for t, y in kept:
        if not y:
            negative.update(of(t) & candidates)
    odds = {f: math.log((positive[f] + 0.5) / (n1 + 1) * (n0 + 1) / (negative[f] + 0.5)) for f in candidates}
    good = {f for f in candidates if odds[f] >= math.log(10)}
    open_ = [of(t) & good for t, y in kept if y]
    had = [0] * len(open_)
    left = Counter(f for h in open_ for f in h)
    chosen: dict[str, float] = {}
    while left:
        # ties: the purer, then the longer, whole words first
        best = max(left, key=lambda f: (left[f], odds[f], not f.startswith("^"), len(f), f))
        if left[best] < least:
            break
        chosen[best] = odds[best]
        for k, h in enumerate(open_):
            if best in h:
                had[k] += 1
                same = {f for f in h if _stem(f).startswith(_stem(best)) or _stem(best).startswith(_stem(f))}
                h -= same
                left.subtract(same)
                if had[k] == 2:
                    left.subtract(h)
                    h.clear()
        left = +left
    # frequent and pure features are no chance companions, also where others already explain their documents
    whole: Counter = Counter()
    for f in good:
        if not f.startswith("^"):
            for prefix in word_features(f)[1:]:
                whole[prefix] = max(whole[prefix], positive[f])
    for f in sorted(good):
        # leading letters only where they join several forms
        if positive[f] * 20 >= n1 and positive[f] >= 5 and odds[f] >= math.log(50) and positive[f] >= 1.5 * whole[f]:
            chosen[f] = odds[f]
    return chosen, -0.65 * max(chosen.values(), default=0.0)


def fitted(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> tuple[tuple[dict[str, float], float], dict[str, tuple[dict[str, float], float]]]:
    """Classifier of the labelled documents, and one of each language that has features of its own.

    Of several labels of a document a toxic one counts. Within its language a word is as rare in clean
    documents, and as frequent in toxic ones, as its readers know it; pooled, a large language hides that.
    """
    each = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = each.where("toxic = 1").orderBy(*order).limit(sample_toxic).unionByName(each.where("toxic = 0").orderBy(*order).limit(sample_clean))
    # one text of each id, picked by hash, so that repeated ids don't add to the sample
    texts = docs.where("text is not null").select("doc_id", "text", _language(docs)).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "text", "lang")).alias("x"))
    rows = one.select("x.text", "toxic", "x.lang").toArrow()
    triples = sorted(zip(*(rows.column(c).to_pylist() for c in ("text", "toxic", "lang"))), key=lambda x: (*x[:2], x[2] or ""))
    by_language = {x: fit(*zip(*((t, y) for t, y, z in triples if z == x))) for x in sorted({z for *_, z in triples if z is not None})}
    return fit([t for t, *_ in triples], [y for _, y, _ in triples]), {x: m for x, m in by_language.items() if m[0]}


def _language(docs: DataFrame) -> Column:
    """The stated language of a document; null in a table without languages."""
    return (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang")


class Scorer:
    """Weights of the features that a text has after restoring it; tokens are remembered.

    A text of a language with a classifier of its own has the higher of its and the common one's score.
    """

    def __init__(self, counts: tuple[np.ndarray, np.ndarray, np.ndarray], weights: dict[str, float], bias: float, by_language: dict[str, tuple[dict[str, float], float]] | None = None) -> None:
        self.model, self.weights, self.bias = CharacterModel(*counts), weights, bias
        self.by_language = by_language or {}
        self.features = set(weights).union(*(w for w, _ in self.by_language.values()))
        self.cache: dict[str, tuple[str, ...]] = {}

    def hits(self, token: str) -> tuple[str, ...]:
        """Words of a token that have a feature of any classifier."""
        return tuple(w for w in restored_words(token, self.model) if not self.features.isdisjoint(word_features(w)))

    def word(self, word: str, weights: dict[str, float]) -> list[str]:
        """The feature of most weight of a word, if it has any."""
        return sorted((f for f in word_features(word) if f in weights), key=lambda f: (-weights[f], f))[:1]

    def score(self, text: str, lang: str | None = None) -> tuple[float, list[str]]:
        """Probability of being toxic, and the features that speak for it."""
        if len(self.cache) > _CACHE:
            self.cache.clear()
        text = text.lower()
        tokens = set(text.split())
        for t in tokens:
            if t not in self.cache:
                self.cache[t] = self.hits(t)
        words = {w for hits in map(self.cache.__getitem__, tokens) if hits for w in hits}
        for m in _SPACED.finditer(text):
            words.update(decode(m[0], self.model).split())
        best = None
        for weights, bias in [(self.weights, self.bias), *([self.by_language[lang]] if lang in self.by_language else [])]:
            terms = sorted({f for w in words for f in self.word(w, weights)})
            z = bias + sum(weights[f] for f in terms)
            # a classifier without features knows nothing
            if best is None or (weights and (z > best[0] or not self.weights)):
                best = z, terms
        return 1 / (1 + math.exp(-min(max(best[0], -30), 30))), best[1]


def _scorer(token: str, shared) -> Scorer:
    """The scorer of a run, kept by the worker for its later tasks."""
    take_memory("toxicity", _scorers.clear)
    if token not in _scorers:
        _scorers.clear()
        _scorers[token] = Scorer(*shared.value)
    return _scorers[token]


def _model(docs: DataFrame, labels: DataFrame, sample_toxic: int, sample_clean: int):
    counts = character_counts(docs)
    (weights, bias), by_language = fitted(docs, labels, sample_toxic, sample_clean)
    return uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((counts, weights, bias, by_language))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> DataFrame:
    """(doc_id, toxicity, is_toxic, terms) of every document.

    The character model counts all documents; the classifier is fitted on at most ``sample_toxic`` and
    ``sample_clean`` documents of ``labels`` (doc_id, toxic), and again on those of each ``lang``, if there is
    such a column; the higher score counts. ``terms`` are the words, or with a caret the
    leading letters of words, that the score rests on. Without toxic or clean labels nothing is toxic.

    A null text has null toxicity and terms and isn't toxic; an empty one has no terms. Texts of any length are
    scored whole; of equally likely readings the first in order counts. Repeated rows and null ids are kept, other columns are ignored, and an empty table gives no rows.
    """
    token, shared = _model(docs, labels, sample_toxic, sample_clean)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _scorer(token, shared)
        rows = [(None, None) if t is None else s.score(t, x) for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())]
        scores = [x for x, _ in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([x is not None and bool(s.features) and x >= threshold for x in scores], pa.bool_()), pa.array([t for _, t in rows], pa.list_(pa.string()))],
            ["doc_id", "toxicity", "is_toxic", "terms"],
        )

    return map_batches(docs.select("doc_id", "text", _language(docs)), run, "doc_id bigint, toxicity double, is_toxic boolean, terms array<string>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> DataFrame:
    """The documents, with all their columns, that ``toxicity`` doesn't call toxic; null texts stay."""
    token, shared = _model(docs, labels, sample_toxic, sample_clean)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _scorer(token, shared)
        langs = batch.column("lang").cast(pa.string()).to_pylist() if "lang" in batch.schema.names else [None] * batch.num_rows
        return batch.filter(pa.array([t is None or not s.features or s.score(t, x)[0] < threshold for t, x in zip(batch.column("text").to_pylist(), langs)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
