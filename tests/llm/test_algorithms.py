"""Parts of the corpus operators against brute force, without Spark."""

import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from spanforge.llm import audio_features as af
from spanforge.llm import html_extract as he
from spanforge.llm import line_templates as lt
from spanforge.llm import order_minhash as om
from spanforge.llm import toxicity as tox
from spanforge.llm.bpe import PATTERN, load
from spanforge.llm.common import vocabulary_file
from spanforge.llm.language_id import Scorer, pieces, train
from spanforge.llm.license_scan import canonical, known_digests
from spanforge.llm.license_texts import LICENSES
from spanforge.llm.ngram_jaccard import jaccard, least_matches, survivors
from spanforge.llm.shingles import shingle_set, sketch


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_sketch_estimates_jaccard():
    rng = random.Random(1)
    for share in (0.2, 0.5, 0.9):
        a = [rng.getrandbits(64) for _ in range(400)]
        b = a[: int(400 * share)] + [rng.getrandbits(64) for _ in range(400 - int(400 * share))]
        x, y = (np.array(sorted(set(v)), np.uint64) for v in (a, b))
        estimate = (sketch(x, 512) == sketch(y, 512)).mean()
        assert abs(estimate - jaccard(x, y)) < 0.1
    tiny = np.array([5, 7], np.uint64)
    assert len(sketch(tiny, 96)) == 96 and (sketch(tiny, 96) == sketch(tiny, 96)).all()
    assert len(sketch(np.empty(0, np.uint64), 8)) == 8


def test_posterior_rule_is_the_beta_tail():
    for c, least in least_matches(0.5, 0.01, 96, 16):
        grid = np.linspace(0, 1, 20001)
        for m in (least - 1, least):
            if m < 0:
                continue
            density = grid**m * (1 - grid) ** (c - m)
            tail = density[grid >= 0.5].sum() / density.sum()
            assert (tail >= 0.01) == (m >= least)


def test_pruning_keeps_similar_pairs():
    rng = random.Random(2)
    base = words(rng, 200, 5000).split()
    texts = []
    for k in range(40):
        t = list(base) if k % 2 else words(rng, 200, 5000).split()
        for _ in range(k // 4):
            t[rng.randrange(200)] = f"x{rng.random()}"
        texts.append(" ".join(t))
    sets = [shingle_set(t, 3) for t in texts]
    near = {(i, j) for i, j in itertools.combinations(range(40), 2) if jaccard(sets[i], sets[j]) >= 0.5}
    sk = np.stack([sketch(s, 96) for s in sets])
    every = np.arange(40)
    found = {(int(a), int(b)) for a, bs in survivors(every, every, sk, np.array([len(s) for s in sets]), 0, 3, least_matches(0.5, 0.005, 96, 16), 0.5) for b in bs}
    assert len(near & found) >= 0.97 * len(near) and len(found) < 780


def test_order_minhash_against_a_plain_version():
    rng = random.Random(3)
    factors = om.multipliers(16)
    for n in (1, 2, 3, 5, 40):
        text = words(rng, n, 4)
        kmers = om.ngram_hashes(om.word_ids(text), 3)
        seen, keys = Counter(), []
        for x in kmers.tolist():
            keys.append(int(om.mix(np.array([(x + seen[x] * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]) >> 32)
            seen[x] += 1
        expected = []
        for offset, factor in factors.T.tolist():
            first = [((x ^ offset) * factor) % 2**32 for x in keys]
            hashes = [((x ^ (x >> 16)) * factor) % 2**32 for x in first]
            ranked = sorted(range(len(keys)), key=lambda k: (hashes[k], k))[: min(2, len(keys))]
            value = np.zeros(1, np.uint64)
            for k in sorted(ranked):
                value = om.mix(value * np.uint64(0x9E3779B97F4A7C15) + kmers[k : k + 1] + np.uint64(1))
            expected.append(int(value[0]))
        assert om.signature(text, 3, 2, factors).tolist() == expected
    assert len(om.signature("", 3, 2, factors)) == 0 and len(om.signature("...", 3, 2, factors)) == 0


def test_order_minhash_sees_order():
    rng = random.Random(4)
    f = om.multipliers(64)
    halves = words(rng, 300, 3000).split()
    swapped = " ".join(halves[150:] + halves[:150])
    same = om.signature(" ".join(halves), 3, 2, f)
    edited = " ".join(halves[:5] + ["new"] + halves[6:])
    assert (om.signature(edited, 3, 2, f) == same).mean() > (om.signature(swapped, 3, 2, f) == same).mean() + 0.2


def encoding():
    bpe = load(vocabulary_file("byte_bpe_50k.tiktoken"))
    return bpe, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_bpe_equals_the_library():
    bpe, library = encoding()
    rng = random.Random(5)
    texts = ["", " ", "  a  b\n\n c ", "naïve ÉTÉ 日本語 🙂!!", "don't we'll I'M", "a" * 500, "ab" * 300, "\t x\r\n\r\n y  "]
    texts += ["".join(rng.choice("abcde  \n.'1é日") for _ in range(rng.randrange(200))) for _ in range(150)]
    for text, ids in zip(texts, bpe.encode_batch(texts)):
        ids = np.frombuffer(ids, "<i4").tolist()
        assert ids == library.encode_ordinary(text), text
        assert bpe.decode(ids) == text
    drawn = [bytes(rng.randrange(97, 103) for _ in range(rng.randrange(80))) for _ in range(200)]
    assert [np.frombuffer(x, "<i4").tolist() for x in bpe.encode_words(drawn)] == [bpe.encode_word(w) for w in drawn] == [library._encode_single_piece(w) if w else [] for w in drawn]


def test_bpe_remembers_a_bounded_number_of_chunks_within_one_call():
    bpe, library = encoding()
    texts = [" ".join(f"{k:x}q{j:x}" for j in range(3000)) for k in range(100)] + ["w" * 300_000 + " z", ""]
    out = bpe.encode_batch(texts)
    assert len(bpe.cache) + len(getattr(bpe, "older", ())) < 200_000
    assert len(out) == len(texts)
    for k in (0, 1, 50, 99, 101):
        assert np.frombuffer(out[k], "<i4").tolist() == library.encode_ordinary(texts[k])
    assert bpe.decode(np.frombuffer(out[100], "<i4").tolist()) == texts[100]
    assert bpe.encode_batch(texts[:3]) == out[:3] and bpe.encode_batch([]) == []


def test_forward_sums_all_segmentations():
    p = pieces(vocabulary_file("piece_bpe_32k.model"))
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 1000, (p.size, 3)).astype(float)
    scorer = Scorer(p, counts, 0.1)

    def brute(word):
        if not word:
            return np.ones(3)
        total = np.zeros(3)
        for k in range(1, len(word) + 1):
            piece = word[:k]
            number = p.numbers.get(piece, p.size if k == 1 else None)
            if number is not None:
                total = total + scorer.probability[number] * brute(word[k:])
        return total

    for word in ("▁the", "▁été", "▁zq☃x", "▁under"):
        assert np.allclose(scorer.forward([word])[0], np.log(brute(word)))
    long = "▁" + "abc☃" * 40
    assert np.isfinite(scorer.forward([long])).all()


def forward_logs(scorer, p, word):
    """The forward sums in logarithms, character by character."""
    logs = np.log(np.maximum(scorer.probability, 1e-300))
    alpha = [np.zeros(logs.shape[1])]
    for j in range(1, len(word) + 1):
        best = np.full(logs.shape[1], -np.inf)
        for i in range(max(0, j - p.longest), j):
            number = p.numbers.get(word[i:j], p.size if j == i + 1 else None)
            if number is not None:
                best = np.logaddexp(best, alpha[i] + logs[number])
        alpha.append(best)
    return alpha[-1]


def test_forward_of_unseen_characters_does_not_underflow():
    p = pieces(vocabulary_file("piece_bpe_32k.model"))
    for n in (1e3, 1e6, 1e11):
        scorer = Scorer(p, np.random.default_rng(7).integers(0, n, (p.size, 3)).astype(float), 0.1)
        tests = [w for k in (7, 8, 9, 33, 35, 39, 45, 58, 59, 60, 61, 62, 400) for w in ("▁" + "\ue000" * k, "▁" + ("the☃under" * 60)[:k])]
        for word, got in zip(tests, scorer.forward(tests)):
            assert np.isfinite(got).all() and np.allclose(got, forward_logs(scorer, p, word))
    assert np.allclose(scorer.score(pa.array(["the été the"]))[0], 2 * scorer.forward(["▁the"])[0] + scorer.forward(["▁été"])[0])
    assert np.allclose(scorer.score(pa.array([" five  été ", "five été\n"]))[0], scorer.score(pa.array(["five été"]))[0])
    assert p.model.normalize("ﬁ É") == "▁ﬁ▁É"
    total = scorer.probability[list(p.numbers.values())].sum(axis=0) + scorer.probability[p.size]
    assert np.allclose(total, 1)


def test_piece_counts_against_plain_sums(spark):
    p = pieces(vocabulary_file("piece_bpe_32k.model"))
    rows = [("xx", "The house in the garden, a ☃!"), ("yy", "Ein Haus"), ("xx", "the the"), (None, "no language"), ("yy", None), ("yy", "")]
    languages, counts = train(spark.createDataFrame(rows, "lang string, text string"))
    assert languages == ["xx", "yy"]
    for k, lang in enumerate(languages):
        expected = Counter(i for x, t in rows if x == lang and t for w in t.lower().split() for i in p.model.encode(w))
        assert {int(i): int(counts[i, k]) for i in np.flatnonzero(counts[:, k])} == expected


def character_model(text="idiot loser stupid trash hello world this is a tool ".split()):
    return tox.CharacterModel(*tox.ngram_counts(Counter({w: 20 for w in text})))


def test_ngram_counts():
    got = {(h, c): n for h, c, n in zip(*(x.tolist() for x in tox.ngram_counts(Counter({"ab": 2, "b": 1}))))}
    head = lambda s: sum(ord(c) << (21 * (2 - k)) for k, c in enumerate(s))
    run = lambda s: (head(s[:3]), ord(s[3]))
    assert got == {run("   a"): 2, run("  ab"): 2, run(" ab "): 2, run("   b"): 1, run("  b "): 1}


def test_counts_of_many_folds(monkeypatch):
    rng = random.Random(17)
    texts = [" ".join("".join(rng.choice("abc日本é🙂") for _ in range(rng.randrange(1, 6))) for _ in range(30)) for _ in range(40)]
    monkeypatch.setattr(tox, "_FOLD", 20)
    monkeypatch.setattr(tox, "_HELD", 2)
    (batch,) = tox._count(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    expected = Counter()
    for t in texts:
        for w in t.split():
            padded = f"   {w} "
            for k in range(len(padded) - 3):
                expected[sum(ord(c) << (21 * (2 - j)) for j, c in enumerate(padded[k : k + 3])), ord(padded[k + 3])] += 1
    assert dict(zip(zip(*(batch.column(c).to_pylist() for c in ("head", "code"))), batch.column("n").to_pylist())) == expected
    model = tox.CharacterModel(*(batch.column(c).to_numpy().astype(np.int64) for c in ("head", "code", "n")))

    def plain(history, code):
        p = 1 / 4096
        for order in range(4):
            tail = history & ((1 << (21 * order)) - 1)
            same = {c: 0 for _, c in expected}
            for (h, c), n in expected.items():
                if h & ((1 << (21 * order)) - 1) == tail:
                    same[c] += n
            p = (same.get(code, 0) + 5 * p) / (sum(same.values()) + 5)
        return math.log(p)

    start = sum(32 << (21 * k) for k in range(3))
    for history in (start, start & ~0x1FFFFF | ord("日"), ord("é") << 21 | ord("a"), 5):
        for code in map(ord, "日本a z"):
            assert math.isclose(model.log_probability(history, code), plain(history, code))
    assert model.log_probability(start, ord("日")) != model.log_probability(start, ord("本"))


def test_viterbi_against_all_readings():
    model = character_model()

    def value(text, cost):
        start = sum(32 << (21 * k) for k in range(3))
        history, score = start, cost
        for c in text + " ":
            if c == " " and history & 0x1FFFFF == 32:
                continue
            score += model.log_probability(history, ord(c))
            history = start if c == " " else ((history << 21) | ord(c)) & (2**63 - 1)
        return score

    for span in ("1d10t", "l.o.s.e.r", "tr@sh", "stuuupid", "h3110", "s t u p 1 d", "a1b", "lo$$$er", "1111d10t", "@$$"):
        readings = {}
        for path in itertools.product(*tox.lattice(span)):
            text = "".join(r for r, _ in path)
            clean = " ".join(text.split())
            readings[clean] = max(readings.get(clean, -math.inf), value(text, sum(c for _, c in path)))
        best = max(readings.values())
        got = tox.decode(span, model)
        assert math.isclose(readings[got], best, abs_tol=1e-9), span
    assert tox.decode("1d10t", model) == "idiot" and tox.decode("s.t.u.p.1.d", model) == "stupid" and tox.decode("lo$$$$$er", model) == "loser"
    assert tox.restored_words("plain,", model) == ["plain"]
    ass = character_model(["ass", "assess", "was"])
    assert tox.restored_words("@$$", ass) == ["ass"] == tox.restored_words("@$$$$$$$", ass)
    assert tox.restored_words("$455.00", ass) == [] == tox.restored_words("2020-01-05", ass)


def test_toxicity_classifier_on_held_out_texts():
    rng = random.Random(7)
    bad = [f"{stem}{end}" for stem in ("grumf", "blarg", "snork") for end in ("", "al", "os")]

    def make(y):
        body = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}o" for _ in range(60)]
        body = ["".join(chr(97 + int(d)) if d.isdigit() else d for d in w) for w in body]
        for _ in range(3 * y):
            body[rng.randrange(60)] = rng.choice(bad)
        return " ".join(body)

    labels = [k % 5 == 0 for k in range(1000)]
    texts = [make(int(y)) for y in labels]
    weights, bias = tox.fit(texts[:600], [int(y) for y in labels[:600]])
    scorer = tox.Scorer(tox.ngram_counts(Counter(w for t in texts for w in t.split())), weights, bias)
    right = sum((scorer.score(t)[0] >= 0.5) == y for t, y in zip(texts[600:], labels[600:]))
    assert right >= 0.98 * 400
    assert scorer.score("what a gr+umf and a bl@rg sn0rk")[0] >= 0.5
    assert tox.fit(["a"], [1]) == ({}, 0.0) and tox.fit([], []) == ({}, 0.0)


def test_minimum_cut_against_all_labellings():
    rng = random.Random(8)
    for _ in range(120):
        n = rng.randrange(1, 9)
        source, sink = ([rng.randrange(20) for _ in range(n)] for _ in range(2))
        links = [(i, j, rng.randrange(1, 15)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(side):
            return sum(t if s else c for s, c, t in zip(side, source, sink)) + sum(c for i, j, c in links if side[i] != side[j])

        assert cost(he.minimum_cut(source, sink, links)) == min(cost(side) for side in itertools.product((False, True), repeat=n))


def test_html_blocks():
    page = "<html><head><title>no</title></head><body><nav><a href='x>y'>Home</a></nav><article><h1>Title &amp; more<p>One <b>two</b>.<p>Three<script>var t='</p>'</script></article><!-- <p>no</p> --><div class='ad'>Buy</div>tail"
    found = he.blocks(page)
    assert [b.text for b in found] == ["Home", "Title & more", "One two.", "Three", "Buy", "tail"]
    assert [b.hint for b in found] == [0, 1, 1, 1, 0, None] and found[0].links == 4
    assert he.blocks("") == [] and he.label([], he.DEFAULT) == [] and he.blocks("<p") != [] and he.blocks("a<!-- open")[0].text == "a"
    assert (he.fit([]) == he.DEFAULT).all()


def plain_paths(page):
    """Paths of a page of p, div and text without quotes or scripts, kept whole."""
    out, stack, number = [], [], 0
    for m in re.finditer(r"<(/?)(\w+)>|([^<]+)", page):
        if m[3]:
            out.append(tuple(stack))
        elif m[1]:
            if m[2] in [n for n, _ in stack]:
                while stack.pop()[0] != m[2]:
                    pass
        else:
            if m[2] == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            number += 1
            stack.append((m[2], number))
    return out


def test_paths_of_blocks():
    rng = random.Random(18)
    for _ in range(200):
        page = "".join(rng.choice(["<p>", "<div>", "</div>", "</p>", "text", "<ul>", "</ul>"]) + "x" * (rng.random() < 0.3) for _ in range(30))
        paths, found = plain_paths(page), he.blocks(page)
        assert [b.depth for b in found] == [len(p) for p in paths]
        assert [b.parent for b in found] == [p[-2][1] if len(p) > 1 else 0 for p in paths]
        for a, c, b in zip(paths, paths[1:], found[1:]):
            assert b.common == next((k for k, (x, y) in enumerate(zip(a, c)) if x != y), min(len(a), len(c)))


@pytest.mark.parametrize("unit", ["<a x<", "<a b=\"", "<a b='\"", "<div", "<script ", "<div class=x>y", "</p>", "<div>x</p>", "<p class=class=", "<!--", "<aaaa", "<div><p>", "\"<a '"])
def test_broken_markup_takes_linear_time(unit):
    start = time.perf_counter()
    he.blocks(unit * (1_000_000 // len(unit)))
    he.blocks("<a " + unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - start < 20


def test_resampling_and_spectrum():
    t = np.arange(4000) / 8000
    x = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    y = af.resample(x, 8000, 16000)
    assert len(y) == 8000
    inner = slice(200, 7800)
    assert np.abs(y[inner] - np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)[inner]).max() < 1e-2
    for up, down in ((3, 2), (2, 3), (160, 441)):
        taps = af.resampling_filter(up, down)
        fine = np.zeros(len(x[:300]) * up)
        fine[::up] = x[:300]
        full = np.convolve(fine, taps)[len(taps) // 2 :]
        got = af.resample(x[:300], down * 100, up * 100)
        expected = full[: len(got) * down : down]
        assert np.allclose(got[: len(expected)], expected, atol=1e-4)
    values, energy = af.log_mel(y)
    assert values.shape == (1 + math.ceil((8000 - 400) / 160), 40) and len(energy) == len(values)
    window = np.hanning(400) * y[160 : 160 + 400]
    power = np.abs(np.array([(window * np.exp(-2j * np.pi * k * np.arange(400) / 512)).sum() for k in range(257)])) ** 2
    assert np.allclose(values[1], np.log(power @ af.mel_filters(40, 512, 16000) + 1e-10), atol=1e-2)
    assert af.log_mel(np.empty(0, np.float32))[0].shape == (0, 40) and len(af.resample(x[:0], 8000, 16000)) == 0


def test_hysteresis():
    energy = np.array([-60, -25, -10, -25, -29, -31, -25, -60, 0, -5, -60.0])
    assert af.segments(energy) == [(2, 5), (8, 10)]
    assert af.segments(np.empty(0)) == [] and af.segments(np.zeros(3)) == [(0, 3)]
    assert af.decode(bytes([0xFF, 0x00, 0x80]), "mulaw").tolist() == pytest.approx([0, -0.98, 0.98], abs=0.01)


def test_leaf_generalises_fields():
    leaf = lt.Leaf(0.7)
    a = leaf.add(np.array([1, 2, 3, 4, 5, 6, 7]))
    assert leaf.add(np.array([1, 2, 3, 4, 5, 6, 8])) == a and leaf.rows[a].tolist() == [1, 2, 3, 4, 5, 6, 0]
    assert leaf.add(np.array([1, 2, 3, 9, 10, 11, 12])) != a


def test_walk_by_rarest_tokens_is_the_walk():
    rng = np.random.default_rng(5)
    for n in (4, 5, 7, 10, 20):
        for words in (3, 12, 200):
            for similarity in (0.0, 0.4, 0.7, 1.0):
                lines = np.minimum(rng.geometric(3 / (words + 3), (600, n)), words)
                lines[:, : min(3, n - 2)] = rng.integers(0, 2, min(3, n - 2))
                lines[rng.random((600, n)) < 0.03] = 0
                lines = np.unique(lines, axis=0)
                rng.shuffle(lines)
                leaf = lt.Leaf(similarity)
                assert lt.walked(lines.astype(np.int32), similarity).tolist() == [leaf.add(x) for x in lines], (n, words, similarity)


def test_canonical_licences():
    assert canonical("Copyright (c) 2020 Me\nReleased   under THE mit Licence!!\n") == "released under the mit license"
    assert canonical("© 2020 X") == "" and "MIT" in known_digests().values()
    assert all(canonical(t) for texts in LICENSES.values() for t in texts)
