"""Corpus operators on small tables: odd rows in any column, and brute force where SQL has no words for them."""

import contextlib
import itertools
import os
import random
import textwrap
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.llm import line_templates, ngram_jaccard
from spanforge.llm.audio_features import FRAMES, MELS, audio_features, clips, rendered_texts, tensors
from spanforge.llm.bpe import bpe_decode, bpe_encode, with_tokens
from spanforge.llm.common import written
from spanforge.llm.html_extract import extract_html
from spanforge.llm.language_id import identify_languages
from spanforge.llm.license_scan import canonical, known_digests, license_scan
from spanforge.llm.license_texts import LICENSES
from spanforge.llm.line_templates import drop_recurring_lines, recurring_lines
from spanforge.llm.mixing import mix, mixing_rates
from spanforge.llm.ngram_jaccard import components, drop_near_copies, jaccard, ngram_jaccard_join, ngram_jaccard_pairs
from spanforge.llm.order_minhash import agreement, multipliers, order_minhash, signature
from spanforge.llm.shingles import shingle_set
from spanforge.llm.toxicity import drop_toxic, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tokens string, a int, b int, task string, bucket string, row string, label int, n_dropped string, rep int, copies int, terms string, template string"


def frame(spark, rows):
    """Documents from (doc_id, text, lang, source); the further columns have names that operators use inside."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", 1, 2, "t", "b", "r", 3, "n", 4, 5, "w", "z") for r in rows], SCHEMA)


def odd_rows():
    rng = random.Random(0)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(30_000))
    return [
        (1, "The same words stand here again and again for all to read.", "en", "s1"),
        (1, "The same words stand here again and again for all to read.", "en", "s1"),
        (2, "The same words stand here again and again for all to read.", "en", "s2"),
        (3, None, "en", "s1"),
        (4, "", "de", None),
        (5, " \n\t ", None, "s2"),
        (None, "no id has this text of a few words", "en", "s1"),
        (None, None, None, None),
        (6, long, "fr", "s3"),
        (7, "!!! ... ???", "en", "s3"),
        (8, "x" * 5000, "en", "s1"),
        (9, "été ☃ 日本\u0000\r\nline\n\n", "fr", "s2"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 0), (None, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")


def test_license_scan(spark, odd, empty):
    names = known_digests()
    texts = [(1, "MIT License\n\nCopyright (c) 2001 A\n"), (2, "prose\nReleased under the MIT Licence!\nmore"), (2, "All rights reserved."), (None, "Licensed under CC BY-NC 4.0."), (3, None), (4, "")]
    got = {(r.doc_id, r.unit, r.line_no, r.license) for r in license_scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {(2, "line", 1, "MIT"), (2, "line", 0, "all-rights-reserved"), (2, "document", None, "all-rights-reserved"), (None, "line", 0, "CC-BY-NC-4.0"), (None, "document", None, "CC-BY-NC-4.0")}
    assert license_scan(odd).count() == 0 and license_scan(empty).count() == 0
    import hashlib

    for _, text in texts[:3]:
        assert (hashlib.sha256(canonical(text).encode()).hexdigest() in names) == any(u == "document" and t == text for u, t in [("document", "All rights reserved.")])


def test_license_scan_of_long_texts(spark):
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all(os.path.exists(f"{folder}/{f}") for f in names):
        pytest.skip("no texts on this machine")
    rows = []
    for k, f in enumerate(names):
        with open(f"{folder}/{f}") as text:
            rows.append((k, text.read()))
    rows.append((10, rows[0][1].split("   END OF TERMS")[0]))
    rows.append((11, rows[0][1].replace("perpetual", "short")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.license) for r in license_scan(docs).where("unit = 'document'").collect()}
    assert got == {*enumerate(names.values()), (10, "Apache-2.0")}


def test_license_scan_of_wrapped_texts(spark):
    rows = [(k, f"Copyright {sign} {who}\n\n" + "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n")), name) for k, (name, width, text, sign, who) in enumerate((n, w, t, s, a) for n, texts in LICENSES.items() for t in texts if len(t) >= 400 for w in range(60, 101) for s, a in [(("(c)", "2020 Me"), ("2001-2020", "Ann Author"), ("©", "The Foo Project"), ("Ann", "Author"))[w % 4]])]
    got = {(r.doc_id, r.license) for r in license_scan(spark.createDataFrame(rows, "doc_id bigint, text string, name string")).where("unit = 'document'").collect()}
    assert got == {(k, name) for k, _, name in rows} and len(rows) > 600


def brute_recurring(rows, min_docs=3, depth=3, min_tokens=4, similarity=0.7):
    """(row, line_no) of recurring lines, by walking the tree line by line. Rows are (doc_id, text)."""
    lines = []
    for row, (doc, text) in enumerate(rows):
        for k, line in enumerate(text.split("\n")):
            tokens = ["<*>" if any(c in "0123456789" for c in t) else t for t in line.split()]
            if len(tokens) >= min_tokens:
                lines.append((row, doc, k, tuple(tokens)))
    leaves = {}
    for _, doc, _, tokens in lines:
        leaves.setdefault((len(tokens), tokens[: min(depth, len(tokens) - 2)]), []).append((doc, tokens))
    template = {}
    for key, members in leaves.items():
        forms = sorted({t for _, t in members}, key=lambda t: (-sum(x == t for _, x in members), " ".join(t)))
        groups = []
        for t in forms:
            best, score = None, -1
            for g, pattern in enumerate(groups):
                s = sum(a == b and a != "<*>" for a, b in zip(pattern, t))
                if s > score:
                    best, score = g, s
            if best is not None and score >= similarity * len(t):
                groups[best] = tuple(a if a == b else "<*>" for a, b in zip(groups[best], t))
            else:
                best = len(groups)
                groups.append(t)
            template[t] = (key, best)
    docs = {}
    for _, doc, _, tokens in lines:
        if doc is not None:
            docs.setdefault(template[tokens], set()).add(doc)
    sets = {}
    for doc, text in sorted(rows, key=lambda r: r[1], reverse=True):
        sets[doc] = shingle_set(text, 3)
    alike = {}

    def copies(a, b):
        if (a, b) not in alike:
            alike[a, b] = alike[b, a] = jaccard(sets[a], sets[b]) >= 0.5
        return alike[a, b]

    def independent(found):
        """Whether min_docs of the documents are no copies of each other, longest first or any three at all."""
        left, n = sorted(found, key=lambda d: (-len(sets[d]), d)), 0
        while left:
            n, head = n + 1, left[0]
            left = [d for d in left[1:] if not copies(d, head)]
        return n >= min_docs

    recurring = {t for t, found in docs.items() if len(found) >= min_docs and independent(found)}
    return {(row, k) for row, _, k, tokens in lines if template[tokens] in recurring}


def test_line_templates_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = []
    for d in range(40):
        body = [" ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(6, 14))) for _ in range(rng.randrange(2, 6))]
        if d % 3 == 0:
            body.insert(rng.randrange(len(body)), f"Page {rng.randrange(99)} of {rng.randrange(99)} in this book")
        if d % 4 == 0:
            body.append(f"This site is shown to you by {rng.choice(['anna', 'bert', 'carl'])} with love")
        if d % 5 == 0:
            body.append("short  line")
        if d % 6 == 0:
            body.append(f"Posted here by {rng.choice(['anna', 'bert', 'carl', 'dora', 'emil', 'fred'])}")
        rows.append((d, "\n".join(body)))
    rows += [(100 + k, rows[1][1]) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.line_no) for r in recurring_lines(docs).collect()}
    expected = {(rows[row][0], k) for row, k in brute_recurring(rows)}
    assert got == expected and len(got) > 20
    assert not any(d >= 100 or d == 1 for d, _ in got)
    assert sum(1 for d, text in rows for k, x in enumerate(text.split("\n")) if x.startswith("Posted") and (d, k) in got) == 7
    wanted = {d: ("\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in expected), sum(x == d for x, _ in expected)) for d, text in rows}
    assert {r.doc_id: (r.text, r.n_dropped) for r in drop_recurring_lines(docs).collect()} == wanted
    # beyond the size of a broadcast the rows are joined
    monkeypatch.setattr(line_templates, "HASH_BYTES", 0)
    assert {r.doc_id: (r.text, r.n_dropped) for r in drop_recurring_lines(docs).collect()} == wanted


def test_rows_of_one_id_lose_their_own_lines(spark):
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(7)) for _ in range(n))
    passage = prose(20)
    rows = [(k, f"{prose(30)}\n{passage}\n{prose(30)}") for k in range(4)]
    rows += [(2, other := f"{prose(9)}\n{prose(9)}\n{prose(9)}"), (None, f"{passage}\nown words of it"), (None, None)]
    got = [(r.doc_id, r.text) for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=str) == sorted([*((k, t.replace(f"\n{passage}", "")) for k, t in rows[:4]), (2, other), (None, "own words of it"), (None, None)], key=str)


def test_a_full_leaf_is_counted(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(k, f"This message was sent to {word()} from the office") for k in range(50_000)]
    rows += [(50_000 + k, f"This message was {' '.join(word() for _ in range(6))}") for k in range(500)]
    start = time.perf_counter()
    docs = spark.createDataFrame(pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]}))
    got = {r.doc_id for r in recurring_lines(docs).collect()}
    assert got == set(range(50_000)) and time.perf_counter() - start < 120


def test_templates_do_not_depend_on_how_full_a_leaf_is(spark):
    """Counting the tokens of leaves of more than 4,000 forms took the rare tokens of a template for fields."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = [(k, f"here it was {' '.join(['alpha', 'beta', 'gamma', 'delta', 'epsilon'])} {word()}\n{' '.join(word() for _ in range(30))}") for k in range(4)]
    for others in (50, 4200):
        more = [(10 + k, f"here it was {' '.join(word() for _ in range(6))}") for k in range(others)]
        docs = spark.createDataFrame(rows + more, "doc_id bigint, text string")
        assert {(r.doc_id, r.line_no) for r in recurring_lines(docs).collect()} == {(k, 0) for k in range(4)}, others


def test_passages_of_short_documents_and_of_copied_ones_recur(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(7)) for _ in range(n))
    short, copied, twice, changed = prose(60), prose(60), prose(60), [prose(12) for _ in range(9)]
    rows = [(k, f"{short}\n{prose(40)}") for k in range(10)]
    rows += [(10, short)]
    rows += [(20 + 2 * k + c, text) for k in range(3) for text in [f"{prose(30)}\n{copied}\n{prose(30)}"] for c in range(2)]
    rows += [(40 + k, f"{twice}\n{prose(60)}") for k in range(2)]
    # versions of one document are no passage, however many there are
    rows += [(50 + k, "\n".join([*changed[:k], prose(12), *changed[k + 1 :]])) for k in range(9)]
    got = {(r.doc_id, r.line_no) for r in recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(k, 0) for k in range(11)} | {(20 + k, 1) for k in range(6)}


def test_line_templates_on_odd_rows(odd, empty):
    out = drop_recurring_lines(odd)
    assert sorted(map(str, (tuple(r) for r in out.drop("n_dropped").collect()))) == sorted(map(str, (tuple(r) for r in odd.drop("n_dropped").collect())))
    assert drop_recurring_lines(empty).count() == 0


def test_order_minhash(odd, empty):
    f = multipliers(64)
    rows = order_minhash(odd).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r.signature for r in rows if r.doc_id is not None}
    for doc_id, text, *_ in odd_rows():
        if doc_id is not None:
            expected = signature(text or "", 3, 2, f).view(np.int64).tolist()
            assert by_id[doc_id] == (expected or None)
    same = order_minhash(odd).where("doc_id = 1 or doc_id = 2").groupBy().agg(F.min("signature").alias("x"), F.max("signature").alias("y")).select(agreement(F.col("x"), F.col("y")).alias("s")).first().s
    assert same == 1.0 and order_minhash(empty).count() == 0


def test_mixing_meets_its_constraints(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 200)), rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "a", "b", "c"])) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    target = {"a": 0.2, "b": 0.5, "c": 0.3}
    got = mixing_rates(docs, target).collect()
    total = sum(r.n_tokens * r.rate for r in got)
    for s, share in target.items():
        assert sum(r.n_tokens * r.rate for r in got if r.source == s) / total == pytest.approx(share, abs=1e-6)
    tokens = sum(r.n_tokens for r in got)
    for lang in ("en", "de"):
        assert sum(r.n_tokens * r.rate for r in got if r.lang == lang) / total == pytest.approx(sum(r.n_tokens for r in got if r.lang == lang) / tokens, abs=1e-6)
    log = lambda r: np.log1p(r.n_tokens)
    assert sum(r.n_tokens * r.rate * log(r) for r in got) / total == pytest.approx(sum(r.n_tokens * log(r) for r in got) / tokens, abs=1e-6)
    # rates are exponentials of a sum of terms: log-linear in source, language and log length
    x = np.array([[r.source == "a", r.source == "b", r.source == "c", r.lang == "en", log(r)] for r in got], float)
    y = np.log([r.rate for r in got])
    assert np.abs(x @ np.linalg.lstsq(x, y, rcond=None)[0] - y).max() < 1e-6
    assert min(r.rate for r in got) == pytest.approx(1)
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in got)
    assert sum(r.copies for r in got) == pytest.approx(sum(r.rate for r in got), rel=0.05)
    assert mix(docs, target).count() == sum(r.copies for r in got)
    dropped = mixing_rates(docs, {"a": 1.0}).collect()
    assert all((r.copies == 0) == (r.source != "a") for r in dropped)
    with pytest.raises(ValueError):
        mixing_rates(docs, {"zz": 1.0})


def test_mixing_meets_any_share(spark):
    rng = random.Random(16)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["en", "de"]), "a" if k % 2 else "b") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for share in (1e-7, 1e-30):
        with pytest.raises(ValueError, match="budget") if share < 1e-10 else contextlib.nullcontext():
            mixing_rates(docs, {"a": share, "b": 1}).collect()
        got = mixing_rates(docs, {"a": share, "b": 1}, budget=1e4).collect()
        assert sum(r.n_tokens * r.rate for r in got) == pytest.approx(1e4)
        assert sum(r.n_tokens * r.rate for r in got if r.source == "a") / 1e4 == pytest.approx(share / (1 + share), rel=1e-6)
        assert {r.met for r in got} == {"sources, languages, length"} and all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in got)
    # a language that only one source has can't keep its share when that source loses its own
    alone = docs.withColumn("lang", F.when(F.col("source") == "a", "fr").otherwise("en"))
    got = mixing_rates(alone, {"a": 0.9, "b": 0.1}).collect()
    assert {r.met for r in got} == {"sources"}
    assert sum(r.n_tokens * r.rate for r in got if r.source == "a") / sum(r.n_tokens * r.rate for r in got) == pytest.approx(0.9)


def test_mixing_on_odd_rows(odd, empty):
    rows = mixing_rates(odd).collect()
    assert len(rows) == 12 and all(r.rate >= 1 and r.copies >= 1 for r in rows)
    out = mix(odd)
    assert out.columns == odd.columns and out.count() >= 12
    assert mixing_rates(empty).count() == 0 and mix(empty).count() == 0
    assert all(r.rate == 1 for r in mixing_rates(odd.where("text is null")).collect())


def test_audio_features(odd, empty):
    rows = audio_features(rendered_texts(odd))
    table = tensors(rows.toArrow())
    assert table.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    got = {(r.doc_id, r.clip): r for r in rows.collect()}
    for doc_id, text, *_ in odd_rows():
        if doc_id is not None and text:
            for clip, start, end, n, tensor, inside in clips(text.encode(), 8000, "mulaw", FRAMES, MELS):
                r = got[doc_id, clip]
                assert (r.start_ms, r.end_ms, r.n_frames, [tuple(s) for s in r.segments]) == (start, end, n, inside)
                assert np.allclose(r.log_mel, tensor, atol=0.05)
    assert not any(r.doc_id in (3, 4) for r in rows.collect()) and audio_features(rendered_texts(empty)).count() == 0


def test_toxicity_on_odd_rows(odd, empty, labels):
    rows = toxicity(odd, labels).collect()
    assert len(rows) == 12
    assert all(not r.is_toxic for r in rows if r.doc_id == 3)
    kept = drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 2
    assert toxicity(empty, labels).count() == 0 and toxicity(odd, labels.limit(0)).where("is_toxic").count() == 0


def test_toxicity_drops_planted(spark):
    rng = random.Random(3)
    clean = lambda: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 8))) for _ in range(50))
    bad = ["grumf", "blargo", "snorkel"]
    rows = []
    for k in range(300):
        words = clean().split()
        if k % 4 == 0:
            for w in rng.sample(bad, 2):
                words[rng.randrange(50)] = w
        if k >= 296:
            words = clean().split()
            words[10] = ["gr0mf", "b.l.a.r.g.o", "sn0rk3l", "blaaaaargo"][k - 296].replace("gr0mf", "grum.f")
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id bigint, toxic int")
    kept = {r.doc_id for r in drop_toxic(docs, labels).collect()}
    assert kept == {k for k in range(296) if k % 4}


def test_toxicity_of_a_minority_language(spark):
    rng = random.Random(12)
    clean = lambda: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 8))) for _ in range(50))
    form = lambda: "achlich" + "".join(rng.choice("aeioulmnrst") for _ in range(6))
    rows = []
    # the stem is in all toxic documents of "de" and none of its clean ones, and in harmless words of "en"
    for k in range(600):
        rows.append((k, f"{clean()} grumf" if k % 6 == 0 else f"{clean()} {form()}" if k % 12 == 1 else clean(), "en"))
    for k in range(600, 760):
        rows.append((k, f"{clean()} {form()}" if k % 8 == 0 else clean(), "de"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    bad = {k for k in range(600) if k % 6 == 0} | {k for k in range(600, 760) if k % 8 == 0}
    labels = spark.createDataFrame([(k, int(k in bad)) for k in [*range(400), *range(600, 700)]], "doc_id bigint, toxic int")
    assert {r.doc_id for r in toxicity(docs, labels).where("is_toxic").collect()} == bad
    assert {r.doc_id for r in drop_toxic(docs, labels).collect()} == set(range(760)) - bad


def test_html_extraction(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(n)) + "."
    pages, expected = [], {}
    for k in range(60):
        paragraphs = [prose(rng.randrange(15, 60)) for _ in range(4)]
        frame_ = "article" if k < 40 else "section"
        menu = "".join(f"<li><a href='#'>{prose(1)}</a></li>" for _ in range(5))
        top = f"<nav><ul>{menu}</ul></nav>" if k < 40 else f"<div><ul>{menu}</ul></div>"
        pages.append((k, "u", f"<html><body>{top}<{frame_}>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</{frame_}><footer>© {prose(2)}</footer></body></html>"))
        expected[k] = "\n".join(paragraphs)
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extract_html(table).collect()}
    assert np.mean([got[k] == expected[k] for k in range(60)]) >= 0.95
    odd = spark.createDataFrame([(1, "", None), (None, "u", "<p>one"), (2, "u", ""), (2, "u", "<div"), (3, None, "<p>" * 3000 + "deep" + "<b>" * 10), (4, "u", "plain")], "page_id bigint, url string, html string")
    rows = extract_html(odd).collect()
    assert len(rows) == 6 and {(r.page_id, r.n_blocks) for r in rows} >= {(1, None), (None, 1), (2, 0), (3, 1)}
    assert extract_html(table.limit(0)).count() == 0


def test_language_id(spark, odd, empty):
    rng = random.Random(5)
    sets = {"xx": "the and of to in that with house water".split(), "yy": "der und von zu mit haus wasser nicht".split()}
    rows = [(k, " ".join(rng.choice(sets[lang]) for _ in range(20)), lang) for k in range(80) for lang in [("xx", "yy")[k % 2]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = identify_languages(docs).collect()
    assert all(r.predicted == r.lang and r.margin > 0 for r in got) and len(got) == 80
    rows = identify_languages(odd).collect()
    assert len(rows) == 12 and all((r.predicted is None) == (r.doc_id in (3, 4, 5) or (r.doc_id is None and r.lang is None)) for r in rows)
    assert identify_languages(empty).count() == 0 and identify_languages(odd.where("lang is null")).where("predicted is not null").count() == 0


def near_rows(rng):
    rows = []
    for k in range(30):
        base = [f"t{rng.randrange(4000)}" for _ in range(rng.randrange(20, 120))]
        rows.append((10 * k, " ".join(base)))
        for j in range(1, rng.randrange(1, 5)):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(9999)}"
            rows.append((10 * k + j, " ".join(words)))
    return rows


def test_jaccard_join_against_brute_force(spark):
    rows = near_rows(random.Random(6))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {d: shingle_set(t, 3) for d, t in rows}
    true = {(a, b): j for a, b in itertools.combinations(sorted(sets), 2) if (j := jaccard(sets[a], sets[b])) >= 0.5}
    near, members = ngram_jaccard_pairs(docs)
    assert {r.doc_id: r.rep for r in members.collect()} == {d: min(x for x in sets if np.array_equal(sets[x], sets[d])) for d in sets}
    reps = {r.rep for r in members.collect()}
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in near.collect()}
    wanted = {p: j for p, j in true.items() if set(p) <= reps and j < 1}
    assert got.keys() == wanted.keys() and all(got[p] == pytest.approx(wanted[p]) for p in got)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(sets, 0)
    for a, b in true:
        links[a], links[b] = links[a] + 1, links[b] + 1
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {(r.doc_id, r.class_id, r.n_links) for r in ngram_jaccard_join(docs).collect()} == {(d, root(d), n) for d, n in links.items() if n}
    assert {r.doc_id for r in drop_near_copies(docs).collect()} == {d for d in sets if root(d) == d}


def test_jaccard_join_of_a_hot_bucket(spark, monkeypatch):
    """Blocks of a bucket give what the whole bucket does."""
    rng = random.Random(15)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(400):
        words = list(base)
        words[rng.randrange(60)] = f"z{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = {tuple(r) for r in ngram_jaccard_join(docs).collect()}
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 30)
    assert whole == {tuple(r) for r in ngram_jaccard_join(docs).collect()} == {(k, 0, 399) for k in range(400)}


def test_near_copies_of_a_large_group_take_few_pairs(spark, monkeypatch):
    """Groups are those of all pairs, but a group of 600 versions, which have 179,700 pairs, takes few of them."""
    rng = random.Random(16)
    rows = []
    for k in range(600):
        words = [f"t{j}" for j in range(60)]
        for _ in range(1 + k % 3):
            words[rng.randrange(60)] = f"z{rng.randrange(9999)}"
        rows.append((k, " ".join(words)))
    # chains, of which no version is similar to all others, and versions that are just too far from the group
    rows += [(1000 + k, " ".join(f"c{j}" for j in range(4 * k, 4 * k + 40))) for k in range(40)]
    rows += [(2000 + k, " ".join(f"t{j}" if j % 9 else f"y{k}_{j}" for j in range(60))) for k in range(30)]
    rows += [(5000 + d, t) for d, t in near_rows(rng)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {d: shingle_set(t, 3) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= 0.5:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    pairs = []

    def counting(df, tag):
        out = written(df, tag)
        if tag == "candidates":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(ngram_jaccard, "written", counting)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 100)
    monkeypatch.setattr(ngram_jaccard, "SIDE", 20)
    assert {r.doc_id for r in drop_near_copies(docs).collect()} == {d for d in sets if root(d) == d}
    assert sum(pairs) < 40_000


def test_jaccard_join_of_many_copies(spark):
    text = " ".join(f"w{k}" for k in range(30))
    ids = pa.table({"doc_id": list(range(50_000)), "text": [text] * 50_000})
    rows = ngram_jaccard_join(spark.createDataFrame(ids)).agg(F.count("*"), F.max("class_id"), F.min("n_links"), F.max("n_links")).first()
    assert tuple(rows) == (50_000, 0, 49_999, 49_999)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 200)]
    out = components(spark.createDataFrame(edges, "x bigint, y bigint"))
    assert {(r.node, r.label) for r in out.collect()} == {*((k, 0) for k in range(41)), *((k, 100) for k in (100, 101, 102))}


def test_jaccard_join_on_odd_rows(spark, odd, empty):
    assert sorted(tuple(r) for r in ngram_jaccard_join(odd).collect()) == [(1, 1, 1), (2, 1, 1)]
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "None", "None", "6", "7", "8", "9"])
    assert ngram_jaccard_join(empty).count() == 0 and drop_near_copies(empty).count() == 0
    # texts that share an id are documents of their own
    one, two = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, one), (1, two), (1, two), (2, "!"), (2, "!"), (3, two + " ."), (4, one + " and")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in drop_near_copies(docs).collect()) == [(1, one), (1, two), (2, "!"), (2, "!")]
    assert sorted(tuple(r) for r in ngram_jaccard_join(docs).collect()) == [(1, 1, 1), (1, 1, 1), (3, 1, 1), (4, 1, 1)]


def test_bpe_round_trip(odd, empty):
    rows = bpe_encode(odd)
    assert rows.count() == 12 and rows.where("round_trip = false").count() == 0
    assert rows.where("tokens is null").count() == 2 and rows.where("n_tokens = 0").count() == 1
    back = sorted(map(str, (tuple(r) for r in bpe_decode(rows).collect())))
    assert back == sorted(map(str, (tuple(r) for r in odd.select("doc_id", "text").collect())))
    more = with_tokens(odd)
    assert set(more.columns) == {*odd.columns, "n_tokens"} and more.count() == 12 and with_tokens(empty).count() == 0
