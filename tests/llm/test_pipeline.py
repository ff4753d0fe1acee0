"""The pipeline, stage by stage and whole, against a version that works on Python lists."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_operators import brute_recurring

import corpus_pipeline
from spanforge.llm import line_templates
from spanforge.llm.bpe import PATTERN, load
from spanforge.llm.common import vocabulary_file
from spanforge.llm.ngram_jaccard import jaccard
from spanforge.llm.shingles import shingle_set

BAD = ("grumf", "blargo", "snorkel")


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 8)))
    rows, labels = [], []
    for k in range(240):
        body = [" ".join(word() for _ in range(rng.randrange(8, 20))) for _ in range(rng.randrange(3, 7))]
        if k % 8 == 0:
            body[0] = " ".join([*body[0].split()[:3], *rng.sample(BAD, 2)])
        if k % 5 == 1:
            body.insert(1, f"Printed on page {rng.randrange(50)} of this fine book")
        rows.append([k, "\n".join(body), rng.choice(["en", "en", "de"]), rng.choice(["s0", "s0", "s0", "s1", "s2"])])
        if k < 160:
            labels.append((k, int(k % 8 == 0)))
    for k in range(24):
        words = rows[10 * k + 2][1].split(" ")
        if k % 2:
            words[-1] = "changed"
        rows.append([1000 + k, " ".join(words), "en", rng.choice(["s0", "s1"])])
    return [(d, t, lang, s, len(t)) for d, t, lang, s in rows], labels


def without_toxic(rows):
    return [r for r in rows if not any(w in BAD for w in r[1].split())]


def without_lines(rows):
    gone = brute_recurring([(r[0], r[1]) for r in rows])
    hit = {k for k, _ in gone}
    out = [(r[0], "\n".join(x for k, x in enumerate(r[1].split("\n")) if (row, k) not in gone), *r[2:]) for row, r in enumerate(rows)]
    return [(*r[:4], len(r[1]) if row in hit else r[4]) for row, r in enumerate(out) if row not in hit or r[1].strip(" ")]


def without_copies(rows):
    sets = {r[0]: shingle_set(r[1], 3) for r in rows}
    parent = {d: d for d in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= 0.5:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [r for r in rows if root(r[0]) == r[0]]


def copies(spark, rows):
    """Newton on the dual over a row of features for each document."""
    n = np.array([len(r[1].split()) for r in rows], float)
    z = np.log1p(n)
    mean = (n * z).sum() / n.sum()
    z = (z - mean) / np.sqrt((n * z * z).sum() / n.sum() - mean**2)
    sources, langs = sorted({r[3] for r in rows}), sorted({r[2] for r in rows})
    x = np.column_stack([*(np.array([r[3] == s for r in rows], float) for s in sources), *(np.array([r[2] == v for r in rows], float) for v in langs), z])
    share = np.array([(n * x[:, k]).sum() / n.sum() for k in range(len(sources))]) ** 0.8
    goal = np.concatenate((share / share.sum(), [(n * x[:, len(sources) + k]).sum() / n.sum() for k in range(len(langs))], [(n * z).sum() / n.sum()]))
    dual = np.zeros(x.shape[1])
    for _ in range(60):
        r = np.exp(x @ dual)
        dual -= np.linalg.lstsq((x * (n * r / n.sum())[:, None]).T @ x, x.T @ (n * r) / n.sum() - goal, rcond=1e-12)[0]
    rates = np.exp(x @ dual)
    # the scale is that at which the shortest or longest text of a source and language would have rate 1
    rates = np.maximum(rates / rates.min(), 1)
    u = {r.d: r.u for r in spark.createDataFrame([(r[0],) for r in rows], "d bigint").select("d", (F.pmod(F.xxhash64(F.lit(7), "d"), F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("u")).collect()}
    return Counter({r[0]: int(rate + u[r[0]]) for r, rate in zip(rows, rates)})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_pipeline_against_lists(spark, folder):
    rows = corpus()[0]
    expected = [without_toxic, without_lines, without_copies]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), plain in zip(corpus_pipeline.STAGES, expected):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        rows = plain(rows)
        got = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
        assert sorted(got) == sorted(rows), name
        docs = spark.createDataFrame(rows, docs.schema)
    wanted = copies(spark, rows)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, folder)
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == wanted and min(wanted.values()) >= 1
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in whole) == wanted
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load(vocabulary_file("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    assert all(r.tokens == library.encode_ordinary(r.text) and r.n_tokens == len(r.tokens) for r in whole)


def test_stages_on_empty_and_odd_tables(spark, folder):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, rate string, copies string, found string, key string, gone string, label int, head string"
    more = ("r", "c", "f", "k", "g", 7, "h")
    long = "word " * 20_000
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a few words of text", "en", None, 19), (None, None, None, None, None), (3, long, "en", "s", 100_000), (4, "one two three four", "en", "s", 18), (4, "one two three four", "en", "s", 18), (4, "of one id another text", "de", "s", 22), (5, "one two  three four!", "en", None, 20)]
    odd = [r + more for r in odd]
    docs = spark.createDataFrame(odd, schema)
    plain = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), folder).count() == 0, name
        got = stage(spark, docs, folder)
        # of equal word sets the document of the smallest id stays, and repeated rows are one
        expected = [r for k, r in enumerate(odd) if name != "near_copies" or k not in (6, 8)]
        if name == "source_mixing":
            assert plain(set(got.collect())) == plain(set(odd)) and got.count() >= len(odd)
            assert len({n for r, n in Counter(map(tuple, got.collect())).items() if r == odd[5]}) == 1
        else:
            assert plain(got.select(docs.columns).collect()) == plain(expected), name
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "source_mixing", "bpe_tokens"]


def test_line_dedup_of_a_full_leaf(spark, folder):
    """Templates are those of the walk also where a leaf has more than 4,000 forms."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    prose = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = [(k, f"here it was alpha beta gamma delta epsilon {word()}\n{prose[k]}") for k in range(4)]
    rows += [(10 + k, f"here it was {' '.join(word() for _ in range(6))}") for k in range(4200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, folder).collect()}
    assert got == dict(rows) | dict(enumerate(prose))


def same_xxhash64(rng):
    """Two lines of 64 printable bytes and equal xxhash64 as Spark has it: what the first eight bytes change in their lane, bytes 32 to 39 take back."""
    one, two, full = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
    word = lambda n: "".join(rng.choice("aeioulmnrst") for _ in range(n))

    def lane(x):
        v = (42 + one + two + int.from_bytes(x.encode(), "little") * two) & full
        return ((v << 31 | v >> 33) & full) * one & full

    for _ in range(1_000_000):
        # lines are hashed with digits masked, and so told apart
        a, b, y = word(8), word(7) + "1", word(8)
        other = ((int.from_bytes(y.encode(), "little") + (lane(a) - lane(b)) * pow(two, -1, 1 << 64)) & full).to_bytes(8, "little")
        if all(32 < c < 127 for c in other):
            middle, end = f" {word(7)} {word(6)} {word(7)} ", f" {word(11)} {word(11)}"
            return f"{a}{middle}{y}{end}", f"{b}{middle}{other.decode()}{end}"
    raise AssertionError("none found")


def test_line_dedup_is_the_same_on_both_sides_of_its_switches(spark, folder, monkeypatch):
    """Joined by a hash of their texts, two rows had the places of one of them, but only beyond HASH_BYTES."""
    rng = random.Random(20)
    prose = [" ".join("".join(rng.choice("aeioulmnrst") for _ in range(7)) for _ in range(30)) for _ in range(4)]
    line, other = same_xxhash64(rng)
    rows = [(k, f"{line}\n{x}") for k, x in enumerate(prose)] + [(9, f"{other}\n{prose[0]}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert docs.where("doc_id in (0, 9)").select(F.xxhash64("text")).distinct().count() == 1
    for name, value in (("HASH_BYTES", 32 << 20), ("HASH_BYTES", 0), ("INDEXED", 0), ("INDEXED", 1 << 40)):
        with monkeypatch.context() as m:
            m.setattr(line_templates, name, value)
            assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, folder).collect()} == dict(enumerate(prose)) | dict(rows[-1:]), (name, value)


def test_near_copies_keep_the_same_row_however_the_table_lies(spark, folder):
    rng = random.Random(19)
    texts = [" ".join("".join(rng.choice("aeioulmnrst") for _ in range(7)) for _ in range(20)) for _ in range(30)]
    rows = [(k, t, lang, source, {"m": n}) for k, t in enumerate(texts) for lang in ("fr", "en", None) for source in "cab" for n in (2, 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, more map<string,int>")
    for parts in (1, 5):
        got = corpus_pipeline.near_copies(spark, docs.repartition(parts), folder).collect()
        assert sorted(map(tuple, got)) == [(k, t, None, "a", {"m": 1}) for k, t in enumerate(texts)], parts
