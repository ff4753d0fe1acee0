"""The engine against a plain model of its operators on random spans, and its edge cases."""

import glob
import http.server
import itertools
import json
import os
import random
import re
import threading
import urllib.parse
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spanforge.functions.text import TOKEN, TermProcessor, normalised, normalised_literal, split_tokens, strip_accents
from spanforge.operators import terms as t
from spanforge.operators.resolvers import LookupResolver, MeasurementResolver, UnknownName
from spanforge.operators.results import Search, render
from spanforge.operators.scoring import hit_length, register_scorer
from spanforge.plans.ast import And, Annotation, Const, Constraint, Contains, Gap, Minus, Node, Or, Repeats, Sequence, Term, Widened, Within
from spanforge.plans.compile import Compiler, leaves
from spanforge.queries import ORACLE_SQL, QUERIES
from spanforge.sources.corpus import corpus_index
from spanforge.sources.index import AnnotationType, IndexConfig, SpanIndex, document_annotations, document_table, federated, posting_table, span_annotations, spread
from spanforge.sources.sparql import SparqlEndpoint
from spanforge.sources.storage import shared_folder

CONFIG = IndexConfig({"string": "lower", "root": "none"}, {"S": AnnotationType(nominal=("k",), integer=("n",), text=("note",)), "Doc": AnnotationType(nominal=("lang",), document_mode=True, index_nulls=False), "M": AnnotationType(nominal=("normalizedUnit",), float=("normalizedValue", "normalizedMinValue", "normalizedMaxValue"))})


def make(spark, texts, spans=(), config=CONFIG, deleted=None):
    rows = spark.createDataFrame(list(texts), "doc_id bigint, text string")
    docs = document_table(rows)
    roots = {"root": F.transform("tokens", lambda x: F.substring(F.lower(x), 1, 1))}
    table = spark.createDataFrame(list(spans), "doc_id bigint, start int, length int, k string, n bigint, note string")
    lang = document_annotations(docs, spark.createDataFrame([(1, "en"), (2, None)], "doc_id bigint, lang string"), config.annotation_types["Doc"])
    measures = spark.createDataFrame([(1, 0, 1, "m", 0.05, None, None), (1, 1, 1, "m", None, 0.04, 0.2), (1, 2, 1, "K", 260.0, None, None)], "doc_id bigint, start int, length int, normalizedUnit string, normalizedValue double, normalizedMinValue double, normalizedMaxValue double")
    return SpanIndex(config, docs, posting_table(docs, config, roots), {"S": table, "Doc": lang, "M": measures}, deleted)


def bag(frame):
    return Counter((r.doc_id, r.start, r.length) for r in frame.collect())


def model(node: Node, docs: dict[int, list[str]]) -> Counter:
    """Hits by definition, one document at a time."""
    if isinstance(node, Term):
        return Counter({(d, k, node.length): 1 for d, ws in docs.items() for k, w in enumerate(ws) if w == node.term})
    if isinstance(node, Sequence):
        out = model(node.nodes[0], docs)
        for k, n in enumerate(node.nodes[1:]):
            g, after = node.gap(k), Counter()
            for ((d, s, m), c), ((e, u, v), f) in itertools.product(out.items(), model(n, docs).items()):
                if d == e and g.low <= u - (s + m) <= g.high:
                    after[d, s, u + v - s] += c * f
            out = after
        return out
    if isinstance(node, Widened):
        return Counter({(d, s, m + node.gap): c for (d, s, m), c in model(node.node, docs).items()})
    if isinstance(node, Repeats):
        return sum((model(Sequence((node.node,) * k), docs) if k > 1 else model(node.node, docs) for k in range(node.low, node.high + 1)), Counter())
    if isinstance(node, Or):
        return sum((model(n, docs) for n in node.nodes), Counter())
    if isinstance(node, And):
        parts = [model(n, docs) for n in node.nodes]
        spans = {(hits[0][0], min(h[1] for h in hits), max(h[1] + h[2] for h in hits)) for hits in itertools.product(*parts) if len({h[0] for h in hits}) == 1}
        return Counter({(d, s, e - s): 1 for d, s, e in spans if not any(x == d and s <= u and v <= e and (u, v) != (s, e) for x, u, v in spans)})
    left, right = (model(n, docs) for n in ((node.inner, node.outer) if isinstance(node, Within) else (node.outer, node.inner) if isinstance(node, Contains) else (node.left, node.right)))
    if isinstance(node, Minus):
        return Counter({h: c for h, c in left.items() if h not in right})
    inside = (lambda a, b: b[1] <= a[1] and a[1] + a[2] <= b[1] + b[2]) if isinstance(node, Within) else (lambda a, b: a[1] <= b[1] and b[1] + b[2] <= a[1] + a[2])
    return Counter({h: c for h, c in left.items() if any(h[0] == r[0] and inside(h, r) for r in right)})


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(1)
    docs = {d: [rng.choice("abcd") for _ in range(rng.randrange(0, 14))] for d in range(25)}
    index = make(spark, [(d, " ".join(w)) for d, w in docs.items()])
    return SpanIndex(index.config, index.documents.cache(), index.postings.cache(), index.annotations), docs


A, B, C = Term("a"), Term("b"), Term("c")
AB = Sequence((A, B), (Gap(0, 3),))


@pytest.mark.parametrize(
    "node",
    [A, Sequence((A, B)), Sequence((A, B, C), (Gap(1, 1), Gap(0, 2))), Sequence((A, B), (Gap(0, 40),)), Widened(A, 2), Repeats(A, 1, 3), Repeats(Or((A, AB)), 2, 2), Or((A, B, A)), And((A, B)), And((A, B, C)), And((AB, C)), And((A, And((B, AB)))), Within(A, AB), Within(AB, Sequence((B, C), (Gap(0, 6),))), Contains(AB, C), Contains(AB, AB), Minus(Or((A, B, A)), B), Minus(AB, A), And((A, A))],
    ids=lambda n: str(n)[:60],
)
def test_operators_against_the_model(world, node):
    index, docs = world
    assert bag(Compiler(index).hits(node)) == model(node, docs)
    with_parts = Compiler(index, bindings=True).hits(node)
    assert bag(with_parts) == model(node, docs) and "bindings" in with_parts.columns


def test_bindings_are_the_operands(world):
    index, docs = world
    for r in Compiler(index, bindings=True).hits(Sequence((A, B, C), (Gap(0, 2), Gap()))).collect():
        assert [docs[r.doc_id][b.start] for b in r.bindings] == ["a", "b", "c"]
    for r in Compiler(index, bindings=True).hits(And((A, B))).collect():
        assert [docs[r.doc_id][b.start] for b in r.bindings] == ["a", "b"]


def test_equivalent_formulations(world):
    index, _ = world
    of = lambda q: bag(Search(index, q).hits())
    assert of("a+1..3") == of("a | (a a) | (a a a)") and of("a+2..2") == of("a a")
    assert of("a [0..0] b") == of("a b") == of(Sequence((A, B)))
    assert all(n <= of("a [0..2] b")[h] for h, n in of("a [1] b").items())


def test_documented_examples(spark):
    at = lambda places, n: " ".join("x" if k in places else "o" for k in range(n))
    text = ["o"] * 40
    for k in (1, 6, 24, 27):
        text[k] = "a"
    for k in (0, 13, 31, 39):
        text[k] = "b"
    index = make(spark, [(1, " ".join(text)), (2, "a b b c"), (3, at({0, 1}, 2))])
    spans = lambda q: sorted((r.doc_id, r.start, r.start + r.length) for r in Search(index, q).hits().collect())
    assert [s[1:] for s in spans("a & b") if s[0] == 1] == [(0, 2), (6, 14), (13, 25), (27, 32)]
    assert [s for s in spans("a [0..5] b [0..5] c")] == [(2, 0, 4), (2, 0, 4)]
    assert spans("x+1..2") == [(3, 0, 1), (3, 0, 2), (3, 1, 2)]


def test_annotations(spark):
    spans = [(1, 0, 2, "u", 5, "p"), (1, 0, 2, "u", 6, "q"), (1, 3, 1, "v", None, None), (1, 3, 1, "v", None, None)]
    index = make(spark, [(1, "a b c d"), (2, "a"), (3, None)], spans)
    of = lambda q, **k: sorted(bag(Search(index, q, **k).hits()).elements())
    assert of("{S}") == [(1, 0, 2), (1, 3, 1)]
    assert of("{S n>=5}") == [(1, 0, 2), (1, 0, 2)] and of("{S n<5.7}") == [(1, 0, 2)] and of("{S n=5 note=p}") == [(1, 0, 2)]
    assert of('{S note.REGEX("^P$", "i")}') == [(1, 0, 2)] and of("{S k>u}") == [(1, 3, 1)] and of("{S k=u k<v}") == [(1, 0, 2)]
    assert of("{Doc}") == [(1, 0, 4)] and of("(a b) IN {S}") == [(1, 0, 2)] and of("{S} OVER b") == [(1, 0, 2)]
    assert of("root:a") == [(1, 0, 1), (2, 0, 1)]
    measure = {"M": MeasurementResolver()}
    assert of('{M spec="5 cm"}', resolvers=measure) == [(1, 0, 1), (1, 1, 1)] and of('{M spec="1 to 32 degF"}', resolvers=measure) == [(1, 2, 1)]
    assert of('{M spec="3 to 4 cm"}', resolvers=measure) == [(1, 1, 1)]
    for bad in ('{M spec="many cm"}', '{M spec="5 parsnips"}', '{M spec="5 cm" spec="6 cm"}', '{M spec<"5 cm"}'):
        with pytest.raises(ValueError):
            Search(index, bad, resolvers=measure).hits()
    lookup = lambda rows, schema: {"S": LookupResolver(lambda _: spark.createDataFrame(rows, schema))}
    assert of('{S sparql="q"}', resolvers=lookup([("u", 6), ("u", 6), ("z", 1)], "k string, n bigint")) == [(1, 0, 2)]
    with pytest.raises(ValueError, match="broken"):
        Search(index, '{S sparql="q"}', resolvers=lookup([("broken",)], "`error-message` string")).hits()
    for bad in ("{Nope}", "{S nope=1}", "nope:a"):
        with pytest.raises(UnknownName):
            Search(index, bad).hits()
    with pytest.raises(ValueError):
        Search(index, '{S n.REGEX("5")}').hits()


def test_offsets_become_spans(spark):
    docs = document_table(spark.createDataFrame([(1, "ab cd, ef")], "doc_id bigint, text string"))
    offsets = spark.createDataFrame([(1, 0, 2, "x"), (1, 1, 5, "y"), (1, 2, 3, "z"), (1, 50, 60, "w"), (1, 3, 9, "v")], "doc_id bigint, from int, to int, k string")
    got = {(r.k, r.start, r.length) for r in span_annotations(docs, offsets, AnnotationType(nominal=("k",))).collect()}
    assert got == {("x", 0, 1), ("y", 0, 2), ("z", 1, 1), ("v", 1, 3)}


def test_documents_deletion_and_scores(spark):
    texts = [(1, "a a b"), (2, "a c"), (3, "b b b b"), (4, "c"), (5, None), (6, "")]
    index = make(spark, texts)
    gone = index.with_deleted(spark.createDataFrame([(2,)], "doc_id bigint"))
    assert Search(index, "a").documents_count() == 2 and Search(gone, "a").documents_count() == 1
    assert {r.term: r["count"] for r in t.term_type(gone).collect()}["a"] == 3
    assert {r.doc_id for r in Compiler(index).documents(And((A, Const((1, 9))))).collect()} == {1}
    assert Compiler(index).hits(And((A, Const((1,))))).count() == 0
    assert {r.doc_id for r in Compiler(index).documents(Const((4, 2))).collect()} == {2, 4}
    assert [(r["rank"], r.doc_id, r.score) for r in Search(index, "a | b", "count").page().orderBy("rank").collect()] == [(0, 3, 4.0), (1, 1, 3.0), (2, 2, 1.0)]
    assert [(r["rank"], r.doc_id) for r in Search(index, "a | b").page(1, 1).collect()] == [(1, 2)]
    scores = hit_length(spark.createDataFrame([(1, 0, 15), (1, 0, 16), (1, 0, 32)], "doc_id bigint, start int, length int")).first().score
    assert scores == pytest.approx(1 + 1 + 0.5**0.9)
    assert all(r.score > 0 for r in Search(index, "a", "bm25").scores().collect())
    assert leaves(Minus(Within(A, B), C)) == [A] and leaves(Contains(A, B)) == [A] and leaves(Const((1,))) == []
    with pytest.raises(ValueError):
        Search(index, "a", "nope").scores()
    assert sorted((r.doc_id, r.start) for r in Search(index, "a", "count").page_hits(0, 1).collect()) == [(1, 0), (1, 1)]


def test_terms(spark):
    index = make(spark, [(1, "a the b b"), (2, "b c the"), (3, "d")], [(1, 0, 1, "u", 1, None), (1, 1, 1, "u", 2, None), (2, 0, 2, "v", 1, None)])
    of = lambda f: {r.term: r["count"] for r in f.collect()}
    assert of(t.term_type(index, stop_words=t.STOP_WORDS)) == {"b": 3, "c": 1, "d": 1}
    assert of(t.document_terms(index, 1)) == {"a": 1, "the": 1, "b": 2} and of(t.documents_and(index, [1, 2])) == {"the": 2, "b": 3}
    assert of(t.documents_or(index, [1, 3])) == {"a": 1, "the": 1, "b": 2, "d": 1} and of(t.document_terms(index, 99)) == {}
    x, y = t.const_terms(index, ["a", "c"], [3, 0]), t.const_terms(index, ["b", "c"], [5, 7])
    assert of(t.and_terms(x, y)) == {"c": 7} and of(t.or_terms(x, y, strategy="sum")) == {"a": 3, "b": 5, "c": 7}
    m, n = t.const_terms(index, ["a"], [3]), t.const_terms(index, ["a"], [2])
    assert [of(t.and_terms(m, n, strategy=s))["a"] for s in t.STRATEGIES] == [3, 3, 2, 5]
    assert of(t.and_terms(t.const_terms(index, ["a"]), n)) == {"a": 2}
    with pytest.raises(ValueError):
        t.or_terms(m, strategy="avg")
    assert [r.term for r in t.sorted_terms(t.term_type(index), ("string desc",)).collect()] == ["the", "d", "c", "b", "a"]
    assert [r.term for r in t.limit_terms(t.term_type(index), 2).collect()] == ["b", "the"]
    notes = t.annotation_terms(Compiler(index), Annotation("S", (Constraint("k", "=", "u"),)), "<${k}>")
    assert [(r.description, r["count"], r.length) for r in notes.collect()] == [("<u>", 2, 1)]
    every = t.annotation_terms(Compiler(index), Annotation("S"), "${k}")
    assert {r.description: r["count"] for r in t.group_by_description(every).collect()} == {"u": 2, "v": 1}
    assert t.filter_by_description(every, ["u"]).count() == 1


def test_texts_and_rendering(spark, tmp_path):
    index = make(spark, [(1, "One, two  <three> four."), (2, "two")])
    got = {(r.doc_id, r.left_context, r.hit_text, r.right_context) for r in Search(index, "two").hit_texts(2).collect()}
    assert got == {(1, "One,", "two", "<three"), (2, "", "two", "")}
    assert Search(index, "one [1] two").hit_texts().first().hit_text == "One, two"
    html = {r.doc_id: r.html for r in Search(index, "two").rendered(spark.createDataFrame([(1, 2, 3, "b"), (1, 0, 1, "script")], "doc_id bigint, start int, length int, tag string")).collect()}
    assert html[1] == 'One, <b><span class="hit">two</span>  &lt;three</b>&gt; four.'
    assert render(["a", "b", "c"], [" ", " ", ""], [{"start": 0, "length": 2, "tag": "i"}, {"start": 1, "length": 2, "tag": None}]) == '<i>a </i><span class="hit"><i>b</i> c</span>'
    Search(index, "two").csv(str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert Search(index, "two").metadata("x").columns == ["doc_id", "uri", "title", "x"]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_save_and_load(spark, tmp_path, world):
    index, docs = world
    index.save(str(tmp_path / "index"), 2)
    loaded = SpanIndex.load(spark, str(tmp_path / "index"), index.config)
    assert bag(Search(loaded, "a b").hits()) == model(Sequence((A, B)), docs)
    text = plan(Search(loaded, "a").hits())
    assert "PartitionFilters" in text and "EqualTo(term,a)" in text and re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = [01]\)", text)
    of = lambda i: {(r.term, r["count"]) for r in t.term_type(i).collect()}
    assert of(loaded) == of(index) and loaded.documents_of_term("string", "a").first().documents == sum("a" in ws for ws in docs.values())
    assert bag(Search(loaded, "root:a").hits()) == bag(Search(index, "root:a").hits())
    assert {(r.term, r["count"]) for r in t.document_terms(loaded, 3, "root").collect()} == {(r.term, r["count"]) for r in t.document_terms(index, 3, "root").collect()}
    scores = lambda i: {(r.doc_id, round(r.score, 9)) for r in Search(i, "a | b", "bm25").scores().collect()}
    assert scores(loaded) == scores(index)
    # a second call reads what the first one stored
    again = index.stored(str(tmp_path / "index"))
    assert again.buckets == 2 and bag(Search(again, "a").hits()) == model(A, docs)


def test_plans_of_a_stored_index(spark):
    index = corpus_index(spark, "/root/testdata/sf0.001")
    of = lambda q, **k: plan(Search(index, q, **k).hits())
    # one scan of one bucket, no shuffle
    assert of("the").count("FileScan") == 1 and "Exchange" not in of("the")
    # runs: one scan; a document's tokens aren't read for annotations of whole documents
    assert of("the+1..3").count("FileScan") == 1
    inside = of("the IN {Document lang=en}")
    assert "Window" not in inside and "tokens" not in inside and "LeftSemi" in inside
    # gaps are equi-joins, and their ranges aren't enumerated
    wide = of("is [0..60] was")
    assert "NestedLoop" not in wide and "bucket" in wide and "sequence" not in wide
    # exact numbers reach the scan
    assert "GreaterThan(n_chars,1500)" in of("{Document n_chars > 1500.5}") and "double" not in of("{Document n_chars > 1500.5}")
    # a frequency a leaf from the lexicon: no second scan of postings
    bm25 = plan(Search(index, "is | was", "bm25").scores())
    assert bm25.count("/postings") == 2
    # what comes together in one partition is a row a partition, not the ranks
    ranks = plan(Search(index, "is | was", "count").page())
    assert ranks.count("SinglePartition") == 1 and re.search(r"SinglePartition[^\n]*\n[^\n]*HashAggregate[^\n]*count", ranks)
    assert "/lexicon" in plan(t.term_type(index)) and "In(doc_id" in plan(t.documents_or(index, [1, 6, 7]))


def test_numbers_are_exact(spark):
    spans = [(1, k, 1, v, n, None) for k, (v, n) in enumerate([("007", 2**53), ("7", 2**53 + 1), ("7.0", -3), (None, None)])]
    index = make(spark, [(1, "a b c d")], spans)
    of = lambda q: sorted(r.start for r in Search(index, q).hits().collect())
    assert of("{S k=007}") == [0] and of("{S k=7}") == [1] and of("{S k=7.0}") == [2]
    assert of("{S n=9007199254740993}") == [1] and of("{S n>9007199254740992}") == [1] and of("{S n=9007199254740993.5}") == []
    assert of("{S n<-2.5}") == [2] and of("{S n<=-3.0}") == [2] and of("{S n>=-3.5}") == [0, 1, 2] and of("{S n>-3}") == [0, 1]
    assert of("{S n<99999999999999999999}") == [0, 1, 2] and of("{S n>99999999999999999999}") == [] and of("{S n>-99999999999999999999}") == [0, 1, 2]
    assert of("{S n=-99999999999999999999}") == []
    with pytest.raises(ValueError):
        of('{S n="many"}')


def test_own_processors_scorers_and_renderers(spark):
    shout = TermProcessor("shout", F.upper, str.upper)
    config = IndexConfig({"string": shout})
    docs = document_table(spark.createDataFrame([(1, "One two"), (2, "TWO two")], "doc_id bigint, text string"))
    index = SpanIndex(config, docs, posting_table(docs, config), {})
    assert bag(Search(index, "two").hits()) == Counter({(1, 1, 1): 1, (2, 0, 1): 1, (2, 1, 1): 1})
    register_scorer("twice", lambda compiler, node: compiler.hits(node).groupBy("doc_id").agg((2.0 * F.count(F.lit(1))).alias("score")))
    assert {r.doc_id: r.score for r in Search(index, "two", "twice").scores().collect()} == {1: 2.0, 2: 4.0}
    with pytest.raises(ValueError):
        register_scorer("bm25", lambda compiler, node: None)
    assert {r.html for r in Search(index, "one").rendered(renderer=lambda tokens, gaps, spans: f"{len(tokens)}:{len(spans)}").collect()} == {"2:1"}
    assert [r.link for r in Search(index, "one").metadata(link=F.concat(F.lit("/d/"), "doc_id")).collect()] == ["/d/1"]
    search = Search(index, "two", "count")
    assert search.document_at(0).first().doc_id == 2 and search.document_at(9).count() == 0 and search.hits_of(1).count() == 1
    with pytest.raises(ValueError):
        normalised_literal("x", "nope")


def test_federation(spark):
    texts = [(1, "a b"), (2, "a")], [(1, "b a b"), (5, "c")]
    one, two = (make(spark, x) for x in texts)
    both = federated(one, two.with_deleted(spark.createDataFrame([(5,)], "doc_id bigint")))
    assert bag(Search(both, "a").hits()) == Counter({(2, 0, 1): 1, (4, 0, 1): 1, (3, 1, 1): 1})
    assert Search(both, "c").documents_count() == 0 and both.documents.count() == 4
    terms = lambda f: {r.term: r["count"] for r in f.collect()}
    assert terms(t.federated_terms(t.term_type(one), t.term_type(two))) == terms(t.term_type(both)) == {"a": 3, "b": 3, "c": 1}
    with pytest.raises(ValueError):
        federated(one, SpanIndex(IndexConfig(), one.documents, one.postings, {}))


@pytest.mark.parametrize("method", ["GET", "POST"])
def test_sparql_endpoint(spark, method):
    seen = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def _answer(self, form):
            seen.append((self.command, urllib.parse.parse_qs(form)["query"][0], self.headers["Authorization"]))
            body = json.dumps({"head": {"vars": ["k", "n"]}, "results": {"bindings": [{"k": {"value": "u"}, "n": {"value": "6"}}, {"k": {"value": "v"}}]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            self._answer(self.path.partition("?")[2])

        def do_POST(self):
            self._answer(self.rfile.read(int(self.headers["Content-Length"])).decode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        provider = SparqlEndpoint(spark, f"http://127.0.0.1:{server.server_port}/q", method, "me", "secret", numbers=("n",))
        index = make(spark, [(1, "a b")], [(1, 0, 1, "u", 5, None), (1, 1, 1, "u", 6, None)])
        assert bag(Search(index, '{S sparql="SELECT ?k ?n"}', resolvers={"S": LookupResolver(provider)}).hits()) == Counter({(1, 1, 1): 1})
        assert set(seen) == {(method, "SELECT ?k ?n", "Basic bWU6c2VjcmV0")}
    finally:
        server.shutdown()
    with pytest.raises(ValueError):
        SparqlEndpoint(spark, "http://x", "PUT")


def test_a_shared_folder_is_needed_on_a_cluster(spark):
    class Elsewhere:
        """A session on a cluster without the setting."""

        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()
        sparkContext = type("S", (), {"master": "yarn", "getConf": lambda self: Elsewhere.conf, "getCheckpointDir": lambda self: None})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Elsewhere())


def test_tokens(spark):
    text = "Thîs_is a té́st — 12.5€ 日本 x"
    row = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)).alias("a"), normalised(F.col("t"), "accents").alias("b")).first()
    assert row.a == split_tokens(text) and row.b == strip_accents(text)


def test_plans_have_no_range_join(world):
    index, _ = world
    for node in (Within(A, AB), Contains(AB, C), And((A, B))):
        plan = Compiler(index).hits(node)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_descriptions_and_repair(spark):
    from spanforge.functions.text import repaired
    from spanforge.operators.resolvers import described, ontology_described

    rows = spark.createDataFrame([("http://x#Paris", "http://y#City", bytearray(b"a\xff\xfeb")), (None, "z", bytearray(b"ok")), ("plain", None, None)], "a string, b string, c binary")
    got = rows.select(ontology_described("Place", ("a", "b")).alias("o"), described(("a", "b")).alias("d"), described(("a", "b"), "[${a}|${b}]").alias("p"), repaired(F.col("c")).alias("r")).collect()
    assert [r.o for r in got] == ["Paris (City)", "Place", "plain"]
    assert got[0].d == "{a=http://x#Paris, b=http://y#City}" and got[1].d == "{b=z}" and got[2].p == "[plain|]"
    assert [r.r for r in got] == ["a[?]b", "ok", None]


def test_combined_terms_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    names = [f"terms_whole_{x}" for x in ("and", "and_sum", "or", "or_max", "or_min", "sorted")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    every = {r[0] for r in con.execute(ORACLE_SQL["terms_type"]).fetchall()}
    for name in names:
        got = [tuple(r) for r in QUERIES[name](spark, sf).collect()]
        assert Counter(got) == Counter(con.execute(ORACLE_SQL[name]).fetchall()), name
        seen = {r[0] for r in got}
        if name == "terms_whole_and":
            assert seen == every - set(t.STOP_WORDS)
        elif name != "terms_whole_and_sum":
            assert seen >= every


def test_parts_of_a_stored_index(spark, tmp_path):
    """A query builds the parts that it needs and no other, in one pass, shuffling no postings."""
    texts = [(k, f"the thing Für {k} " * 3) for k in range(40)]
    config = IndexConfig({"string": "lower", "plain": "accents"}, {"Doc": AnnotationType(nominal=("lang",), document_mode=True)})
    docs = document_table(spread(spark.createDataFrame(texts, "doc_id bigint, text string"), 3 << 20))
    features = {"plain": F.col("tokens")}
    raw = SpanIndex(config, docs, posting_table(docs, config, features), {"Doc": document_annotations(docs, docs.select("doc_id", F.lit("en").alias("lang")), config.annotation_types["Doc"])}, features=features)
    path = str(tmp_path / "index")
    there = lambda: sorted(os.path.relpath(x, path) for x in glob.glob(f"{path}/*/*=*") if "bucket" not in x) + [x for x in ("documents",) if os.path.exists(f"{path}/{x}")]
    index = raw.stored(path)
    assert Search(index, "{Doc lang=en}").hits().count() == 40 and there() == ["annotations/ann_type=Doc"]
    assert {r.term: r["count"] for r in t.term_type(index, "plain").collect()}["fur"] == 120 and there() == ["annotations/ann_type=Doc", "lexicon/feature=plain"]
    assert Search(index, "the thing").hits().count() == 120 and there() == ["annotations/ann_type=Doc", "lexicon/feature=plain", "postings/feature=string"]
    assert bag(Search(index, "plain:fur").hits()) == bag(Search(raw, "plain:fur").hits())
    lexicon = {r.term: (r["count"], r.documents) for r in index.lexicon_of("string").collect()}
    assert lexicon["thing"] == (120, 40) and lexicon["7"] == (3, 1) and sum(c for c, _ in lexicon.values()) == 480
    # a saved one has them all, and texts stand in for the arrays of their tokens
    raw.save(path)
    assert len(there()) == 6 and "tokens" not in spark.read.parquet(f"{path}/documents").columns
    assert [r.tokens for r in SpanIndex.load(spark, path, config).documents.orderBy("doc_id").select("tokens").collect()] == [r.tokens for r in docs.orderBy("doc_id").select("tokens").collect()]
    # the texts are shuffled once, and made into tokens once
    made = plan(raw.stored(str(tmp_path / "other")).raw.documents.select("doc_id", F.posexplode_outer("tokens")))
    assert made.count("Exchange") == 1
    text = plan(posting_table(docs, config, features, "string"))
    assert text.count("regexp_extract_all") == 1 and text.count("Exchange") == 1


def test_a_text_is_split_once_for_its_hits(spark):
    index = make(spark, [(1, "One, two  <three> two."), (2, "x"), (3, "two")])
    rows = sorted(map(tuple, Search(index, "two").hit_texts(1).collect()))
    assert rows == [(1, 2, 1, ",", "two", "<"), (1, 6, 1, ">", "two", "."), (3, 0, 1, "", "two", "")]
    text = plan(Search(index, "two").hit_texts(0))
    # what is joined is a document's text, and its tokens are made above the join
    assert text.index("regexp_extract_all") < text.index("Join")
