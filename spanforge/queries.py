"""Registered queries of the search engine and the DuckDB SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import terms as t
from spanforge.operators.resolvers import LookupResolver, MeasurementResolver
from spanforge.operators.results import Search
from spanforge.plans.ast import Annotation, Const, Constraint, Or, Term, Widened
from spanforge.plans.compile import Compiler
from spanforge.sources.corpus import conversation_index, corpus_index
from spanforge.sources.index import AnnotationType, IndexConfig, SpanIndex, document_annotations, document_table, federated, posting_table
from spanforge.sources.storage import numbered, shared_folder
from spanforge.streaming.ingest import Ingest, indexed, ingest

_RE = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"
_BASE = f"""WITH arrays AS (SELECT doc_id, lang, source, n_chars, regexp_extract_all(lower(coalesce(text, '')), '{_RE}') AS ts FROM documents),
sizes AS (SELECT doc_id, len(ts) AS n FROM arrays),
toks AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM arrays),
"""
_SPAN = "SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e - s AS INTEGER) AS length FROM "


def _term(name: str, term: str) -> str:
    return f"{name} AS (SELECT doc_id, pos AS s, pos + 1 AS e FROM toks WHERE term = '{term}')"


def _sql(ctes: list[str], last: str) -> str:
    return _BASE + ",\n".join(ctes) + "\n" + last


def _and(operands: str) -> str:
    """Minimal spans of tagged hits ops(op, doc_id, s, e) by brute force: candidates, less those that hold another."""
    return f"""cand AS (SELECT DISTINCT a.doc_id, least(a.s, b.s) AS s, greatest(a.e, b.e) AS e FROM ops a JOIN ops b ON a.doc_id = b.doc_id AND a.op = 0 AND b.op = {operands}),
near AS (SELECT *, min(e) OVER (PARTITION BY doc_id ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS least_e FROM cand),
spans AS (SELECT doc_id, max(s) AS s, e FROM (SELECT doc_id, s, min(e) AS e FROM near WHERE e = least_e GROUP BY doc_id, s) GROUP BY doc_id, e)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _hits(name: str, query, sql: str | None) -> None:
    _register(name, lambda spark, sf: Search(corpus_index(spark, sf), query).hits(), sql)


_hits("span_term", "thing", _sql([_term("a", "thing")], _SPAN + "a"))
_PLAIN = "p AS (SELECT doc_id, pos AS s, pos + 1 AS e FROM toks WHERE strip_accents(term) = '{}')"
_hits("span_term_feature", 'plain:"für"', _sql([_PLAIN.format("fur")], _SPAN + "p"))
_hits("span_term_length", Term("thing", length=2), _sql(["a AS (SELECT doc_id, pos AS s, pos + 2 AS e FROM toks WHERE term = 'thing')"], _SPAN + "a"))
_hits("span_phrase", "the and", _sql([_term("a", "the"), _term("b", "and"), "x AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND b.s = a.e)"], _SPAN + "x"))
_hits("span_escapes", '"\\u0074he" "AND"', ORACLE_SQL["span_phrase"])
_hits("span_right_greedy", "the and | of", _sql([_term("a", "the"), "b AS (SELECT doc_id, pos AS s, pos + 1 AS e FROM toks WHERE term IN ('and', 'of'))", "x AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND b.s = a.e)"], _SPAN + "x"))
_hits("span_gap_exact", "the [2] of", _sql([_term("a", "the"), _term("b", "of"), "x AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND b.s = a.e + 2)"], _SPAN + "x"))
_hits("span_gap_range", "the [1..5] of [0..3] and", _sql([_term("a", "the"), _term("b", "of"), _term("c", "and"), "x AS (SELECT a.doc_id, a.s, c.e FROM a JOIN b ON a.doc_id = b.doc_id AND b.s BETWEEN a.e + 1 AND a.e + 5 JOIN c ON c.doc_id = b.doc_id AND c.s BETWEEN b.e AND b.e + 3)"], _SPAN + "x"))
_hits("span_gap_wide", "is [0..60] was", _sql([_term("a", "is"), _term("b", "was"), "x AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND b.s BETWEEN a.e AND a.e + 60)"], _SPAN + "x"))
_hits("span_gap_query", Widened(Term("thing"), 3), _sql(["a AS (SELECT doc_id, pos AS s, pos + 4 AS e FROM toks WHERE term = 'thing')"], _SPAN + "a"))
_hits("span_repeats", "the+1..3", _sql([_term("a", "the"), "two AS (SELECT x.doc_id, x.s, y.e FROM a x JOIN a y ON x.doc_id = y.doc_id AND y.s = x.e)", "three AS (SELECT x.doc_id, x.s, y.e FROM two x JOIN a y ON x.doc_id = y.doc_id AND y.s = x.e)", "x AS (SELECT * FROM a UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)"], _SPAN + "x"))
_hits("span_or", "thing | (the | thing)", _sql([_term("a", "thing"), _term("b", "the"), "x AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM a)"], _SPAN + "x"))
_hits("span_and", "is & was", _sql([_term("a", "is"), _term("b", "was"), "ops AS (SELECT 0 AS op, * FROM a UNION ALL SELECT 1, * FROM b)", _and("1")], _SPAN + "spans"))
_hits(
    "span_and_three",
    "is & was & thing",
    _sql(
        [_term("a", "is"), _term("b", "was"), _term("c", "thing"), "cand AS (SELECT DISTINCT a.doc_id, least(a.s, b.s, c.s) AS s, greatest(a.e, b.e, c.e) AS e FROM a JOIN b USING (doc_id) JOIN c USING (doc_id))", "spans AS (SELECT * FROM cand x WHERE NOT EXISTS (SELECT 1 FROM cand y WHERE y.doc_id = x.doc_id AND y.s >= x.s AND y.e <= x.e AND y.e - y.s < x.e - x.s))"],
        _SPAN + "spans",
    ),
)
_hits("span_in", "was IN (is [0..20] of)", _sql([_term("a", "was"), _term("b", "is"), _term("c", "of"), "o AS (SELECT b.doc_id, b.s, c.e FROM b JOIN c ON b.doc_id = c.doc_id AND c.s BETWEEN b.e AND b.e + 20)", "x AS (SELECT * FROM a WHERE EXISTS (SELECT 1 FROM o WHERE o.doc_id = a.doc_id AND o.s <= a.s AND o.e >= a.e))"], _SPAN + "x"))
_hits("span_over", "(is [0..20] of) OVER was", _sql([_term("a", "was"), _term("b", "is"), _term("c", "of"), "o AS (SELECT b.doc_id, b.s, c.e FROM b JOIN c ON b.doc_id = c.doc_id AND c.s BETWEEN b.e AND b.e + 20)", "x AS (SELECT * FROM o WHERE EXISTS (SELECT 1 FROM a WHERE o.doc_id = a.doc_id AND o.s <= a.s AND o.e >= a.e))"], _SPAN + "x"))
_hits("span_minus", "(the | of | the) MINUS (of | thing)", _sql([_term("a", "the"), "x AS (SELECT * FROM a UNION ALL SELECT * FROM a)"], _SPAN + "x"))
_register("docs_const", lambda spark, sf: Compiler(corpus_index(spark, sf)).documents(Or((Const((3, 7, 11)), Term("was")))), _sql([_term("a", "was")], "SELECT DISTINCT doc_id FROM (SELECT doc_id FROM a UNION ALL SELECT * FROM (VALUES (3), (7), (11)) v(doc_id))"))
_hits("annotation_nominal", "{Document lang=fr}", _sql(["x AS (SELECT doc_id, 0 AS s, n AS e FROM sizes JOIN documents USING (doc_id) WHERE lang = 'fr')"], _SPAN + "x"))
_hits("annotation_numeric", "{Document n_chars > 1500.5 n_chars <= 4000}", _sql(["x AS (SELECT doc_id, 0 AS s, n AS e FROM sizes JOIN documents USING (doc_id) WHERE n_chars > 1500.5 AND n_chars <= 4000)"], _SPAN + "x"))
_hits("annotation_regex", '{Document source.REGEX("^SRC1[0-4]$", "i")}', _sql(["x AS (SELECT doc_id, 0 AS s, n AS e FROM sizes JOIN documents USING (doc_id) WHERE regexp_matches(source, '(?i)^SRC1[0-4]$'))"], _SPAN + "x"))
_hits("annotation_label", "{Label toxic=1 quality=1}", _sql(["x AS (SELECT DISTINCT doc_id, 0 AS s, n AS e, toxic, quality FROM sizes JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 1)"], _SPAN + "x"))
_hits("span_over_annotation", "{Document lang=en} OVER thing", _sql([_term("a", "thing"), "x AS (SELECT doc_id, 0 AS s, n AS e FROM sizes JOIN documents USING (doc_id) WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM a))"], _SPAN + "x"))
_hits("annotation_exact_number", "{Document n_chars>=1000.000000000000000001 n_chars<2000}", _sql(["x AS (SELECT doc_id, 0 AS s, n AS e FROM sizes JOIN documents USING (doc_id) WHERE n_chars BETWEEN 1001 AND 1999)"], _SPAN + "x"))
_hits("span_in_annotation", "(the and) IN {Document lang=en}", _sql([_term("a", "the"), _term("b", "and"), "x AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND b.s = a.e JOIN documents d ON d.doc_id = a.doc_id WHERE lang = 'en')"], _SPAN + "x"))
_register(
    "span_in_turn",
    lambda spark, sf: Search(conversation_index(spark, sf), "the IN {Turn role=user}").hits(),
    f"""WITH parts AS (SELECT conv_id AS doc_id, turn, role, regexp_extract_all(lower(coalesce(text, '')), '{_RE}') AS ts FROM conversations),
    placed AS (SELECT *, coalesce(sum(len(ts)) OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM parts),
    toks AS (SELECT doc_id, role, s, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS k FROM placed)
    SELECT doc_id, CAST(s + k AS INTEGER) AS start, CAST(1 AS INTEGER) AS length FROM toks WHERE term = 'the' AND role = 'user'""",
)
_register(
    "measurement_spec",
    lambda spark, sf: Search(corpus_index(spark, sf), '{Measurement spec="1 to 2 kchars"}', resolvers={"Measurement": MeasurementResolver()}).hits(),
    _sql(["x AS (SELECT doc_id, 0 AS s, n AS e FROM sizes JOIN documents USING (doc_id) WHERE n_chars BETWEEN 1000 AND 2000)"], _SPAN + "x"),
)


def _point(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as long as the first one."""
    first = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars is not null").orderBy("doc_id").first().n_chars
    return Search(corpus_index(spark, sf), f'{{Measurement spec="{first} chars"}}', resolvers={"Measurement": MeasurementResolver()}).hits()


_register("measurement_point", _point, _sql(["x AS (SELECT doc_id, 0 AS s, n AS e FROM sizes JOIN documents USING (doc_id) WHERE n_chars = (SELECT first(n_chars ORDER BY doc_id) FROM documents WHERE n_chars IS NOT NULL))"], _SPAN + "x"))
_EXTENT = "ends AS (SELECT doc_id, min(length(term)) AS low, max(length(term)) AS high FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '" + _RE + "')) AS term FROM documents) GROUP BY doc_id)"
for _name, _spec, _where in (("measurement_point_in_interval", "13 chars", "low <= 13 AND high >= 13"), ("measurement_interval_ends", "2 to 12 chars", "low BETWEEN 2 AND 12 OR high BETWEEN 2 AND 12")):
    _register(
        _name,
        lambda spark, sf, spec=_spec: Search(corpus_index(spark, sf), f'{{Extent spec="{spec}"}}', resolvers={"Extent": MeasurementResolver()}).hits(),
        _sql([_EXTENT, f"x AS (SELECT doc_id, 0 AS s, n AS e FROM sizes JOIN ends USING (doc_id) WHERE {_where})"], _SPAN + "x"),
    )


def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    sources = spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    resolver = LookupResolver(lambda query: sources.where(query).select("source"))
    return Search(corpus_index(spark, sf), '{Document sparql="n >= 48" lang=de}', resolvers={"Document": resolver}).hits()


_register("lookup_semi_join", _lookup, _sql(["x AS (SELECT doc_id, 0 AS s, n AS e FROM sizes JOIN documents USING (doc_id) WHERE lang = 'de' AND source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 48))"], _SPAN + "x"))

_LEAVES = [_term("a", "is"), _term("b", "was"), "tf AS (SELECT 0 AS leaf, doc_id, count(*) AS tf FROM a GROUP BY doc_id UNION ALL SELECT 1, doc_id, count(*) FROM b GROUP BY doc_id)"]
_DF = ["df AS (SELECT leaf, count(*) AS df FROM tf GROUP BY leaf)", "corpus AS (SELECT count(*) AS n, avg(n) AS mean FROM sizes)"]


def _score(name: str, query: str, scorer: str, sql: str) -> None:
    _register(name, lambda spark, sf: Search(corpus_index(spark, sf), query, scorer).scores().select("doc_id", F.round("score", 6).alias("score")), sql)


_score("score_none", "is | was", "none", _sql(_LEAVES, "SELECT DISTINCT doc_id, CAST(1 AS DOUBLE) AS score FROM tf"))
_score("score_hit_length", "is [0..40] was", "hit_length", _sql([*_LEAVES, "x AS (SELECT a.doc_id, b.e - a.s AS length FROM a JOIN b ON a.doc_id = b.doc_id AND b.s BETWEEN a.e AND a.e + 40)"], "SELECT doc_id, round(sum(CASE WHEN length < 16 THEN 1.0 ELSE pow(16.0 / length, 0.9) END), 6) AS score FROM x GROUP BY doc_id"))
_score("score_count", "is | was", "count", _sql(_LEAVES, "SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM tf GROUP BY doc_id"))
_score("score_tfidf", "is | was", "tfidf", _sql([*_LEAVES, *_DF], "SELECT doc_id, round(sum(tf * ln(n / df)), 6) AS score FROM tf JOIN df USING (leaf) CROSS JOIN corpus GROUP BY doc_id"))
_BM25 = "sum(ln(1 + (c.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * z.n / mean)))"
_score("score_bm25", "is | was", "bm25", _sql([*_LEAVES, *_DF], f"SELECT doc_id, round({_BM25}, 6) AS score FROM tf JOIN df USING (leaf) JOIN sizes z USING (doc_id) CROSS JOIN corpus c GROUP BY doc_id"))
_INSIDE = [*_LEAVES, _term("c", "of"), "o AS (SELECT a.doc_id, a.s, c.e FROM a JOIN c ON a.doc_id = c.doc_id AND c.s BETWEEN a.e AND a.e + 20)", "tb AS (SELECT doc_id, count(*) AS tf FROM b GROUP BY doc_id)", "corpus AS (SELECT count(*) AS n, avg(n) AS mean FROM sizes)", "df AS (SELECT count(*) AS df FROM tb)"]
_score("score_bm25_in", "was IN (is [0..20] of)", "bm25", _sql([*_INSIDE, "m AS (SELECT DISTINCT doc_id FROM b WHERE EXISTS (SELECT 1 FROM o WHERE o.doc_id = b.doc_id AND o.s <= b.s AND o.e >= b.e))"], f"SELECT doc_id, round({_BM25}, 6) AS score FROM m JOIN tb USING (doc_id) JOIN sizes z USING (doc_id) CROSS JOIN df CROSS JOIN corpus c GROUP BY doc_id"))
_score("score_count_over", "(is [0..20] of) OVER was", "count", _sql([*_INSIDE, "ta AS (SELECT doc_id, count(*) AS tf FROM (SELECT * FROM a UNION ALL SELECT * FROM c) GROUP BY doc_id)", "m AS (SELECT DISTINCT doc_id FROM o WHERE EXISTS (SELECT 1 FROM b WHERE o.doc_id = b.doc_id AND o.s <= b.s AND o.e >= b.e))"], "SELECT doc_id, CAST(tf AS DOUBLE) AS score FROM m JOIN ta USING (doc_id)"))
_score("score_tfidf_minus", "was MINUS (was is)", "tfidf", _sql([*_INSIDE, "m AS (SELECT DISTINCT doc_id FROM b)"], "SELECT doc_id, round(tf * ln(n / df), 6) AS score FROM m JOIN tb USING (doc_id) CROSS JOIN df CROSS JOIN corpus"))
_register(
    "score_own",
    lambda spark, sf: Search(corpus_index(spark, sf), "is | was", lambda compiler, node: compiler.hits(node).groupBy("doc_id").agg((F.max("start") - F.min("start")).cast("double").alias("score"))).scores(),
    _sql([*_LEAVES, "x AS (SELECT * FROM a UNION ALL SELECT * FROM b)"], "SELECT doc_id, CAST(max(s) - min(s) AS DOUBLE) AS score FROM x GROUP BY doc_id"),
)
_RANKED = "p AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank, * FROM (SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM tf GROUP BY doc_id))"
_register("rank_all", lambda spark, sf: Search(corpus_index(spark, sf), "is | was", "count").page(), _sql([*_LEAVES, _RANKED], "SELECT rank, doc_id, score FROM p"))
_register("documents_count", lambda spark, sf: spark.createDataFrame([(Search(corpus_index(spark, sf), "is | was").documents_count(),)], "documents bigint"), _sql(_LEAVES, "SELECT count(DISTINCT doc_id) AS documents FROM tf"))


def _csv(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    Search(corpus_index(spark, sf), "is | was", "count").csv(path, "lang", "source")
    return spark.read.schema("rank bigint, doc_id bigint, score double, uri string, title string, lang string, source string").option("header", True).csv(path)


_register("csv_export", _csv, _sql([*_LEAVES, _RANKED], "SELECT rank, doc_id, score, 'doc:' || doc_id AS uri, CAST(NULL AS VARCHAR) AS title, lang, source FROM p JOIN documents USING (doc_id)"))
_register(
    "rank_page",
    lambda spark, sf: Search(corpus_index(spark, sf), "is | was", "count").page(20, 30),
    _sql(_LEAVES, "SELECT rank, doc_id, score FROM (SELECT row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank, * FROM (SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM tf GROUP BY doc_id)) WHERE rank >= 20 AND rank < 50"),
)
_register(
    "rank_page_hits",
    lambda spark, sf: Search(corpus_index(spark, sf), "is | was", "count").page_hits(0, 10),
    _sql([*_LEAVES, "p AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank, * FROM (SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM tf GROUP BY doc_id))", "h AS (SELECT * FROM a UNION ALL SELECT * FROM b)"], "SELECT rank, doc_id, score, CAST(s AS INTEGER) AS start, CAST(e - s AS INTEGER) AS length FROM p JOIN h USING (doc_id) WHERE rank < 10"),
)
_register(
    "deleted_documents",
    lambda spark, sf: Search((i := corpus_index(spark, sf)).with_deleted(i.documents.where("doc_id % 2 = 0").select("doc_id")), "is").hits(),
    _sql([_term("a", "is")], _SPAN + "a WHERE doc_id % 2 <> 0"),
)
_register("metadata_fields", lambda spark, sf: Search(corpus_index(spark, sf), "thing").metadata("lang", "source"), _sql([_term("a", "thing")], "SELECT doc_id, 'doc:' || doc_id AS uri, CAST(NULL AS VARCHAR) AS title, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM a)"))
_register(
    "kwic",
    lambda spark, sf: Search(corpus_index(spark, sf), "thing").hit_texts(0).select("doc_id", "start", "length", "hit_text"),
    f"""WITH raw AS (SELECT doc_id, regexp_extract_all(text, '{_RE}') AS ts FROM documents WHERE text IS NOT NULL),
    toks AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM raw)
    SELECT doc_id, CAST(pos AS INTEGER) AS start, CAST(1 AS INTEGER) AS length, term AS hit_text FROM toks WHERE lower(term) = 'thing'""",
)
_WORDS = f"""WITH raw AS (SELECT doc_id, regexp_extract_all(text, '{_RE}') AS ts, string_split_regex(text, '{_RE}') AS gs FROM documents WHERE text IS NOT NULL),
toks AS (SELECT doc_id, unnest(ts) AS tok, unnest(gs[2:]) AS gap, generate_subscripts(ts, 1) - 1 AS pos FROM raw),
hit AS (SELECT a.doc_id, a.pos AS s, a.pos + 2 AS e FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE lower(a.tok) = 'the' AND lower(b.tok) = 'thing')
"""
_PART = "coalesce(string_agg(CASE WHEN pos >= {0} AND pos < {1} THEN tok || CASE WHEN pos < {1} - 1 THEN gap ELSE '' END END, '' ORDER BY pos), '')"
_register(
    "kwic_context",
    lambda spark, sf: Search(corpus_index(spark, sf), "the thing").hit_texts(5),
    _WORDS + f"SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e - s AS INTEGER) AS length, {_PART.format('s - 5', 's')} AS left_context, {_PART.format('s', 'e')} AS hit_text, "
    "coalesce(string_agg(CASE WHEN pos >= e AND pos < e + 5 THEN tok || CASE WHEN pos < e + 4 AND pos < (SELECT max(pos) FROM toks z WHERE z.doc_id = toks.doc_id) THEN gap ELSE '' END END, '' ORDER BY pos), '') AS right_context "
    "FROM hit JOIN toks USING (doc_id) GROUP BY doc_id, s, e",
)
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_register(
    "rendered_hits",
    lambda spark, sf: Search(corpus_index(spark, sf), "the thing").rendered(),
    _WORDS + f"""SELECT doc_id, string_agg(CASE WHEN x.s IS NOT NULL THEN '<span class="hit">' ELSE '' END || {_ESCAPED.format("tok")} || CASE WHEN y.e IS NOT NULL THEN '</span>' ELSE '' END || {_ESCAPED.format("gap")}, '' ORDER BY pos) AS html
    FROM toks LEFT JOIN hit x USING (doc_id) LEFT JOIN hit y USING (doc_id) WHERE FALSE GROUP BY doc_id""".replace("toks LEFT JOIN hit x USING (doc_id) LEFT JOIN hit y USING (doc_id) WHERE FALSE", "(SELECT t.doc_id, t.tok, t.gap, t.pos, (SELECT max(s) FROM hit WHERE hit.doc_id = t.doc_id AND hit.s = t.pos) AS xs, (SELECT max(e) FROM hit WHERE hit.doc_id = t.doc_id AND hit.e = t.pos + 1) AS ye FROM toks t WHERE t.doc_id IN (SELECT doc_id FROM hit))").replace("x.s", "xs").replace("y.e", "ye"),
)
_register(
    "hits_with_bindings",
    lambda spark, sf: Search(corpus_index(spark, sf), "is [0..5] was", bindings=True).hits().select("doc_id", "start", "length", *(F.col("bindings")[k][c].alias(f"{c}_{k}") for k in (0, 1) for c in ("start", "length")), F.size("bindings").alias("parts")),
    _sql([_term("a", "is"), _term("b", "was")], "SELECT a.doc_id, CAST(a.s AS INTEGER) AS start, CAST(b.e - a.s AS INTEGER) AS length, CAST(a.s AS INTEGER) AS start_0, 1 AS length_0, CAST(b.s AS INTEGER) AS start_1, 1 AS length_1, 2 AS parts FROM a JOIN b ON a.doc_id = b.doc_id AND b.s BETWEEN a.e AND a.e + 5"),
)
_AS_WRITTEN = IndexConfig({"string": "none"})


def _as_written(spark: SparkSession, sf: str) -> DataFrame:
    documents = document_table(spark.read.parquet(f"{sf}/documents.parquet"))
    return Search(SpanIndex(_AS_WRITTEN, documents, posting_table(documents, _AS_WRITTEN), {}), '"The"').hits()


_register("span_as_written", _as_written, _WORDS + "SELECT doc_id, CAST(pos AS INTEGER) AS start, CAST(1 AS INTEGER) AS length FROM toks WHERE tok = 'The'")


def _halves(spark: SparkSession, sf: str) -> list[SpanIndex]:
    config = IndexConfig()
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    tables = [document_table(texts.where(F.pmod("doc_id", F.lit(2)) == k)) for k in (0, 1)]
    return [SpanIndex(config, d, posting_table(d, config), {}) for d in tables]


_register("federated_hits", lambda spark, sf: Search(federated(*_halves(spark, sf)), "the and").hits(), _sql([_term("a", "the"), _term("b", "and"), "x AS (SELECT a.doc_id * 2 + a.doc_id % 2 AS doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND b.s = a.e)"], _SPAN + "x"))


def _terms(name: str, run: Callable, sql: str) -> None:
    _register(name, lambda spark, sf: run(corpus_index(spark, sf)), sql)


_NULLS = "CAST(NULL AS INTEGER) AS length, {} AS count, CAST(NULL AS VARCHAR) AS description"
_COUNT = _NULLS.format("count(*)")


def _in_docs(name: str, *ids: int) -> str:
    return f"{name} AS (SELECT term, count(*) AS c, count(DISTINCT doc_id) AS d FROM toks WHERE doc_id IN ({', '.join(map(str, ids))}) GROUP BY term)"


_STOPS = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
_terms("terms_type", lambda i: t.term_type(i), _sql(["x AS (SELECT 1)"], f"SELECT term, {_COUNT} FROM toks GROUP BY term"))
_terms("terms_stop_words", lambda i: t.term_type(i, stop_words=t.STOP_WORDS), _sql(["x AS (SELECT 1)"], f"SELECT term, {_COUNT} FROM toks WHERE term NOT IN ({_STOPS}) GROUP BY term"))
_terms("terms_document", lambda i: t.document_terms(i, 5), _sql([_in_docs("x", 5)], f"SELECT term, {_NULLS.format('c')} FROM x"))
_terms("terms_documents_and", lambda i: t.documents_and(i, [1, 6, 7]), _sql([_in_docs("x", 1, 6, 7)], f"SELECT term, {_NULLS.format('c')} FROM x WHERE d = 3"))
_terms("terms_documents_or", lambda i: t.documents_or(i, [1, 6, 7]), _sql([_in_docs("x", 1, 6, 7)], f"SELECT term, {_NULLS.format('c')} FROM x"))
_terms("terms_annotation", lambda i: t.annotation_terms(Compiler(i), Annotation("Document", (Constraint("lang", "=", "de"),)), "${lang}/${source}"), _sql(["x AS (SELECT doc_id, n, lang, source FROM sizes JOIN documents USING (doc_id) WHERE lang = 'de')"], "SELECT 'Document:{lang=' || lang || ', source=' || source || '}' AS term, CAST(n AS INTEGER) AS length, count(*) AS count, lang || '/' || source AS description FROM x GROUP BY ALL"))
_terms("terms_const", lambda i: t.const_terms(i, ["a", "b"], [1, 2]), "SELECT term, CAST(NULL AS INTEGER) AS length, CAST(c AS BIGINT) AS count, CAST(NULL AS VARCHAR) AS description FROM (VALUES ('a', 1), ('b', 2)) v(term, c)")
_PAIR = [_in_docs("x", 1, 6), _in_docs("y", 7, 9)]
_terms("terms_and", lambda i: t.and_terms(t.documents_or(i, [1, 6]), t.documents_or(i, [7, 9])), _sql(_PAIR, f"SELECT x.term, {_NULLS.format('x.c')} FROM x JOIN y ON x.term = y.term"))
_terms("terms_and_sum", lambda i: t.and_terms(t.documents_or(i, [1, 6]), t.documents_or(i, [7, 9]), strategy="sum"), _sql(_PAIR, f"SELECT x.term, {_NULLS.format('x.c + y.c')} FROM x JOIN y ON x.term = y.term"))
_terms("terms_or", lambda i: t.or_terms(t.documents_or(i, [1, 6]), t.documents_or(i, [7, 9])), _sql(_PAIR, f"SELECT coalesce(x.term, y.term) AS term, {_NULLS.format('coalesce(x.c, y.c)')} FROM x FULL JOIN y ON x.term = y.term"))
_terms("terms_or_max", lambda i: t.or_terms(t.documents_or(i, [1, 6]), t.documents_or(i, [7, 9]), strategy="max"), _sql(_PAIR, f"SELECT coalesce(x.term, y.term) AS term, {_NULLS.format('greatest(x.c, y.c)')} FROM x FULL JOIN y ON x.term = y.term"))
_terms("terms_or_min", lambda i: t.or_terms(t.documents_or(i, [1, 6]), t.documents_or(i, [7, 9]), strategy="min"), _sql(_PAIR, f"SELECT coalesce(x.term, y.term) AS term, {_NULLS.format('least(x.c, y.c)')} FROM x FULL JOIN y ON x.term = y.term"))
_terms("terms_sorted", lambda i: t.sorted_terms(t.documents_or(i, [1, 6, 7])), _sql([_in_docs("x", 1, 6, 7)], f"SELECT term, {_NULLS.format('c')} FROM x"))
# the same over the whole table: all terms with those that are no stop words, and lower-case terms with plain ones
_RAW = "raws AS (SELECT doc_id, strip_accents(term) AS term FROM toks)"
_WHOLE = ["x AS (SELECT term, count(*) AS c FROM toks GROUP BY term)", f"y AS (SELECT term, c FROM x WHERE term NOT IN ({_STOPS}))"]
_KINDS = ["x AS (SELECT term, count(*) AS c FROM toks GROUP BY term)", _RAW, "y AS (SELECT term, count(*) AS c FROM raws GROUP BY term)"]
_terms("terms_whole_and", lambda i: t.and_terms(t.term_type(i), t.term_type(i, stop_words=t.STOP_WORDS)), _sql(_WHOLE, f"SELECT x.term, {_NULLS.format('x.c')} FROM x JOIN y ON x.term = y.term"))
_terms("terms_whole_and_sum", lambda i: t.and_terms(t.term_type(i), t.term_type(i, "plain"), strategy="sum"), _sql(_KINDS, f"SELECT x.term, {_NULLS.format('x.c + y.c')} FROM x JOIN y ON x.term = y.term"))
_terms("terms_whole_or", lambda i: t.or_terms(t.term_type(i), t.term_type(i, "plain")), _sql(_KINDS, f"SELECT coalesce(x.term, y.term) AS term, {_NULLS.format('coalesce(x.c, y.c)')} FROM x FULL JOIN y ON x.term = y.term"))
_terms("terms_whole_or_max", lambda i: t.or_terms(t.term_type(i), t.term_type(i, "plain"), strategy="max"), _sql(_KINDS, f"SELECT coalesce(x.term, y.term) AS term, {_NULLS.format('greatest(x.c, y.c)')} FROM x FULL JOIN y ON x.term = y.term"))
_terms("terms_whole_or_min", lambda i: t.or_terms(t.term_type(i), t.term_type(i, "plain"), strategy="min"), _sql(_KINDS, f"SELECT coalesce(x.term, y.term) AS term, {_NULLS.format('least(x.c, y.c)')} FROM x FULL JOIN y ON x.term = y.term"))
_terms("terms_whole_sorted", lambda i: t.sorted_terms(t.term_type(i)), _sql(_WHOLE[:1], f"SELECT term, {_NULLS.format('c')} FROM x"))
_terms("terms_sorted_ranks", lambda i: numbered(t.sorted_terms(t.term_type(i)), "terms"), _sql(_WHOLE[:1], f"SELECT term, {_NULLS.format('c')}, row_number() OVER (ORDER BY c DESC, term) - 1 AS rank FROM x"))
_register("federated_terms", lambda spark, sf: t.federated_terms(*(t.term_type(i) for i in _halves(spark, sf))), ORACLE_SQL["terms_type"])
_terms(
    "terms_groups_of_description",
    lambda i: t.group_by_description(t.annotation_terms(Compiler(i), Annotation("Document"), "${lang}")).select("term", "count", "description"),
    _sql(["x AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY ALL)"], "SELECT array_to_string(list_sort(list(DISTINCT 'Document:{lang=' || lang || ', source=' || source || '}')), ' | ') AS term, CAST(sum(c) AS BIGINT) AS count, lang AS description FROM x GROUP BY lang"),
)
_terms("terms_limit", lambda i: t.limit_terms(t.term_type(i), 50), _sql(["x AS (SELECT term, count(*) AS c FROM toks GROUP BY term)"], f"SELECT term, {_NULLS.format('c')} FROM x ORDER BY c DESC, term LIMIT 50"))
_LANG = ["x AS (SELECT lang, source, n, count(*) AS c FROM sizes JOIN documents USING (doc_id) WHERE lang = 'de' GROUP BY ALL)"]
_terms(
    "terms_group_by_description",
    lambda i: t.group_by_description(t.annotation_terms(Compiler(i), Annotation("Document", (Constraint("lang", "=", "de"),)), "${lang}")).select("term", "count", "description"),
    _sql(_LANG, "SELECT array_to_string(list_sort(list(DISTINCT 'Document:{lang=' || lang || ', source=' || source || '}')), ' | ') AS term, CAST(sum(c) AS BIGINT) AS count, lang AS description FROM x GROUP BY lang"),
)
_terms(
    "terms_filter_by_description",
    lambda i: t.filter_by_description(t.annotation_terms(Compiler(i), Annotation("Document", (Constraint("lang", "=", "de"),)), "${source}"), ["src0", "src1"]).select("term", "length", "count", "description"),
    _sql(_LANG, "SELECT 'Document:{lang=' || lang || ', source=' || source || '}' AS term, CAST(n AS INTEGER) AS length, c AS count, source AS description FROM x WHERE source NOT IN ('src0', 'src1')"),
)


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/documents.parquet"
    schema, files = spark.read.parquet(path).schema, spark.read.parquet(path).inputFiles()
    single = len(files) == 1 and files[0].endswith("/documents.parquet")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    return source.option("pathGlobFilter", "documents.parquet").parquet(sf) if single else source.parquet(path)


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Phrase hits on an index that a stream of the documents table has built."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ingest(_stream(spark, sf).select("doc_id", "text"), f"{folder}/index", IndexConfig(), f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    documents, postings = indexed(spark, f"{folder}/index")
    return Search(SpanIndex(IndexConfig(), documents, postings, {}), "the and").hits()


def _streamed_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of a second token feature inside annotations, on an index that a stream has built and compacted."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    config = IndexConfig({"string": "lower", "plain": "accents"}, {"Document": AnnotationType(nominal=("lang",), document_mode=True)})
    whole = lambda batch, documents: document_annotations(documents, batch.select("doc_id", "lang"), config.annotation_types["Document"])
    job = Ingest(f"{folder}/index", config, features={"plain": F.col("tokens")}, annotations={"Document": whole}, compact_at=1)
    job.writer(_stream(spark, sf).select("doc_id", "lang", F.col("text").cast("binary").alias("text")), f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return Search(job.index(spark), 'plain:"für" IN {Document lang=de}').hits()


_register("stream_ingest", _streamed, ORACLE_SQL["span_phrase"])
_register("stream_ingest_annotations", _streamed_annotations, _sql([_PLAIN.format("fur")], _SPAN + "p WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase hits with their scores' parts left raw: the smallest query that uses parser, compiler and index."""
    return Search(corpus_index(spark, sf_dir), "the and").hits()
