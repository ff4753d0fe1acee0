"""Scores of documents and their ranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.text import normalised_literal
from spanforge.plans.ast import Annotation, Node, Or, Term
from spanforge.plans.compile import Compiler, leaves
from spanforge.sources.storage import numbered

HIT_LENGTH, HIT_ALPHA = 16, 0.9
#: The usual constants of BM25.
K1, B = 1.2, 0.75
SCORERS = ("none", "hit_length", "count", "tfidf", "bm25")
#: Gives (doc_id, score) of a query; documents that it leaves out score 0.
Scorer = Callable[[Compiler, Node], DataFrame]
#: Further scorers by name.
_REGISTERED: dict[str, Scorer] = {}


def register_scorer(name: str, scorer: Scorer) -> None:
    if name in SCORERS:
        raise ValueError(f"{name} is a scorer already")
    _REGISTERED[name] = scorer


def hit_length(hits: DataFrame, h: int = HIT_LENGTH, alpha: float = HIT_ALPHA) -> DataFrame:
    """Sum over hits: 1 below the length h, else (h / length) ** alpha."""
    each = F.when(F.col("length") < h, F.lit(1.0)).otherwise(F.pow(F.lit(float(h)) / F.col("length"), F.lit(alpha)))
    return hits.groupBy("doc_id").agg(F.sum(each).alias("score"))


def _leaf_counts(compiler: Compiler, node: Node) -> DataFrame:
    """(leaf, doc_id, tf) over the whole corpus, one leaf for each different term or annotation of the true path."""
    each = list(dict.fromkeys(leaves(node)))
    plain = Compiler(compiler.index, compiler.resolvers)
    parts = [plain.hits(x).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tf")).select(F.lit(k).alias("leaf"), "doc_id", "tf") for k, x in enumerate(each)]
    return reduce(DataFrame.union, parts) if parts else compiler.index.spark.createDataFrame([], "leaf int, doc_id bigint, tf bigint")


def _frequencies(compiler: Compiler, node: Node, counts: DataFrame) -> DataFrame:
    """(leaf, df), a row a leaf; of terms from the lexicon, if the index has one, without reading their postings again."""
    each = list(dict.fromkeys(leaves(node)))
    default = compiler.index.config.default_feature
    known = [compiler.index.documents_of_term(x.feature or default, normalised_literal(x.term, compiler.index.config.token_features[x.feature or default])) if isinstance(x, Term) else None for x in each]
    if not each or any(k is None for k in known):
        return counts.groupBy("leaf").agg(F.count(F.lit(1)).alias("df"))
    return reduce(DataFrame.union, [k.select(F.lit(i).alias("leaf"), F.col("documents").alias("df")) for i, k in enumerate(known)])


def _any_leaf(node: Node) -> bool:
    """Whether the documents that match are those with any of the leaves."""
    return isinstance(node, (Term, Annotation)) or (isinstance(node, Or) and all(map(_any_leaf, node.nodes)))


def scored(compiler: Compiler, node: Node, scorer: str | Scorer = "none", k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) of the matching documents that aren't deleted.

    A scorer is a name of SCORERS, a registered one, or a function.

    count: occurrences of the leaves; tfidf: sum of tf * ln(N / df); bm25: Robertson and Zaragoza's, with
    ln(1 + (N - df + 0.5) / (df + 0.5)). Corpus statistics also cover deleted documents.
    """
    own = scorer if callable(scorer) else _REGISTERED.get(scorer)
    if own is None and scorer not in SCORERS:
        raise ValueError(f"unknown scorer: {scorer}")
    matching = compiler.documents(node)
    if own is not None:
        return matching.join(own(compiler, node), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    if scorer == "none":
        return matching.withColumn("score", F.lit(1.0))
    if scorer == "hit_length":
        return matching.join(hit_length(compiler.hits(node)), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    counts = _leaf_counts(compiler, node)
    if scorer == "count":
        values = counts.groupBy("doc_id").agg(F.sum("tf").cast("double").alias("score"))
    else:
        sizes = compiler.index.documents.select("doc_id", "n_tokens")
        corpus = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean"))
        frequency = _frequencies(compiler, node, counts)
        # a row a leaf and a row for the corpus: both are as small as the query, whatever the corpus
        joined = counts.join(F.broadcast(frequency), "leaf").crossJoin(F.broadcast(corpus))
        if scorer == "tfidf":
            value = F.col("tf") * F.log(F.col("n") / F.col("df"))
        else:
            joined = joined.join(sizes, "doc_id")
            weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
            value = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / F.col("mean")))
        values = joined.groupBy("doc_id").agg(F.sum(value).alias("score"))
    if _any_leaf(node):
        # the leaves were read already: no second scan for the documents
        return compiler.alive(values)
    return matching.join(values, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def ranked(scores: DataFrame, first: int = 0, count: int | None = None) -> DataFrame:
    """(rank, doc_id, score): by falling score, then by doc_id. A page of ``count`` from ``first`` on is a top-k. Without
    a count all are ranked, and no task has them all."""
    order = [F.desc("score"), F.asc("doc_id")]
    if count is not None:
        page = scores.orderBy(*order).limit(first + count)
        out = page.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("bigint") - 1)
    else:
        out = numbered(scores.orderBy(*order), "ranked")
    return out.where(F.col("rank") >= first).select("rank", "doc_id", "score")
