"""Mixing sources to target weights by entropy balancing.

Document rates r = exp(x . lambda), with x a document's source, language and standardised log length, are the
tilting of the corpus, nearest in relative entropy over tokens, whose token totals meet the constraints. The
dual is convex. A source's multiplier has a closed form given the others, so Newton's iterations run over those
of the languages and of length; every step sums value, gradient and Hessian over all documents and sources.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import checked_broadcast, discard, written

#: Default targets: a source's weight is its share of the tokens to this power, so that small sources gain.
TEMPER = 0.8
#: Largest miss of a share at which Newton's iterations end, and at which a constraint counts as met.
TOLERANCE, MET = 1e-9, 1e-6
MAX_STEPS = 50
#: Exponents beyond this overflow: constraints that drive a multiplier there can't be met.
_OVERFLOW = 300.0
_LARGEST_INT = 2**31 - 1
_COPIES = "copies of a document don't fit an int: give a budget of tokens, or targets that are less far apart"


def _features(docs: DataFrame) -> DataFrame:
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("bigint")
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), tokens.alias("n_tokens"))


def _sums(batches: Iterator[pa.RecordBatch], multipliers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Value, gradient and Hessian of the dual over the sources of a partition, from cells (source, at, share, s0, s1, s2)."""
    size = len(multipliers) + 1
    value, gradient, hessian = 0.0, np.zeros(size), np.zeros((size, size))
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        source = table.column("source").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        at, share, s0, s1, s2 = (table.column(c).to_numpy() for c in ("at", "share", "s0", "s1", "s2"))
        # multipliers may be large: only their differences matter within a source
        top = multipliers.max()
        e = np.exp(multipliers[at] - top)
        n = source.max() + 1
        z, first = np.bincount(source, e * s0, n), np.zeros(n)
        first[source] = share
        q = np.zeros((n, size))
        np.add.at(q, (source, at), e * s0 / z[source])
        q[:, -1] = np.bincount(source, e * s1, n) / z
        value = float((first * (np.log(z) + top)).sum())
        gradient = first @ q
        # covariance of the features under each source's tilted tokens
        hessian = -(q * first[:, None]).T @ q
        hessian[np.arange(size - 1), np.arange(size - 1)] += gradient[:-1]
        mixed = np.bincount(at, first[source] * e * s1 / z[source], size - 1)
        hessian[:-1, -1] += mixed
        hessian[-1, :-1] += mixed
        hessian[-1, -1] += (first * np.bincount(source, e * s2, n) / z).sum()
    yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([gradient.tolist()]), pa.array([hessian.ravel().tolist()])], ["value", "gradient", "hessian"])


class Solution:
    """Multipliers of the dual. ``sources`` (source, of_source) is a table, since sources may be many; languages
    are a dict. ``met`` says which constraints hold: sources always, languages and length if the corpus can."""

    def __init__(self, sources: DataFrame, languages: dict, tilt: float, mean: float, scale: float, least: float, most: float, total: float, residual: float, met: str) -> None:
        self.sources, self.languages, self.tilt, self.mean, self.scale = sources, languages, tilt, mean, scale
        self.least, self.most, self.total, self.residual, self.met = least, most, total, residual, met


def solve(features: DataFrame, targets: dict | None = None, temper: float = TEMPER, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> Solution | None:
    """The dual's solution over (source, lang, n_tokens), a written table; None without tokens.

    Constraints: every source's tokens have its target share; every language keeps its share of the tokens,
    and so does the token-weighted mean of log length. Where a corpus can't meet them all, the mean length is
    given up, then the languages; sources alone can always be met, however small a share. The driver gets one
    row a language, and of each partition one vector and one matrix as wide as there are languages.
    """
    spark = features.sparkSession
    rows = features.where("n_tokens > 0")
    have = written(rows.groupBy("source").agg(F.sum("n_tokens").alias("have")), "sources")
    whole = have.agg(F.sum("have")).first()[0]
    if not whole:
        return None
    if targets is None:
        weighted = have.withColumn("w", F.pow(F.col("have") / F.lit(float(whole)), F.lit(temper)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in targets.items() if v > 0], "wanted string, w double")
        weighted = have.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("wanted"))).drop("wanted")
    weight, total = weighted.agg(F.sum("w"), F.sum("have")).first()
    if not weight:
        raise ValueError("no source of the table has a positive target weight")
    shares = written(weighted.select("source", (F.col("w") / F.lit(weight)).alias("share")), "shares")
    near = checked_broadcast(shares.withColumnRenamed("source", "of"))
    wanted = rows.join(near, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    moments = wanted.agg(F.sum(F.col("n_tokens") * F.log1p("n_tokens")).alias("m"), F.sum(F.col("n_tokens") * F.log1p("n_tokens") ** 2).alias("q")).first()
    mean = moments.m / total
    scale = math.sqrt(max(moments.q / total - mean**2, 0)) or 1.0
    by_lang = {r.lang: r.n for r in wanted.groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()}
    languages = sorted(by_lang, key=lambda x: (x is None, x or ""))
    numbers = F.broadcast(spark.createDataFrame([(x, k) for k, x in enumerate(languages)], "of_lang string, at int"))
    cells = written(wanted.join(numbers, F.col("lang").eqNullSafe(F.col("of_lang"))).select("source", "at", "share", "n_tokens"), "cells")
    z = (F.log1p("n_tokens") - F.lit(mean)) / F.lit(scale)
    low, high = cells.agg(F.min(z), F.max(z)).first()
    furthest = max(abs(low), abs(high))
    goal = np.array([*(by_lang[x] / total for x in languages), 0.0])

    def summed(tilt: float) -> DataFrame:
        """Token sums by source and language, weighted with the tilt by length."""
        w = F.col("n_tokens") * F.exp(F.lit(float(tilt)) * z)
        return cells.groupBy("source", "at").agg(F.first("share").alias("share"), F.sum(w).alias("s0"), F.sum(w * z).alias("s1"), F.sum(w * z * z).alias("s2"))

    flat = written(summed(0.0), "flat")

    def state(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        multipliers, tilt = x[:-1], float(x[-1])
        by_cell = (summed(tilt) if tilt else flat).repartition("source")
        parts = by_cell.mapInArrow(lambda batches: _sums(batches, multipliers), "value double, gradient array<double>, hessian array<double>").collect()
        value, gradient, hessian = (sum(np.array(p[k]) for p in parts) for k in range(3))
        return float(value - goal @ x), gradient - goal, hessian.reshape(len(x), len(x))

    def newton(free: np.ndarray) -> tuple[np.ndarray, float]:
        """Multipliers, those that aren't free being 0, and the largest miss of a free constraint."""
        dual = np.zeros(len(languages) + 1)
        value, gradient, hessian = state(dual)
        for _ in range(max_steps):
            if not len(free) or np.abs(gradient[free]).max() < tolerance:
                break
            # languages' shares sum to one, so the Hessian is singular along one direction: least squares
            direction = np.zeros(len(dual))
            direction[free] = -np.linalg.lstsq(hessian[np.ix_(free, free)], gradient[free], rcond=1e-12)[0]
            size = 1.0
            while size > 1e-6:
                trial = dual + size * direction
                if np.ptp(trial[:-1]) < _OVERFLOW and abs(trial[-1]) * furthest < _OVERFLOW:
                    after = state(trial)
                    if after[0] <= value + 1e-4 * size * float(gradient @ direction) + 1e-14:
                        break
                size /= 2
            else:
                break
            dual, (value, gradient, hessian) = trial, after
        return dual, float(np.abs(gradient[free]).max()) if len(free) else 0.0

    # a corpus may be unable to meet all constraints: the one on length is given up first, then those on languages
    every = np.arange(len(languages) + 1)
    for free, met in ((every, "sources, languages, length"), (every[:-1], "sources, languages"), (every[:0], "sources")):
        dual, residual = newton(free)
        if residual < MET:
            break
    tilt = float(dual[-1])
    of_lang = F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in enumerate(dual[:-1])], "at int, of_lang double"))
    tilted = summed(tilt).join(of_lang, "at")
    sources = tilted.groupBy("source").agg((F.log(F.first("share") * F.lit(float(total))) - F.log(F.sum(F.exp("of_lang") * F.col("s0")))).alias("of_source"))
    sources = written(sources, "multipliers")
    ends = cells.groupBy("source", "at").agg(F.min(z).alias("low"), F.max(z).alias("high")).join(of_lang, "at").join(checked_broadcast(sources.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
    low, high = (F.col("of_source") + F.col("of_lang") + F.lit(tilt) * F.col(c) for c in ("low", "high"))
    least, most = ends.agg(F.min(F.least(low, high)), F.max(F.greatest(low, high))).first()
    discard(have, shares, cells, flat)
    return Solution(sources, dict(zip(languages, dual[:-1].tolist())), tilt, mean, scale, least, most, float(total), residual, met)


def _rated(docs: DataFrame, targets: dict | None, temper: float, seed: int, budget: float | None) -> DataFrame:
    """The rows of ``docs`` as a struct ``row`` beside their n_tokens, rate, copies and met: an expression of each row's own values."""
    spark = docs.sparkSession
    features = written(_features(docs), "lengths")
    dual = solve(features, targets, temper)
    discard(features)
    tokens = F.coalesce(F.regexp_count("row.text", F.lit(r"\S+")), F.lit(0)).cast("bigint")
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("n_tokens", tokens)
    if dual is None:
        return rows.withColumns({"rate": F.lit(1.0), "copies": F.lit(1).cast("int"), "met": F.lit(None).cast("string")})
    # rates in logarithms, so that a source of a share of 1e-100 doesn't overflow
    shift = -dual.least if budget is None else math.log(budget / dual.total)
    if dual.most + shift > math.log(_LARGEST_INT):
        raise ValueError(_COPIES)
    by_source = checked_broadcast(dual.sources.withColumnRenamed("source", "s_source"))
    by_lang = F.broadcast(spark.createDataFrame(list(dual.languages.items()), "l_lang string, of_lang double"))
    joined = rows.join(by_source, F.col("row.source").cast("string").eqNullSafe(F.col("s_source")), "left").join(by_lang, F.col("row.lang").cast("string").eqNullSafe(F.col("l_lang")), "left")
    z = (F.log1p("n_tokens") - F.lit(dual.mean)) / F.lit(dual.scale)
    tilted = F.exp(F.col("of_source") + F.col("of_lang") + F.lit(dual.tilt) * z + F.lit(shift))
    unwanted = F.col("of_source").isNull() & F.lit(targets is not None)
    u = F.pmod(F.xxhash64(F.lit(seed), "row.doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    kept = F.greatest(tilted, F.lit(1.0)) if budget is None else tilted
    rate = F.when(unwanted, 0.0).when((F.col("n_tokens") == 0) | F.col("of_source").isNull() | F.col("of_lang").isNull(), 1.0).otherwise(kept)
    rated = joined.select("row", "n_tokens", rate.alias("rate"))
    return rated.withColumns({"copies": F.floor(F.col("rate") + u).cast("int"), "met": F.lit(dual.met)})


def mixing_rates(docs: DataFrame, targets: dict | None = None, temper: float = TEMPER, seed: int = 7, budget: float | None = None) -> DataFrame:
    """(doc_id, source, lang, n_tokens, rate, copies, met) of every document.

    ``rate`` meets the target shares (see ``solve``). Without a ``budget`` it is scaled so that the smallest is 1:
    the least total at which no document of a wanted source is lost. With one, the expected tokens are the budget,
    and rates below 1 sample. ``copies`` rounds with the probability of the fraction, decided by a hash of doc_id,
    so totals hold in expectation and a rerun agrees. ``met`` names the constraints that hold. Copies that don't
    fit an int raise an error.

    Sources or languages that are null form a group of their own. Null and empty texts have no tokens and
    don't move the balance: rate 1. With explicit targets, sources without one get rate 0. Repeated rows are
    documents of their own with equal copies; equal targets are no special case. Texts of any length count whole.
    Other columns are ignored. Without any token every rate is 1; an empty table gives no rows.
    """
    return _rated(docs, targets, temper, seed, budget).select("row.doc_id", "row.source", "row.lang", "n_tokens", "rate", "copies", "met")


def mix(docs: DataFrame, targets: dict | None = None, temper: float = TEMPER, seed: int = 7, budget: float | None = None) -> DataFrame:
    """The documents with all their columns, each repeated as often as its copies of ``mixing_rates`` say."""
    rated = _rated(docs, targets, temper, seed, budget).where("copies > 0")
    return rated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
