"""From a query tree to one lazy DataFrame of hits (doc_id, start, length), a bag.

Containment and AND are running aggregates over the tagged union of their operands, sequences are equi-joins on
document and position: Catalyst never sees a range join, and everything is partitioned by doc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.text import normalised_literal
from spanforge.operators.resolvers import ColumnResolver, Resolver, UnknownName, distinct_spans
from spanforge.plans.ast import And, Annotation, Const, Contains, Gap, Minus, Node, Or, Repeats, Sequence, Term, Widened, Within
from spanforge.sources.index import SpanIndex

_HIT = ("doc_id", "start", "length")
_BINDINGS = "array<struct<start:int,length:int>>"


def _end() -> Column:
    return F.col("start") + F.col("length")


class Compiler:
    """Compiles against one index. ``bindings``: each hit also carries the hits of its operands."""

    def __init__(self, index: SpanIndex, resolvers: dict[str, Resolver] | None = None, bindings: bool = False) -> None:
        self.index, self.resolvers, self.bindings = index, resolvers or {}, bindings

    @property
    def columns(self) -> list[str]:
        return [*_HIT, "bindings"] if self.bindings else [*_HIT]

    def hits(self, node: Node) -> DataFrame:
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    def documents(self, node: Node) -> DataFrame:
        """Distinct doc_ids that match, those of constant documents included, deleted ones left out."""
        return self.alive(self._documents(node).distinct())

    def alive(self, rows: DataFrame) -> DataFrame:
        return rows if self.index.deleted is None else rows.join(self.index.deleted.select("doc_id"), "doc_id", "left_anti")

    def _documents(self, node: Node) -> DataFrame:
        if isinstance(node, Const):
            return self._ids(node)
        if isinstance(node, Or):
            return reduce(DataFrame.union, [self._documents(n) for n in node.nodes])
        if isinstance(node, And):
            return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), [self._documents(n) for n in node.nodes])
        return self.hits(node).select("doc_id")

    def _ids(self, node: Const) -> DataFrame:
        return self.index.spark.createDataFrame([(int(x),) for x in sorted(set(node.doc_ids))], "doc_id bigint")

    def _leaf(self, rows: DataFrame) -> DataFrame:
        rows = rows.select("doc_id", F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"))
        return rows.withColumn("bindings", F.array().cast(_BINDINGS)) if self.bindings else rows

    def _term(self, node: Term) -> DataFrame:
        config = self.index.config
        feature = node.feature or config.default_feature
        if feature not in config.token_features:
            raise UnknownName(f"no token feature {feature}")
        term = normalised_literal(node.term, config.token_features[feature])
        rows = self.index.term_rows(feature, term)
        return self._leaf(rows.select("doc_id", F.col("pos").alias("start"), F.lit(node.length).alias("length")))

    def annotation_rows(self, node: Annotation) -> DataFrame:
        kinds = self.index.config.annotation_types
        if node.type not in kinds:
            raise UnknownName(f"no annotation type {node.type}")
        resolver = self.resolvers.get(node.type) or ColumnResolver()
        return resolver.rows(self.index.annotations[node.type], kinds[node.type], node.constraints)

    def _annotation(self, node: Annotation) -> DataFrame:
        rows = self.annotation_rows(node)
        return self._leaf(distinct_spans(rows, self.index.config.annotation_types[node.type], node.constraints))

    def _const(self, node: Const) -> DataFrame:
        return self._leaf(self.index.spark.createDataFrame([], "doc_id bigint, start int, length int"))

    def _widened(self, node: Widened) -> DataFrame:
        out = self.hits(node.node)
        if self.bindings:
            out = out.withColumn("bindings", F.array(F.struct("start", "length")))
        return out.withColumn("length", F.col("length") + node.gap)

    def _chain(self, left: DataFrame, right: DataFrame, gap: Gap) -> DataFrame:
        """Left hits prolonged by the right hits that start ``gap`` behind their end. Left carries ``parts`` if bindings are on."""
        right = right.select(F.col("doc_id").alias("r_doc"), F.col("start").alias("r_start"), F.col("length").alias("r_length"))
        if gap.low == gap.high:
            left = left.withColumn("next", _end() + gap.low)
            joined = left.join(right, (left.doc_id == right.r_doc) & (left.next == right.r_start))
        else:
            # a range is as wide as a bucket of positions, so it meets two of them at most, and a right hit is in one
            width = gap.high - gap.low + 1
            bucket = lambda x: F.floor(x / width)
            left = left.withColumn("next", _end()).withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("next") + gap.low), bucket(F.col("next") + gap.high)))))
            right = right.withColumn("r_bucket", bucket(F.col("r_start")))
            joined = left.join(right, (left.doc_id == right.r_doc) & (left.bucket == right.r_bucket) & right.r_start.between(left.next + gap.low, left.next + gap.high))
        out = joined.withColumn("length", (F.col("r_start") + F.col("r_length") - F.col("start")).cast("int"))
        if self.bindings:
            out = out.withColumn("bindings", F.concat("bindings", F.array(F.struct(F.col("r_start").alias("start"), F.col("r_length").alias("length")))))
        return out.select(self.columns)

    def _operand(self, node: Node) -> DataFrame:
        """Hits of a chain's first element, with themselves as their binding."""
        out = self.hits(node)
        return out.withColumn("bindings", F.array(F.struct("start", "length"))) if self.bindings else out

    def _sequence(self, node: Sequence) -> DataFrame:
        out = self._operand(node.nodes[0])
        for k, following in enumerate(node.nodes[1:]):
            out = self._chain(out, self.hits(following), node.gap(k))
        return out

    def _runs(self, node: Repeats) -> DataFrame:
        """Repeats of one-token hits: a run of adjacent ones is found with two windows over a single scan."""
        order = W.partitionBy("doc_id").orderBy("start")
        hits = self.hits(node.node).select("doc_id", "start").withColumn("run", F.col("start") - F.row_number().over(order))
        left = F.max("start").over(W.partitionBy("doc_id", "run")) - F.col("start") + 1
        each = hits.withColumn("left", left).where(F.col("left") >= node.low)
        out = each.select("doc_id", "start", F.explode(F.sequence(F.lit(node.low), F.least(F.col("left"), F.lit(node.high)))).alias("length"))
        if self.bindings:
            out = out.withColumn("bindings", F.transform(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1), lambda k: F.struct(k.cast("int").alias("start"), F.lit(1).alias("length"))))
        return out.select(self.columns)

    def _repeats(self, node: Repeats) -> DataFrame:
        if isinstance(node.node, Term) and node.node.length == 1:
            return self._runs(node)
        # one more adjacent hit a level; a hit never follows itself, as every hit has a length
        single = self.hits(node.node)
        level = self._operand(node.node)
        levels = [level]
        for _ in range(node.high - 1):
            level = self._chain(level, single, Gap())
            levels.append(level)
        return reduce(DataFrame.union, levels[node.low - 1 :])

    def _or(self, node: Or) -> DataFrame:
        return reduce(DataFrame.union, [self.hits(n) for n in node.nodes])

    def _minus(self, node: Minus) -> DataFrame:
        return self.hits(node.left).join(self.hits(node.right).select(*_HIT), [*_HIT], "left_anti").select(self.columns)

    def _and(self, node: And) -> DataFrame:
        """Shortest spans with a hit of every operand."""
        if any(isinstance(n, Const) for n in node.nodes):
            return self._const(Const(()))
        tagged = [self.hits(n).select(F.lit(k).alias("op"), "doc_id", "start", _end().alias("end")) for k, n in enumerate(node.nodes)]
        by_end = W.partitionBy("doc_id").orderBy("end").rangeBetween(W.unboundedPreceding, W.currentRow)
        latest = [F.max(F.when(F.col("op") == k, F.col("start"))).over(by_end) for k in range(len(tagged))]
        rows = reduce(DataFrame.union, tagged)
        # the latest start of each operand among hits that end here or before; the earliest of these begins the span
        rows = rows.select("doc_id", "end", *[x.alias(f"l{k}") for k, x in enumerate(latest)])
        names = [F.col(f"l{k}") for k in range(len(tagged))]
        complete = rows.where(reduce(Column.__and__, [n.isNotNull() for n in names])).withColumn("lo", F.least(*names) if len(names) > 1 else names[0])
        spans = complete.groupBy("doc_id", "lo").agg(F.min("end").alias("hi"))
        out = spans.select("doc_id", F.col("lo").cast("int").alias("start"), (F.col("hi") - F.col("lo")).cast("int").alias("length"))
        if not self.bindings:
            return out
        for k, n in enumerate(node.nodes):
            inner = self.hits(n).select(F.col("doc_id").alias("i_doc"), F.struct("start", "length").alias("i"))
            inside = (F.col("doc_id") == F.col("i_doc")) & (F.col("i.start") >= F.col("start")) & (F.col("i.start") + F.col("i.length") <= F.col("start") + F.col("length"))
            keep = ["doc_id", "start", "length", *[f"b{j}" for j in range(k)]]
            out = out.join(inner, inside).groupBy(*keep).agg(F.max("i").alias(f"b{k}"))
        return out.select(*_HIT, F.array(*[f"b{k}" for k in range(len(node.nodes))]).cast(_BINDINGS).alias("bindings"))

    def _overlap(self, left: DataFrame, right: DataFrame, bound: Column, window: W, keep: Column) -> DataFrame:
        """Left rows for which a running bound over the right ones, ordered by start with ties together, holds."""
        extra = ["bindings"] if self.bindings else []
        blank = [F.lit(None).cast(_BINDINGS).alias("bindings")] if self.bindings else []
        rows = left.select(F.lit(0).alias("side"), *_HIT, *extra).union(right.select(F.lit(1).alias("side"), *_HIT, *blank))
        return rows.withColumn("bound", bound.over(window)).where((F.col("side") == 0) & keep).select(self.columns)

    def _whole_documents(self, node: Node) -> DataFrame | None:
        """(doc_id) of an annotation over whole documents: what is in such a document is in the annotation."""
        if isinstance(node, Annotation) and (kind := self.index.config.annotation_types.get(node.type)) and kind.document_mode:
            return self.annotation_rows(node).select("doc_id")
        return None

    def _within(self, node: Within) -> DataFrame:
        if (whole := self._whole_documents(node.outer)) is not None:
            return self.hits(node.inner).join(whole, "doc_id", "left_semi").select(self.columns)
        window = W.partitionBy("doc_id").orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow)
        bound = F.max(F.when(F.col("side") == 1, _end()))
        return self._overlap(self.hits(node.inner), self.hits(node.outer), bound, window, F.col("bound") >= _end())

    def _contains(self, node: Contains) -> DataFrame:
        if self._whole_documents(node.outer) is not None:
            return self.hits(node.outer).join(self.hits(node.inner).select("doc_id"), "doc_id", "left_semi").select(self.columns)
        window = W.partitionBy("doc_id").orderBy("start").rangeBetween(W.currentRow, W.unboundedFollowing)
        bound = F.min(F.when(F.col("side") == 1, _end()))
        return self._overlap(self.hits(node.outer), self.hits(node.inner), bound, window, F.col("bound") <= _end())


def leaves(node: Node) -> list[Node]:
    """Terms and annotations on the true path, for scoring: the returned side of IN and OVER, the left of MINUS."""
    if isinstance(node, (Term, Annotation)):
        return [node]
    if isinstance(node, (And, Or, Sequence)):
        return [x for n in node.nodes for x in leaves(n)]
    if isinstance(node, (Repeats, Widened)):
        return leaves(node.node)
    if isinstance(node, Within):
        return leaves(node.inner)
    if isinstance(node, Contains):
        return leaves(node.outer)
    if isinstance(node, Minus):
        return leaves(node.left)
    return []
