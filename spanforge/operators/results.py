"""Results of a query: counts, ranks, hits, texts, metadata, rendering and CSV."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.resolvers import Resolver
from spanforge.operators.scoring import Scorer, ranked, scored
from spanforge.plans.ast import Node
from spanforge.plans.compile import Compiler
from spanforge.plans.parser import parse
from spanforge.sources.index import SpanIndex, unpacked

#: Tags of original markup that rendering keeps.
TAGS = ("b", "i", "u", "s", "em", "strong", "sub", "sup", "p", "h1", "h2", "h3", "ul", "ol", "li")


def text_window(position: Column, length: Column) -> Column:
    """Text of ``length`` tokens from a position on, with what stands between them, as an expression on a row of
    documents. A negative length goes to the end; null before the first token or behind the last."""
    size = F.when(length < 0, F.col("n_tokens") - position).otherwise(F.least(length, F.col("n_tokens") - position))
    size = F.greatest(size, F.lit(0))
    both = F.zip_with(F.slice("tokens", position + 1, size), F.slice("non_tokens", position + 1, size), lambda t, g: F.struct(t.alias("t"), g.alias("g")))
    joined = F.array_join(F.transform(both, lambda x, k: F.concat(x["t"], F.when(k < size - 1, F.coalesce(x["g"], F.lit(""))).otherwise(F.lit("")))), "")
    return F.when((position >= 0) & (position < F.col("n_tokens")), joined)


class Search:
    """One query on one index; every getter is a lazy frame, or a number."""

    def __init__(self, index: SpanIndex, query: str | Node, scorer: str | Scorer = "none", resolvers: dict[str, Resolver] | None = None, bindings: bool = False) -> None:
        self.index, self.scorer = index, scorer
        self.node = parse(query) if isinstance(query, str) else query
        self.compiler = Compiler(index, resolvers, bindings)

    def hits(self) -> DataFrame:
        """(doc_id, start, length) of documents that aren't deleted."""
        return self.compiler.alive(self.compiler.hits(self.node))

    def documents_count(self) -> int:
        return self.compiler.documents(self.node).count()

    def scores(self) -> DataFrame:
        return scored(self.compiler, self.node, self.scorer)

    def page(self, first: int = 0, count: int | None = None) -> DataFrame:
        """(rank, doc_id, score) of a page."""
        return ranked(self.scores(), first, count)

    def page_hits(self, first: int, count: int) -> DataFrame:
        """(rank, doc_id, score, start, length): hits of the documents of a page only."""
        return self.page(first, count).join(self.hits(), "doc_id", "left").select("rank", "doc_id", "score", "start", "length")

    def _bodies(self) -> DataFrame:
        """(doc_id, text), or tokens and non-tokens where there is no text: what a join shuffles of a document."""
        docs = self.index.documents
        return docs.select("doc_id", *(["text"] if "text" in docs.columns else ["tokens", "non_tokens"]))

    def hit_texts(self, context: int = 0, hits: DataFrame | None = None) -> DataFrame:
        """(doc_id, start, length, left_context, hit_text, right_context), with ``context`` tokens to either side."""
        marks = (hits if hits is not None else self.hits()).groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("hits"))
        docs = unpacked(self._bodies().join(marks, "doc_id"))
        # a generator is never merged with what reads it, so a text is split once, not once a hit
        docs = docs.select("doc_id", "hits", F.inline(F.array(F.struct("tokens", "non_tokens")))).withColumn("n_tokens", F.size("tokens"))

        def texts(hit: Column) -> Column:
            start, length = hit["start"], hit["length"]
            before = F.greatest(start - context, F.lit(0))
            empty = lambda c: F.coalesce(c, F.lit(""))
            left = empty(text_window(before, start - before)) if context else F.lit("")
            right = empty(text_window(start + length, F.lit(context))) if context else F.lit("")
            return F.struct(start.alias("start"), length.alias("length"), left.alias("left_context"), text_window(start, length).alias("hit_text"), right.alias("right_context"))

        return docs.select("doc_id", F.inline(F.transform("hits", texts)))

    def document_at(self, rank: int) -> DataFrame:
        """(rank, doc_id, score) of one rank; no row beyond the last."""
        return self.page(rank, 1)

    def hits_of(self, doc_id: int) -> DataFrame:
        """Hits in one document."""
        return self.hits().where(F.col("doc_id") == doc_id)

    def metadata(self, *fields: str, **derived: Column) -> DataFrame:
        """(doc_id, uri, title, fields..., derived...) of the matching documents. ``derived`` are expressions on the
        columns of the documents table, such as links made of metadata."""
        docs = self.index.documents.join(self.compiler.documents(self.node), "doc_id", "left_semi")
        return docs.select("doc_id", "uri", "title", *[F.col("metadata")[f].alias(f) for f in fields], *[c.alias(k) for k, c in derived.items()])

    def csv(self, path: str, *fields: str) -> None:
        """Matching documents with their scores and metadata as CSV files, in rank order."""
        rows = self.page().join(self.metadata(*fields), "doc_id").select("rank", "doc_id", "score", "uri", "title", *fields)
        rows.orderBy("rank").write.mode("overwrite").option("header", True).csv(path)

    def rendered(self, tags: DataFrame | None = None, renderer: Callable[[list, list, list], str] | None = None) -> DataFrame:
        """(doc_id, html): texts with hits in <span class="hit"> and, if given, tags (doc_id, start, length, tag).
        ``renderer`` may take the place of ``render``."""
        spans = self.hits().select("doc_id", "start", "length", F.lit(None).cast("string").alias("tag"))
        if tags is not None:
            known = tags.where(F.col("tag").isin(list(TAGS))).join(self.compiler.documents(self.node), "doc_id", "left_semi")
            spans = spans.unionByName(known.select("doc_id", "start", "length", "tag"))
        marks = spans.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "tag")).alias("spans"))
        rows = unpacked(self._bodies().join(marks, "doc_id")).select("doc_id", "tokens", "non_tokens", "spans")
        return rows.mapInArrow(_render(renderer or render), "doc_id bigint, html string")


def _render(renderer: Callable[[list, list, list], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [renderer(*row) for row in zip(batch.column("tokens").to_pylist(), batch.column("non_tokens").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "html"])

    return run


def render(tokens: list[str], non_tokens: list[str | None], spans: list[dict]) -> str:
    """Properly nested: an element that would cross another's end is closed there and opened again."""
    begins: dict[int, list[tuple[int, str]]] = {}
    for s in spans:
        begins.setdefault(s["start"], []).append((min(s["start"] + s["length"], len(tokens)), s["tag"] or ""))
    opening = lambda tag: f"<{tag}>" if tag else '<span class="hit">'
    closing = lambda tag: f"</{tag}>" if tag else "</span>"
    stack: list[tuple[int, str]] = []
    out: list[str] = []
    for k, token in enumerate(tokens):
        # longer elements outside, tags outside hits of the same span
        for end, tag in sorted(begins.get(k, ()), key=lambda x: (-x[0], x[1] == "", x[1])):
            held = []
            while stack and stack[-1][0] < end:
                held.append(stack.pop())
                out.append(closing(held[-1][1]))
            for item in [(end, tag), *reversed(held)]:
                stack.append(item)
                out.append(opening(item[1]))
        out.append(html.escape(token, quote=False))
        while stack and stack[-1][0] <= k + 1:
            out.append(closing(stack.pop()[1]))
        out.append(html.escape(non_tokens[k] or "", quote=False) if k < len(non_tokens) else "")
    return "".join(out)
