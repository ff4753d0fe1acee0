"""Line dedup with a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and then by its leading tokens; tokens with a digit are
variable fields. In the leaf it joins the most similar template or starts one, and the fields in which the
lines of a template differ become variable. Templates that recur across documents are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.common import Scratch, checked_broadcast, grouped, map_batches, measured_bytes, take_memory, written
from spanforge.llm.ngram_jaccard import N, THRESHOLD
from spanforge.llm.shingles import forget, shingle_set

#: Leading tokens on the way down the tree; a line of fewer than DEPTH + 2 tokens goes down by all but two.
DEPTH = 3
#: Shorter lines never count as templates: they recur in any prose.
MIN_TOKENS = 4
#: Documents in which a template recurs independently before it is dropped.
MIN_DOCS = 3
#: Share of its tokens in which a line agrees with its template.
SIMILARITY = 0.7
#: Forms of a leaf from which its templates are looked up by their tokens, with the same result, instead of all looked at.
INDEXED = 200
#: Bytes of the hashes of recurring lines up to which they are broadcast.
HASH_BYTES = 32 << 20
FIELD = "<*>"


_DIGITS = "0123456789"
_DIGIT = re.compile("[0-9]").search


def masked_lines(text: str) -> Iterator[list[str]]:
    """The tokens of every line, between blanks of any kind, with ``<*>`` for each that has a digit."""
    # looking for a character is much faster than for a pattern
    digits = any(d in text for d in _DIGITS)
    for line in text.split("\n"):
        tokens = line.split()
        if digits and any(d in line for d in _DIGITS):
            tokens = [FIELD if _DIGIT(t) else t for t in tokens]
        yield tokens


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Leaf:
    """Templates of one leaf. Tokens are numbers; 0 is the variable field."""

    def __init__(self, similarity: float) -> None:
        self.similarity = similarity
        self.rows = np.zeros((0, 0), np.int64)
        self.n = 0

    def add(self, tokens: np.ndarray) -> int:
        """Number of the template that the line joins: the most similar one, the oldest of equals."""
        if self.n:
            mine = self.rows[: self.n]
            agree = ((mine == tokens) & (mine != 0)).sum(axis=1)
            best = int(agree.argmax())
            if agree[best] >= self.similarity * len(tokens):
                mine[best][mine[best] != tokens] = 0
                return best
        if self.n == len(self.rows):
            grown = np.zeros((max(8, 2 * self.n), len(tokens)), np.int64)
            grown[: self.n] = self.rows[: self.n] if self.n else 0
            self.rows = grown
        self.rows[self.n] = tokens
        self.n += 1
        return self.n - 1


def walked(lines: np.ndarray, similarity: float) -> np.ndarray:
    """Numbers of the templates that ``Leaf.add`` gives line after line, without looking at every template.

    A line agrees with its template in ``need`` places, so of any n - need + 1 of its places one agrees at least:
    only the templates that started with its token at those places, where fewest did, can be its own.
    """
    m, n = lines.shape
    chosen = np.empty(m, np.int64)
    need = next((k for k in range(n + 1) if k >= similarity * n), n + 1)
    if not need:
        leaf = Leaf(similarity)
        return np.array([leaf.add(line) for line in lines], np.int64)
    # a number for each token at each place, behind which there is room for the templates that start with it
    slots, counts = np.empty((m, n), np.int32), []
    for place in range(n):
        _, inverse, c = np.unique(lines[:, place], return_inverse=True, return_counts=True)
        slots[:, place] = inverse + sum(map(len, counts))
        counts.append(c)
    sizes = np.concatenate(counts)
    start, held = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
    where = np.empty(m * n, np.int32)
    rows, size, probes = np.zeros((m, n), lines.dtype), 0, n - need + 1
    for k in range(m):
        line, mine = lines[k], slots[k]
        at = mine if probes >= n else mine[np.argpartition(held[mine], max(probes - 1, 0))[:probes]]
        lists = [where[start[s] : start[s] + held[s]] for s in at.tolist() if held[s]]
        if lists:
            some = np.concatenate(lists)
            theirs = rows[some]
            agree = ((theirs == line) & (theirs != 0)).sum(axis=1)
            if (most := agree.max()) >= need:
                best = some[agree == most].min()
                rows[best][rows[best] != line] = 0
                chosen[k] = best
                continue
        rows[size] = line
        # fields agree with nothing
        real = mine[line != 0]
        where[start[real] + held[real]] = size
        held[real] += 1
        chosen[k] = size
        size += 1
    return chosen


def _generalise(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "leaf"):
            keys = t.column("masked").to_numpy()
            numbers = {FIELD: 0}
            lines = (numbers.setdefault(x, len(numbers)) for chunk in t.column("line").chunks for line in chunk.to_pylist() for x in line.split(" "))
            table = np.fromiter(lines, np.int32).reshape(len(keys), -1)
            leaf = Leaf(similarity)
            chosen = walked(table, similarity) if len(keys) > INDEXED else [leaf.add(line) for line in table]
            _, first = np.unique(chosen, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys[first[chosen]])], ["masked", "template"])

    return run


def _lines(docs: DataFrame, depth: int, min_tokens: int, whole: bool = False, once: bool = False, key: str = "bigint") -> DataFrame:
    """Lines of ``min_tokens`` or more, with the hash of their leaf and that of their masked form, and maybe that form.
    With ``once`` only the first of a row's lines of one masked form. ``key`` is the type of doc_id."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, numbers, leaves, hashes, forms = [], [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            seen = set()
            for k, tokens in enumerate(masked_lines(text)):
                if (n := len(tokens)) >= min_tokens:
                    form = " ".join(tokens)
                    if once:
                        if form in seen:
                            continue
                        seen.add(form)
                    rows.append(row)
                    numbers.append(k)
                    leaves.append(_hash(f"{n} {' '.join(tokens[: min(depth, n - 2)])}"))
                    hashes.append(_hash(form))
                    if whole:
                        forms.append(form)
        columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(leaves, pa.int64()), pa.array(hashes, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *([pa.array(forms, pa.string())] if whole else [])], ["doc_id", "line_no", "leaf", "masked", *(["line"] if whole else [])])

    texts = docs.where("text is not null").select("doc_id", "text")
    return map_batches(texts, run, f"doc_id {key}, line_no int, leaf bigint, masked bigint" + (", line string" if whole else ""))


def _shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
    take_memory("shingles", forget)
    sets = [shingle_set(t, N).view(np.int64) for t in batch.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])


def _sets(scratch: Scratch, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents in ``wanted`` (doc_id, written); of several texts of an id the first in order."""
    texts = docs.select("doc_id", "text").where("text is not null").join(checked_broadcast(wanted), "doc_id", "left_semi")
    # texts of repeated ids alone are shuffled
    again = scratch.written(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"), "again")
    if not again.isEmpty():
        again = checked_broadcast(again)
        texts = texts.join(again, "doc_id", "left_anti").unionByName(texts.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    return scratch.written(map_batches(texts, _shingles, "doc_id bigint, shingles array<bigint>"), "sets")


def _copies(scratch: Scratch, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (doc_id, head) whose sets have a Jaccard similarity of THRESHOLD or more."""
    pairs = scratch.written(pairs, "compared")
    heads = sets.select(F.col("doc_id").alias("head"), F.col("shingles").alias("others"))
    heads = scratch.written(heads.join(checked_broadcast(scratch.written(pairs.select("head").distinct(), "heads")), "head", "left_semi"), "headsets")
    both = F.size(F.array_intersect("shingles", "others"))
    # pairs are far smaller than sets: where they are few, sets are shuffled only to their heads; the heads' own
    # sets grow with the corpus, so they are merged at every size
    compared = sets.join(checked_broadcast(pairs), "doc_id").join(heads.hint("merge"), "head")
    return compared.where(both >= THRESHOLD * (F.size("shingles") + F.size("others") - both)).select("doc_id", "head")


def _at_once(scratch: Scratch, docs: DataFrame, votes: DataFrame, min_docs: int) -> DataFrame:
    """Templates of which ``min_docs`` documents, picked by hash, are no copies of each other: most that recur."""
    picks = votes.groupBy("template").agg(F.array_distinct(F.array(*(F.min_by("doc_id", F.struct(F.xxhash64(F.lit(k), "doc_id"), "doc_id")) for k in range(min_docs)))).alias("picks"))
    picks = scratch.written(picks.where(F.size("picks") == min_docs).select("template", F.array_sort("picks").alias("picks")), "picks")
    sets = _sets(scratch, docs, scratch.written(picks.select(F.explode("picks").alias("doc_id")).distinct(), "picked"))
    pairs = [picks.select("template", F.col("picks")[a].alias("head"), F.col("picks")[b].alias("doc_id")) for a, b in combinations(range(min_docs), 2)]
    if not pairs:
        return picks.select("template")
    each = scratch.written(reduce(DataFrame.union, pairs), "pairs")
    copies = scratch.written(_copies(scratch, each.select("doc_id", "head").distinct(), sets), "copies")
    bad = each.join(checked_broadcast(copies), ["doc_id", "head"], "left_semi").select("template").distinct()
    return picks.select("template").join(bad, "template", "left_anti")


def _carried(scratch: Scratch, docs: DataFrame, votes: DataFrame, min_docs: int) -> DataFrame:
    """Templates of ``votes`` (template, doc_id) that ``min_docs`` documents have of which no two are copies.

    The longest document is counted, its copies are struck out, and so on: longest first, so that an excerpt
    can't stand for all the documents that hold it.
    """
    sets = _sets(scratch, docs, scratch.written(votes.select("doc_id").distinct(), "voters"))
    # documents of equal sets are one, so thousands of exact copies cost one row
    named = sets.select("doc_id", F.size("shingles").alias("size"), F.xxhash64("shingles").alias("set"))
    one = scratch.written(named.select("doc_id", "size", F.min("doc_id").over(Window.partitionBy("set")).alias("one")), "one")
    left = votes.join(one, "doc_id").select("template", "size", F.col("one").alias("doc_id")).distinct()
    for k in range(1, min_docs + 1):
        left = scratch.written(left, "left")
        heads = left.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min_by("doc_id", F.struct(-F.col("size"), F.col("doc_id"))).alias("head"))
        heads = scratch.written(heads.where(F.col("n") + (k - 1) >= min_docs).select("template", "head"), "heads")
        if k == min_docs or heads.isEmpty():
            return heads.select("template")
        rest = left.join(heads, "template").where("doc_id <> head")
        copies = scratch.written(_copies(scratch, rest.select("doc_id", "head").distinct(), sets), "copies")
        left = rest.join(checked_broadcast(copies), ["doc_id", "head"], "left_anti").select("template", "size", "doc_id")


def _recurring(docs: DataFrame, min_docs: int, depth: int, min_tokens: int, similarity: float) -> DataFrame:
    """(masked, template): the hash of every masked line whose template recurs."""
    scratch = Scratch()
    each = scratch.written(_lines(docs, depth, min_tokens, once=True).select("doc_id", "leaf", "masked"), "lines")
    # a masked form has one leaf; rows of one id are told apart only where votes are counted
    forms = scratch.written(each.groupBy("leaf", "masked").agg(F.count("doc_id").alias("d")), "forms")
    leaves = forms.groupBy("leaf").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("m"))
    # leaves of one form need no walk, and those that too few documents reach hold no recurring template
    forked = scratch.written(leaves.where((F.col("m") > 1) & (F.col("d") >= min_docs)).select("leaf"), "forked")
    formed = scratch.written(_lines(docs, depth, min_tokens, True).select("leaf", "masked", "line").join(checked_broadcast(forked), "leaf").groupBy("leaf", "masked", "line").agg(F.count(F.lit(1)).alias("c")), "formed")
    walk = formed.repartition("leaf").sortWithinPartitions("leaf", F.desc("c"), "line").mapInArrow(_generalise(similarity), "masked bigint, template bigint")
    mapped = scratch.written(walk, "templates")
    named = forms.join(checked_broadcast(mapped), "masked", "left").select("masked", "d", F.coalesce("template", "masked").alias("template"))
    # most lines of prose are seen once: what can't recur goes before documents are counted
    few = named.groupBy("template").agg(F.sum("d").alias("all")).where(F.col("all") >= min_docs).select("template")
    possible = scratch.written(named.join(few, "template", "left_semi").select("masked", "template"), "possible")
    votes = scratch.written(each.where("doc_id is not null").join(checked_broadcast(possible), "masked").select("template", "doc_id").distinct(), "votes")
    shared = votes.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template")
    at_once = scratch.written(_at_once(scratch, docs, votes.join(shared, "template", "left_semi"), min_docs), "at_once")
    open_ = votes.join(shared, "template", "left_semi").join(checked_broadcast(at_once), "template", "left_anti")
    recurring = scratch.written(at_once.union(_carried(scratch, docs, scratch.written(open_, "open"), min_docs)), "recurring")
    out = written(possible.join(checked_broadcast(recurring), "template", "left_semi"), "recurring-lines")
    scratch.discard()
    return out


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, line_no, template) of every line whose template recurs.

    A template recurs if ``min_docs`` documents or more have it of which no two are copies of each other.
    Copies are what near-copy removal takes for copies: word trigram sets of a Jaccard similarity of 0.5 or
    more. Their lines come from being copied whole and don't make a template of prose. Rows of one doc_id are
    one document; rows without an id are none, but their lines may have templates of others.
    """
    found = _recurring(docs, min_docs, depth, min_tokens, similarity)
    return _lines(docs, depth, min_tokens).select("doc_id", "line_no", "masked").join(checked_broadcast(found), "masked").select("doc_id", "line_no", "template")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, with all their columns, without the lines whose template recurs (see ``recurring_lines``).

    Adds ``n_dropped``, in place of any column of that name. Every line of a text of any length is looked at; other
    lines stay as they are. Null texts stay null, empty ones empty; texts without an id lose recurring lines too.
    Every row is treated by its own text, also where rows repeat a doc_id. In a leaf the commonest form comes
    first, of equally common ones the first in order. An empty table stays empty.
    """
    found = _recurring(docs, min_docs, depth, min_tokens, similarity).select("masked")
    out = docs.drop("n_dropped")
    if measured_bytes(found) <= HASH_BYTES:
        gone = docs.sparkSession.sparkContext.broadcast(np.unique(found.toArrow().column("masked").to_numpy()))
        return map_batches(out, _without(gone, min_tokens), T.StructType([*out.schema.fields, T.StructField("n_dropped", T.IntegerType())]))
    # too many to hold: the places of recurring lines are joined to the rows by their texts, of which no two may share a
    # key, or one would lose the lines of the other only in a large input
    key = lambda text: F.unhex(F.sha2(text, 256))
    texts = docs.where("text is not null").select(key(F.col("text")).alias("doc_id"), "text").groupBy("doc_id").agg(F.first("text").alias("text"))
    places = _lines(texts, depth, min_tokens, key="binary").join(found, "masked", "left_semi").groupBy(F.col("doc_id").alias("key")).agg(F.collect_set("line_no").alias("gone"))
    places = written(places, "places")
    joined = out.select(F.struct(*out.columns).alias("row")).join(places, key(F.col("row.text")) == places["key"], "left")
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, k: ~F.array_contains("gone", k)), "\n")
    text = F.when(F.col("gone").isNotNull(), left).otherwise(F.col("row.text"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in out.columns], F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"))


def _without(gone, min_tokens: int):
    """Lines whose hash is in the set are left out; their number becomes a last column."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = gone.value
        where = batch.schema.get_field_index("text")
        texts = batch.column(where).to_pylist()
        rows, numbers, hashes = [], [], []
        for row, text in enumerate(texts if len(known) else ()):
            for k, tokens in enumerate(masked_lines(text or "")):
                if len(tokens) >= min_tokens:
                    rows.append(row)
                    numbers.append(k)
                    hashes.append(_hash(" ".join(tokens)))
        counts = np.zeros(len(texts), np.int32)
        if hashes:
            mine = np.array(hashes, np.int64)
            hit = np.flatnonzero(known[np.minimum(known.searchsorted(mine), len(known) - 1)] == mine)
            gone_of: dict[int, set[int]] = {}
            for j in hit.tolist():
                gone_of.setdefault(rows[j], set()).add(numbers[j])
            for row, gone_lines in gone_of.items():
                counts[row] = len(gone_lines)
                texts[row] = "\n".join(x for k, x in enumerate(texts[row].split("\n")) if k not in gone_lines)
        changed = pa.array(texts, batch.schema.field(where).type) if counts.any() else batch.column(where)
        columns = [changed if k == where else c for k, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts)], [*batch.schema.names, "n_dropped"])

    return run
