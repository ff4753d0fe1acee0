"""N-gram Jaccard join: texts whose word n-gram sets are similar.

Bayesian candidate pruning (BayesLSH-Lite): candidates share a band of MinHash values; their sketches
are compared a few values at a time and a pair is dropped as soon as the posterior probability that its
similarity reaches the threshold falls below a tolerance; what is left is verified on the whole sets.

Texts of equal sets are one class, named by its first document: the smallest doc_id and the hash of its text.
A bucket with many members is split into blocks, and every pair of blocks is a task of its own.

Links are counted pair by pair. Groups need no more pairs than join them: every member of a bucket is first compared
with the bucket's first, and after that only with members that aren't in its group yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import checked_broadcast, discard, grouped, map_batches, take_memory, written
from spanforge.llm.shingles import forget, shingle_set, sketch

N = 3
THRESHOLD = 0.5
SIZE = 144
ROWS = 3
STEP = 16
TOLERANCE = 0.001
#: Members of a block of a bucket, and n-grams that they have together: what a task holds twice.
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000
#: Members of either side of a task of pairs that join groups.
SIDE = 500


@lru_cache(maxsize=64)
def least_matches(threshold: float, tolerance: float, size: int, step: int) -> tuple[tuple[int, int], ...]:
    """(values compared, matches needed) at every step.

    With a uniform prior the posterior of the similarity after m matches in c comparisons is
    Beta(m + 1, c - m + 1), whose tail above the threshold is a binomial sum.
    """
    out = []
    for c in [*range(step, size, step), size]:
        n = c + 1
        tail, m = 0.0, 0
        # P(Beta(m+1, c-m+1) >= t) = P(Binomial(c+1, t) <= m)
        while m <= c:
            tail += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((c, m))
    return tuple(out)


def text_key(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text)


def _features(n: int, size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        take_memory("shingles", forget)
        keys, counts, sketches = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text, n)
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            counts.append(len(s))
            sketches.append(sketch(s, size).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(sketches, pa.binary())],
            ["doc_id", "text_key", "set_key", "n_shingles", "sketch"],
        )

    return run


def survivors(left: np.ndarray, right: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, band: int, rows: int, rules, threshold: float, labels: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of a member of ``left`` with later ones of ``right`` (places) that aren't pruned, each only in the
    first band that its sketches share. Where both are the same, a pair comes once. With ``labels``, pairs of one
    label are left out.

    The two sizes bound the similarity from above by min / max, which prunes exactly.
    """
    within = left is right
    for k, i in enumerate(left.tolist()):
        rest = right[k + 1 :] if within else right
        if labels is not None:
            rest = rest[labels[rest] != labels[i]]
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= threshold * np.maximum(sizes[rest], sizes[i]) - 1e-9]
        if band and len(rest):
            same = (sketches[rest, : band * rows] == sketches[i, : band * rows]).reshape(len(rest), band, rows)
            rest = rest[~same.all(axis=2).any(axis=1)]
        matches, done = np.zeros(len(rest), np.int64), 0
        for c, least in rules:
            if not len(rest):
                break
            matches = matches + (sketches[rest, done:c] == sketches[i, done:c]).sum(axis=1)
            done = c
            stay = matches >= least
            rest, matches = rest[stay], matches[stay]
        if len(rest):
            yield i, rest


_PAIR = ("task", "a", "a_text", "a_members", "b", "b_text", "b_members")


def _prune(size: int, rows: int, threshold: float, tolerance: float, step: int):
    rules = least_matches(threshold, tolerance, size, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "task"):
            if t.num_rows < 2:
                continue
            sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, size)
            side = t.column("side").to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            found = [(np.full(len(rest), i), rest) for i, rest in survivors(left, right if len(right) else left, sketches, t.column("n_shingles").to_numpy(), t.column("band")[0].as_py(), rows, rules, threshold)] if t.column("pairs")[0].as_py() == 1 or len(right) else []
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found))
            columns = [t.column(c).to_numpy() for c in ("rep", "text_key", "members")]
            arrays = [pa.array(np.full(len(a), t.column("task")[0].as_py())), *(pa.array(c[x]) for x in (a, b) for c in columns)]
            yield from pa.Table.from_arrays(arrays, list(_PAIR)).to_batches(50_000)

    return run


def _alike(size: int, threshold: float, tolerance: float, step: int):
    """Pairs with both sketches that aren't pruned, by the rules of ``survivors``."""
    rules = least_matches(threshold, tolerance, size, step)
    starts, least = [0, *(c for c, _ in rules[:-1])], np.array([m for _, m in rules])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, size) for c in ("a_sketch", "b_sketch"))
        stay = (np.add.reduceat(x == y, starts, axis=1, dtype=np.int64).cumsum(axis=1) >= least).all(axis=1)
        return batch.select(list(_LINK)).filter(pa.array(stay))

    return run


_LINK = ("hub", "hub_text", "a", "a_text", "b", "b_text", "b_size")
_LINKS_SCHEMA = ", ".join(f"{c} bigint" for c in _LINK)


def _apart(size: int, rows: int, threshold: float, tolerance: float, step: int):
    """Pairs of members of a task that have different labels and aren't pruned. The one whose label more members have
    is ``a``, and its label is the pair's hub."""
    rules = least_matches(threshold, tolerance, size, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "task"):
            side = t.column("side").to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if t.column("pairs")[0].as_py() == 1:
                right = left
            if not len(left) or not len(right):
                continue
            sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, size)
            numbers: dict[tuple, int] = {}
            labels = np.array([numbers.setdefault(x, len(numbers)) for x in zip(t.column("l_id").to_pylist(), t.column("l_text").to_pylist())])
            sizes = t.column("n_shingles").to_numpy()
            rep, text = t.column("rep").to_numpy(), t.column("text_key").to_numpy()
            names, common = np.array(list(numbers), np.int64), np.bincount(labels)
            for i, rest in survivors(left, right, sketches, sizes, 0, rows, rules, threshold, labels):
                mine, others = labels[i], labels[rest]
                first = (common[mine] > common[others]) | ((common[mine] == common[others]) & (mine < others))
                x, y = np.where(first, i, rest), np.where(first, rest, i)
                hub = names[labels[x]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (hub[:, 0], hub[:, 1], rep[x], text[x], rep[y], text[y], sizes[y].astype(np.int64))], list(_LINK))

    return run


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sorted sets without repeats."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _verified(batches: Iterator[pa.RecordBatch], n: int, threshold: float) -> Iterator[tuple[list[tuple], list[tuple], list[tuple]]]:
    """By task: the first and second members of the similar pairs, as (rep, text_key, members), and (jaccard,)."""
    take_memory("shingles", forget)
    for t in grouped(batches, "task"):
        columns = {c: t.column(c).to_pylist() for c in t.column_names}
        sets = {(a, x): shingle_set(text, n) for a, x, b, text in zip(columns["a"], columns["a_text"], columns["b"], columns["text"]) if b is None}
        similar = []
        for a, x, i, b, y, j in zip(*(columns[c] for c in _PAIR[1:])):
            if b is not None and (s := jaccard(sets[a, x], sets[b, y])) >= threshold:
                similar.append(((a, x, i), (b, y, j), (s,)))
        if similar:
            yield tuple(zip(*similar))


def _pairs(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, second, s in _verified(batches, n, threshold):
            yield pa.RecordBatch.from_arrays([pa.array([min(a, b)[k] for a, b in zip(first, second)], pa.int64()) for k in (0, 1)] + [pa.array([max(a, b)[k] for a, b in zip(first, second)], pa.int64()) for k in (0, 1)] + [pa.array([x for x, in s], pa.float64())], ["a", "a_text", "b", "b_text", "jaccard"])

    return run


def _links(n: int, threshold: float):
    """Linear in the members of a task, however many pairs they make: links of each, and edges that join all of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, second, _ in _verified(batches, n, threshold):
            links: dict[tuple, int] = {}
            root: dict[tuple, tuple] = {}

            def top(x: tuple) -> tuple:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in zip(first, second):
                links[a] = links.get(a, 0) + b[2]
                links[b] = links.get(b, 0) + a[2]
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
            rows = [(*x[:2], *top(x)[:2], c) for x, c in links.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "a_text", "b", "b_text", "links"])

    return run


class _Classes:
    """The texts that may be similar, their sketches, and the classes of equal sets."""

    def __init__(self, docs: DataFrame, n: int, size: int) -> None:
        self.texts = texts = docs.where("doc_id is not null and text is not null").select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
        #: A row for each of ``docs`` with words: doc_id, text_key, set_key, n_shingles, sketch.
        self.features = written(
            map_batches(texts, _features(n, size), "doc_id bigint, text_key bigint, set_key binary, n_shingles int, sketch binary").where("set_key is not null"),
            "sketches",
        )
        first = F.min(F.struct("doc_id", "text_key")).alias("first")
        classes = self.features.groupBy("set_key").agg(first, F.count_distinct("doc_id").alias("members"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
        #: A row for each set: set_key, rep, text_key, members, n_shingles, sketch.
        self.classes = written(classes.select("set_key", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"), "members", "n_shingles", "sketch"), "classes")

    def banded(self, size: int, rows: int, *columns: str) -> DataFrame:
        """A row for each class and band, with its bucket."""
        bands = size // rows
        band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.expr("sketch").substr(k * (2 * rows) + 1, F.lit(2 * rows))))
        return self.classes.select(*columns, "n_shingles", F.posexplode(band).alias("band", "bucket"))

    def with_texts(self, pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """``pairs`` (written) and the texts that they need, by task, and the tables that were written for that."""
        needed = written(pairs.select("task", F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("a_text").alias("text_key")), F.struct(F.col("b").alias("doc_id"), F.col("b_text").alias("text_key")))).alias("x")).select("task", "x.*").distinct(), "needed")
        wanted = written(needed.select("doc_id", "text_key").distinct(), "wanted")
        found = self.texts.join(checked_broadcast(wanted), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
        sets = needed.join(found, ["doc_id", "text_key"]).select("task", F.col("doc_id").alias("a"), F.col("text_key").alias("a_text"), "text")
        return sets.unionByName(pairs, allowMissingColumns=True).select(*_PAIR, "text").repartition("task").sortWithinPartitions("task"), [needed, wanted]


class _Candidates(_Classes):
    """The tables of a join up to verification."""

    def __init__(self, docs: DataFrame, n: int, threshold: float, size: int, rows: int, step: int, tolerance: float) -> None:
        super().__init__(docs, n, size)
        banded = lambda *columns: self.banded(size, rows, *columns)
        shared = banded().groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s")).where("m > 1")
        shared = written(shared.select("band", "bucket", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "buckets")
        members = banded("rep", "text_key", "members", "sketch").join(checked_broadcast(shared), ["band", "bucket"])
        # in a bucket of several blocks a member goes to the task of its block with each block
        mine = F.pmod(F.xxhash64("rep", "text_key"), F.col("blocks")).cast("int")
        placed = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("mine", "other"), F.greatest("mine", "other")
        tasks = placed.select(F.xxhash64("band", "bucket", low, high).alias("task"), "band", F.when((F.col("mine") == low) | (low == high), 0).otherwise(1).alias("side"), F.when(low == high, 1).otherwise(0).alias("pairs"), "rep", "text_key", "members", "n_shingles", "sketch")
        pruned = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_prune(size, rows, threshold, tolerance, step), ", ".join(f"{c} bigint" for c in _PAIR))
        pairs = written(pruned, "candidates")
        self.both, used = self.with_texts(pairs)
        self.used = [shared, pairs, *used]


def ngram_jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, size: int = SIZE, rows: int = ROWS, step: int = STEP, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of class representatives (doc_id_a, text_a, doc_id_b, text_b, jaccard), doc_id_a the smaller,
    and membership (doc_id, text, rep, rep_text): each document's class. ``text`` columns are hashes of texts."""
    c = _Candidates(docs, n, threshold, size, rows, step, tolerance)
    near = written(c.both.mapInArrow(_pairs(n, threshold), "a bigint, a_text bigint, b bigint, b_text bigint, jaccard double"), "pairs")
    members = written(c.features.select("doc_id", "text_key", "set_key").join(c.classes.select("set_key", "rep", F.col("text_key").alias("rep_text")), "set_key").select("doc_id", F.col("text_key").alias("text"), "rep", "rep_text").distinct(), "membership")
    discard(c.features, c.classes, *c.used)
    return near.select(F.col("a").alias("doc_id_a"), F.col("a_text").alias("text_a"), F.col("b").alias("doc_id_b"), F.col("b_text").alias("text_b"), "jaccard"), members


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of the edges (x, y) with the smallest node that it is linked to over any chain."""
    both = written(edges.where("x <> y").select("x", "y").unionByName(edges.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    while True:
        # the smallest label among neighbours, then the label of that label: chains halve at each turn
        near = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("other"))
        step = written(labels.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "other").alias("label")), "step")
        jump = step.select(F.col("x").alias("label"), F.col("label").alias("next"))
        after = written(step.join(jump, "label", "left").select("x", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = after.where("label <> old").limit(1).count()
        discard(labels, step)
        labels = after
        if not changed:
            discard(both)
            out = labels.select(F.col("x").alias("node"), "label")
            out.stored_at = labels.stored_at
            return out


def _grouped_documents(docs: DataFrame, n, threshold, size, rows, step, tolerance) -> DataFrame:
    """(doc_id, text_key, set_key, root, n_links) of every document that has words; ``root`` is its group's first (doc_id, text_key)."""
    c = _Candidates(docs, n, threshold, size, rows, step, tolerance)
    links = written(c.both.mapInArrow(_links(n, threshold), "a bigint, a_text bigint, b bigint, b_text bigint, links bigint"), "links")
    labels = components(links.select(_node("a", "a_text").alias("x"), _node("b", "b_text").alias("y")))
    counted = links.groupBy(_node("a", "a_text").alias("node")).agg(F.sum("links").alias("links"))
    of_class = c.classes.select("set_key", _node("rep", "text_key").alias("node"), "members")
    known = of_class.join(counted, "node", "left").join(labels, "node", "left")
    known = written(known.select("set_key", F.coalesce("label", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links")), "known")
    out = written(c.features.select("doc_id", "text_key", "set_key").distinct().join(checked_broadcast(known), "set_key").select("doc_id", "text_key", "set_key", "root", "n_links"), "documents")
    discard(c.features, c.classes, links, labels, known, *c.used)
    return out


def _node(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("doc_id"), F.col(b).alias("text_key"))


def _edges(c: _Classes, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(x, y) of classes, written: links that join what the pairs that are similar join. Pairs of one hub share their
    texts; they are split by the number and size of their members, so that a task holds no more than two sides."""
    of = Window.partitionBy("hub", "hub_text")

    def part(*side: str) -> Column:
        # sizes of a pair are within a factor of two or so; they only set how large a task is
        members = F.approx_count_distinct(F.xxhash64(*side)).over(of)
        parts = F.greatest(F.ceil(members / SIDE), F.ceil(members * F.avg("b_size").over(of) / BLOCK_SHINGLES))
        return F.pmod(F.xxhash64(*side), parts)

    split = pairs.withColumns({"p": part("a", "a_text"), "q": part("b", "b_text")})
    one = F.lit(1).cast("bigint")
    tasks = split.select(F.xxhash64("hub", "hub_text", "p", "q").alias("task"), "a", "a_text", one.alias("a_members"), "b", "b_text", one.alias("b_members"))
    tasks = written(tasks, "compared")
    both, used = c.with_texts(tasks)
    links = both.mapInArrow(_links(n, threshold), "a bigint, a_text bigint, b bigint, b_text bigint, links bigint")
    out = written(links.select(_node("a", "a_text").alias("x"), _node("b", "b_text").alias("y")).where("x <> y"), "links")
    discard(tasks, *used)
    return out


def _components_of_copies(c: _Classes, n: int, threshold: float, size: int, rows: int, step: int, tolerance: float) -> DataFrame:
    """(node, label) of the classes that are similar to others: the components of the join's links, but without all
    the pairs of a large group.

    First a bucket's members are compared with its first alone: pairs in proportion to members. What that joins has
    one label; then any two members of a bucket whose labels still differ are compared. A pair that is never compared
    is within a group already, so none is lost.
    """
    bucket = Window.partitionBy("band", "bucket")
    head = F.min(F.struct("rep", "text_key", "n_shingles")).over(bucket)
    placed = c.banded(size, rows, "rep", "text_key").withColumns({"m": F.count(F.lit(1)).over(bucket), "head": head}).where("m > 1")
    placed = written(placed.select("band", "bucket", "m", "rep", "text_key", "n_shingles", "head"), "placed")
    near = F.least("n_shingles", "head.n_shingles") >= threshold * F.greatest("n_shingles", "head.n_shingles") - 1e-9
    stars = placed.where((_node("rep", "text_key") != _node("head.rep", "head.text_key")) & near)
    stars = stars.select(F.col("head.rep").alias("hub"), F.col("head.text_key").alias("hub_text"), F.col("head.rep").alias("a"), F.col("head.text_key").alias("a_text"), F.col("rep").alias("b"), F.col("text_key").alias("b_text"), F.col("n_shingles").cast("bigint").alias("b_size")).distinct()
    for k in ("a", "b"):
        stars = stars.join(c.classes.select(F.col("rep").alias(k), F.col("text_key").alias(f"{k}_text"), F.col("sketch").alias(f"{k}_sketch")), [k, f"{k}_text"])
    stars = written(map_batches(stars, _alike(size, threshold, tolerance, step), _LINKS_SCHEMA, 4000), "candidates")
    edges = _edges(c, stars, n, threshold)
    labels = components(edges)
    discard(stars, edges)
    # two members have been compared; in larger buckets the others may yet be similar to each other
    label = F.coalesce("label", _node("rep", "text_key"))
    labelled = placed.where("m > 2").select("band", "bucket", _node("rep", "text_key").alias("node"), "rep", "text_key").join(checked_broadcast(labels), "node", "left").select("band", "bucket", "rep", "text_key", label.alias("label"))
    labelled = written(labelled, "labelled")
    each = labelled.groupBy("band", "bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = each.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("labels"), F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("main")).where("labels > 1")
    # of a bucket of several blocks the members of its largest group have blocks of their own, which needn't meet
    whole, blocks = F.col("m") <= BLOCK, lambda count: F.ceil(count / BLOCK).cast("int")
    mixed = mixed.select("band", "bucket", F.when(~whole, F.col("main.label")).alias("main"), F.when(whole, 1).otherwise(blocks(F.col("m") - F.col("main.c"))).alias("others"), F.when(whole, 0).otherwise(blocks(F.col("main.c"))).alias("mains"))
    mixed = written(mixed, "mixed")
    if mixed.isEmpty():
        discard(placed, labelled, mixed)
        return labels
    members = labelled.join(checked_broadcast(mixed), ["band", "bucket"])
    own = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    number = F.xxhash64("rep", "text_key")
    mine = F.when(own, F.col("others") + F.pmod(number, "mains")).otherwise(F.pmod(number, "others")).cast("int")
    last = F.when(own, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    members = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    members = members.select(F.xxhash64("band", "bucket", low, high).alias("task"), F.when(F.col("mine") == low, 0).otherwise(1).alias("side"), F.when(low == high, 1).otherwise(0).alias("pairs"), "rep", "text_key", F.col("label.doc_id").alias("l_id"), F.col("label.text_key").alias("l_text"))
    tasks = members.join(c.classes.select("rep", "text_key", "n_shingles", "sketch"), ["rep", "text_key"])
    rest = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_apart(size, rows, threshold, tolerance, step), _LINKS_SCHEMA)
    rest = written(rest.distinct(), "candidates")
    edges = _edges(c, rest, n, threshold)
    discard(placed, labelled, mixed, rest)
    if edges.isEmpty():
        discard(edges)
        return labels
    out = components(labels.select(F.col("node").alias("x"), F.col("label").alias("y")).unionByName(edges))
    discard(edges, labels)
    return out


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, size: int = SIZE, rows: int = ROWS, step: int = STEP, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links) of every document that is similar to another: an n-gram similarity of ``threshold``.

    ``n_links`` counts the other documents that it is similar to, exact copies among them. ``class_id`` is the
    smallest doc_id that it is linked to over any chain of links. Copies are counted, not paired, so thousands of
    them cost a row each; ``ngram_jaccard_pairs`` gives the links between different texts themselves. A candidate
    at the very threshold is missed with a probability of ``tolerance`` a step, and 0.0016 by the bands; the more
    similar, the less.

    A document is a doc_id with a set of n-grams: an id that stands for several texts has a row for each of them
    that is similar to another, and repeated rows count once. Null ids or texts, empty texts, and those without a
    word, match nothing and have no row, nor have documents without a link. A text of fewer than n words is one
    n-gram. Texts of any length are compared whole. Other columns are ignored; an empty table gives no rows.
    """
    found = _grouped_documents(docs, n, threshold, size, rows, step, tolerance)
    return found.where("n_links > 0").groupBy("doc_id", "set_key").agg(F.first("root.doc_id").alias("class_id"), F.first("n_links").alias("n_links")).drop("set_key")


def ngram_jaccard_sql() -> str:
    """``ngram_jaccard_join`` of the documents table by brute force over common n-grams, where ids are unique."""
    return f"""
    WITH RECURSIVE split AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < {N} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {N - 2}), lambda i: array_to_string(ws[i:i + {N - 1}], ' ')) END) AS gram FROM split WHERE len(ws) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
    near AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE c >= {THRESHOLD} * (x.n + y.n - c)),
    reach AS (SELECT a, b FROM near UNION SELECT r.a, e.b FROM reach r JOIN near e ON r.b = e.a)
    SELECT a AS doc_id, min(b) AS class_id, (SELECT count(*) FROM near WHERE near.a = reach.a) AS n_links FROM reach GROUP BY a
    """


def _ordered(docs: DataFrame) -> Column:
    """The values of a row as one that has an order. Maps have none: a column with one anywhere counts as JSON."""
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
    unordered = lambda kind: "map<" in kind or "variant" in kind
    return F.struct(*(F.to_json(F.struct(f.name), exact) if unordered(f.dataType.simpleString()) else F.col(f.name) for f in docs.schema.fields))


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, size: int = SIZE, rows: int = ROWS, step: int = STEP, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents, with all their columns, less those that are similar to an earlier one of their group.

    Groups are the connected components of the join; the document of smallest doc_id, of its texts that of
    smallest hash, stays. Documents that match nothing, null and empty ones and those without words stay as they
    are, repeated or not. Other rows that repeat a doc_id and its text are one document: that whose other values, column
    by column, come first stays. Texts that share a doc_id without being similar are documents of their own. An empty
    table stays empty.
    """
    c = _Classes(docs, n, size)
    labels = _components_of_copies(c, n, threshold, size, rows, step, tolerance)
    known = c.classes.select("set_key", _node("rep", "text_key").alias("node")).join(checked_broadcast(labels), "node", "left")
    known = written(known.select("set_key", F.coalesce("label", "node").alias("root")), "known")
    found = c.features.select("doc_id", "text_key", "set_key").distinct().join(checked_broadcast(known), "set_key")
    dropped = written(found.where(_node("doc_id", "text_key") != F.col("root")).select(F.col("doc_id").alias("d_id"), F.col("text_key").alias("d_text")), "dropped")
    discard(c.features, c.classes, labels, known)
    key = text_key(docs["text"])
    gone = checked_broadcast(dropped)
    stay = docs.join(gone, (docs["doc_id"] == gone["d_id"]) & (key == gone["d_text"]), "left_anti")
    # repeated rows are rare: only they are shuffled
    again = docs.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").alias("r_id"), key.alias("r_text")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("r_id", "r_text")
    again = written(again, "repeated")
    if again.isEmpty():
        return stay.select(docs.columns)
    again = checked_broadcast(again)
    same = (stay["doc_id"] == again["r_id"]) & (text_key(stay["text"]) == again["r_text"]) & stay["text"].rlike(r"(?U)\w")
    rows_ = stay.join(again, same, "left_semi").select(F.struct(*docs.columns).alias("row"), _ordered(docs).alias("values"))
    # the first row that a task meets would depend on the table's files and on how it was joined
    once = rows_.groupBy("row.doc_id", "row.text").agg(F.min_by("row", "values").alias("row")).select("row.*")
    return stay.join(again, same, "left_anti").select(docs.columns).unionByName(once)
