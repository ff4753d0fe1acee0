"""Incremental ingest: documents become searchable when their micro-batch is written.

A folder holds a part for each micro-batch and, after compaction, parts of several batches. A manifest names the parts
that hold all batches up to some number; the one of the highest number counts, and it appears whole by a rename. So
readers see a batch either in its own part or in a compacted one, never in both.

Compaction is for many small parts: what it writes again are those below ``FULL`` bytes, and of older ones those no
larger than twice the newer ones with them. So a document is written again a bounded number of times, however many follow.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from spanforge.sources.index import IndexConfig, SpanIndex, by_hash, document_table, folded_postings, packed, spread, unfolded, unpacked
from spanforge.sources.storage import names, put_text, remove, rename, size

#: Batches after which they are compacted.
COMPACT_AT = 20
#: Stored bytes of its documents from which on a part stays as it is.
FULL = 32 << 20
#: Postings as ``folded_postings`` has them, by hash. Their folder's name tells them from postings stored otherwise.
POSTINGS = "postings-by-hash"
Annotator = Callable[[DataFrame, DataFrame], DataFrame]


class Ingest:
    """What a stream of (doc_id, text, ...) becomes. ``features`` gives the arrays of token features beside the first,
    as expressions on a document's row. ``annotations`` makes (doc_id, start, length, features...) of a type from a
    micro-batch and its documents. ``text`` may be binary: bytes that aren't UTF-8 are marked. Where ``build`` gives a
    text, tokens and non-tokens are those of ``document_table``."""

    def __init__(self, path: str, config: IndexConfig, build: Callable[[DataFrame], DataFrame] = document_table, features: dict[str, Column] | None = None, annotations: dict[str, Annotator] | None = None, compact_at: int = COMPACT_AT) -> None:
        self.path, self.config, self.build, self.features, self.annotations, self.compact_at = path.rstrip("/"), config, build, features, annotations or {}, compact_at
        for kind in self.annotations:
            if kind not in config.annotation_types:
                raise ValueError(f"no annotation type {kind}")

    def append(self, batch: DataFrame, number: int) -> None:
        """One micro-batch as a part of its own, overwritten if the batch is run again."""
        spark, part = batch.sparkSession, f"batch={number}"
        at = f"{self.path}/documents/{part}"
        packed(self.build(batch)).write.mode("overwrite").parquet(at)
        documents = unpacked(spark.read.parquet(at))
        even = unpacked(spread(spark.read.parquet(at), size(spark, at)))
        by_hash(folded_postings(even, self.config, self.features)).write.mode("overwrite").parquet(f"{self.path}/{POSTINGS}/{part}")
        for kind, make in self.annotations.items():
            make(batch, documents).write.mode("overwrite").parquet(f"{self.path}/annotations-{kind}/{part}")
        compacted = manifest(spark, self.path)
        if number - (compacted["upto"] if compacted else -1) >= self.compact_at:
            compact(spark, self.path)

    def writer(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        """Start it with any trigger."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.append)

    def index(self, spark: SparkSession, deleted: DataFrame | None = None) -> SpanIndex:
        """All that has been ingested so far."""
        documents, postings = indexed(spark, self.path, self.config)
        return SpanIndex(self.config, documents, postings, {kind: _table(spark, self.path, f"annotations-{kind}", manifest(spark, self.path)) for kind in self.annotations}, deleted, self.features)


def ingest(stream: DataFrame, path: str, config: IndexConfig, checkpoint: str, build: Callable[[DataFrame], DataFrame] = document_table, **more) -> DataStreamWriter:
    """Writer that indexes a stream of (doc_id, text, ...) under ``path``; ``more`` is for ``Ingest``."""
    return Ingest(path, config, build, **more).writer(stream, checkpoint)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """{"upto": last batch in the parts, "parts": [their names]}, or None."""
    found = [n for n in names(spark, path) if n.startswith("manifest-")]
    return json.loads(spark.read.text(f"{path}/{found[-1]}", wholetext=True).first()[0]) if found else None


def _at(path: str, part: str, name: str) -> str:
    return f"{path}/{name}/{part}" if part.startswith("batch=") else f"{path}/{part}/{name}"


def _parts(spark: SparkSession, path: str, name: str, compacted: dict | None) -> list[str]:
    """Parts that hold all batches of a table, each in one."""
    numbers = sorted(int(n.partition("=")[2]) for n in names(spark, f"{path}/{name}") if n.startswith("batch="))
    return [*(compacted["parts"] if compacted else []), *(f"batch={n}" for n in numbers if not compacted or n > compacted["upto"])]


def _table(spark: SparkSession, path: str, name: str, compacted: dict | None) -> DataFrame:
    parts = [_at(path, part, name) for part in _parts(spark, path, name, compacted)]
    if not parts:
        raise ValueError(f"nothing has been ingested under {path}")
    return spark.read.schema(spark.read.parquet(parts[0]).schema).parquet(*parts)


def indexed(spark: SparkSession, path: str, config: IndexConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and postings of all batches; of a configuration with one token feature if none is given."""
    compacted = manifest(spark, path)
    return unpacked(_table(spark, path, "documents", compacted)), unfolded(_table(spark, path, POSTINGS, compacted), config or IndexConfig())


def compact(spark: SparkSession, path: str, full: int = FULL) -> None:
    """All batches so far in few parts; parts that were in none of the last two manifests are deleted.

    Readers that opened the index before go on with the parts that they have: those are deleted by the next call.
    """
    path, old = path.rstrip("/"), manifest(spark, path)
    upto = batches(spark, path)[-1]
    if old and old["upto"] == upto:
        return
    tables = [n for n in names(spark, path) if n in ("documents", POSTINGS) or n.startswith("annotations-")]
    every = _parts(spark, path, "documents", old)
    before = len(old["parts"]) if old else 0
    bytes_of = {part: size(spark, _at(path, part, "documents")) for part in every}
    small = [part for part in every[before:] if bytes_of[part] < full]
    for part in reversed(every[:before]):
        if not small or bytes_of[part] >= full or bytes_of[part] > 2 * sum(bytes_of[x] for x in small):
            break
        small.insert(0, part)
    kept = every
    if len(small) > 1:
        new = f"compacted-{upto:012d}"
        remove(spark, f"{path}/{new}")
        for name in tables:
            of = [_at(path, part, name) for part in small]
            whole = spread(spark.read.schema(spark.read.parquet(of[0]).schema).parquet(*of), sum(size(spark, x) for x in of))
            (by_hash(whole.drop("slot")) if name == POSTINGS else whole).write.parquet(f"{path}/{new}/{name}")
        kept = [*(part for part in every if part not in small), new]
    put_text(spark, f"{path}/.new-manifest", json.dumps({"upto": upto, "parts": kept}))
    rename(spark, f"{path}/.new-manifest", f"{path}/manifest-{upto:012d}")
    if old:
        stays = {*kept, *old["parts"]}
        for name in tables:
            for n in names(spark, f"{path}/{name}"):
                if n.startswith("batch=") and int(n.partition("=")[2]) <= old["upto"] and n not in stays:
                    remove(spark, f"{path}/{name}/{n}")
        for n in names(spark, path):
            if n.startswith("compacted-") and n not in stays:
                remove(spark, f"{path}/{n}")


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that have parts of their own, in order."""
    return sorted(int(n.partition("=")[2]) for n in names(spark, f"{path}/documents") if n.startswith("batch="))
