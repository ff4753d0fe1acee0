"""What the operators share: tables, the shared folder, size-checked broadcasts, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.sources.storage import discard, written

__all__ = ["Scratch", "checked_broadcast", "discard", "grouped", "map_batches", "measured_bytes", "table", "take_memory", "vocabulary_file", "written"]

#: Bytes, as measured, up to which one side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


class Scratch:
    """Written tables of one operator, deleted together once what is made of them is written itself."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        self.frames.append(written(df, tag))
        return self.frames[-1]

    def discard(self) -> None:
        discard(*self.frames)
        self.frames.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the values of a (written, cheap to read) frame."""
    each = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            each.append(F.coalesce(F.octet_length(column), F.lit(0)) + 8)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            each.append(F.coalesce(F.size(column), F.lit(0)) * 8 + 16)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            each.append(F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 16)
        else:
            each.append(F.lit(8 * len(field.dataType.fields) if isinstance(field.dataType, T.StructType) else 8))
    return df.agg(F.sum(sum(each[1:], each[0]))).first()[0] or 0


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the (written, cheap to read) frame has at most ``limit`` bytes; else leave it to shuffle."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def vocabulary_file(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file. The folder is a parameter, by default SPANFORGE_TOKENIZERS or /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("SPANFORGE_TOKENIZERS", "/opt/tokenizers"), name)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, rows: int = 1000) -> DataFrame:
    """Apply ``fn`` to Arrow batches of at most ``rows`` rows, which bounds a worker's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal key, a bigint without nulls, from batches that arrive sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


_holder: tuple[str, Callable[[], None]] | None = None


def take_memory(owner: str, release: Callable[[], None]) -> None:
    """Called by an operator's task in a worker: what another operator remembered there is released.

    Workers are reused from stage to stage, so a pipeline would else hold the caches of all its stages at once.
    """
    global _holder
    if _holder is not None and _holder[0] != owner:
        _holder[1]()
        gc.collect()
        # the C library keeps freed memory for itself unless asked; where it can't be asked, it stays
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    _holder = (owner, release)
