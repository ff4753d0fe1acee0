"""Where intermediate tables and stored indexes go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach: spark.checkpoint.dir. Where it is unset a local session gets a temporary
    one; on a cluster that would lose data, so it is an error."""
    context = spark.sparkContext
    own = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spanforge-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def numbered(ordered: DataFrame, tag: str) -> DataFrame:
    """A sorted frame with ``rank``, each row's place from 0 on. The frame is written, and a row's place is that in its
    partition behind the rows of the partitions before, so no task has all rows."""
    # the id of a row is its partition, then its place in it
    placed = written(ordered.withColumn("__at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("__at", 33)
    # a row a partition
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.select(*ordered.columns, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def discard(*frames: DataFrame) -> None:
    """Delete the tables of ``written`` frames, once all that is made of them is written itself."""
    for df in frames:
        remove(df.sparkSession, df.stored_at)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def parent(spark: SparkSession, path: str) -> None:
    """Make the folder that the path is in."""
    files, at = _files(spark, path)
    files.mkdirs(at.getParent())


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path."""
    files, at = _files(spark, path)
    return files.getContentSummary(at).getLength() if files.exists(at) else 0


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Atomic where the file system's rename is; False if another one was first."""
    files, at = _files(spark, path)
    return not exists(spark, to) and files.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    files, at = _files(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    files, at = _files(spark, path)
    out = files.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def signature(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: what a stored index was built from."""
    files, at = _files(spark, path)
    found = files.listStatus(at) if files.getFileStatus(at).isDirectory() else [files.getFileStatus(at)]
    return "\n".join(sorted(f"{x.getPath()}:{x.getLen()}:{x.getModificationTime()}" for x in found))
