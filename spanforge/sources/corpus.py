"""The driver's tables as an index: texts, their metadata, labels and conversation turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.text import tokens
from spanforge.sources.index import AnnotationType, IndexConfig, SpanIndex, document_annotations, document_table, posting_table, spread
from spanforge.sources.storage import exists, shared_folder, signature, size

#: Part of the key of a stored index: changes with what is stored.
LAYOUT = "2"

CONFIG = IndexConfig(
    token_features={"string": "lower", "plain": "accents"},
    annotation_types={
        "Document": AnnotationType(nominal=("lang", "source"), integer=("n_chars",), document_mode=True),
        "Label": AnnotationType(nominal=(), integer=("quality", "toxic"), document_mode=True, index_nulls=False),
        "Extent": AnnotationType(nominal=("normalizedUnit",), float=("normalizedValue", "normalizedMinValue", "normalizedMaxValue"), document_mode=True),
        "Measurement": AnnotationType(nominal=("normalizedUnit",), float=("normalizedValue", "normalizedMinValue", "normalizedMaxValue"), document_mode=True),
    },
)
TURNS = IndexConfig(annotation_types={"Turn": AnnotationType(nominal=("role",), integer=("turn",))})


#: Opened indexes by session and folder: listing and reading footers is done once a session.
_OPEN: dict[tuple[str, str], SpanIndex] = {}


def _stored(spark: SparkSession, config: IndexConfig, raw: Callable[[], SpanIndex], *tables: str) -> SpanIndex:
    """The index of the files of its tables in the shared folder, each part built once."""
    made_of = "\n".join([LAYOUT, repr(config), *(signature(spark, t) for t in tables)])
    path = f"{shared_folder(spark)}/index-{hashlib.sha256(made_of.encode()).hexdigest()[:24]}"
    key = (spark.sparkContext.applicationId, path)
    if key not in _OPEN or not exists(spark, f"{path}/layout"):
        _OPEN[key] = raw().stored(path)
    return _OPEN[key]


def corpus_index(spark: SparkSession, sf_dir: str) -> SpanIndex:
    """The index of ``raw_corpus_index``, stored: a part is built by the first query that needs it, and read by all later ones."""
    return _stored(spark, CONFIG, lambda: raw_corpus_index(spark, sf_dir), *(f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")))


def conversation_index(spark: SparkSession, sf_dir: str) -> SpanIndex:
    return _stored(spark, TURNS, lambda: raw_conversation_index(spark, sf_dir), f"{sf_dir}/conversations.parquet")


def raw_corpus_index(spark: SparkSession, sf_dir: str) -> SpanIndex:
    """Documents with their language, source and size as document-mode annotations, labels, and sizes as measurements."""
    path = f"{sf_dir}/documents.parquet"
    texts = spread(spark.read.parquet(path), size(spark, path))
    documents = document_table(texts, {"lang": F.col("lang"), "source": F.col("source"), "n_chars": F.col("n_chars")})
    # lengths come from the texts themselves, so that a constraint on metadata reads no token table
    sized = texts.select("*", F.size(tokens(F.coalesce("text", F.lit("")))).alias("n_tokens"))
    kinds = CONFIG.annotation_types
    whole = sized.select("doc_id", F.lit(0).alias("start"), F.col("n_tokens").alias("length"), "lang", "source", "n_chars")
    labels = document_annotations(sized, spark.read.parquet(f"{sf_dir}/labels.parquet"), kinds["Label"])
    measures = whole.select("doc_id", "start", "length", F.lit("chars").alias("normalizedUnit"), F.col("n_chars").cast("double").alias("normalizedValue"), F.lit(None).cast("double").alias("normalizedMinValue"), F.lit(None).cast("double").alias("normalizedMaxValue"))
    # what a text measures by words: an interval from its shortest to its longest token, in characters
    lengths = F.transform(tokens(F.coalesce("text", F.lit(""))), lambda t: F.length(t))
    extents = sized.select("doc_id", F.lit(0).alias("start"), F.col("n_tokens").alias("length"), F.lit("chars").alias("normalizedUnit"), F.lit(None).cast("double").alias("normalizedValue"), F.array_min(lengths).cast("double").alias("normalizedMinValue"), F.array_max(lengths).cast("double").alias("normalizedMaxValue"))
    features = {"plain": F.col("tokens")}
    postings = posting_table(documents, CONFIG, features)
    return SpanIndex(CONFIG, documents, postings, {"Document": whole, "Label": labels, "Measurement": measures, "Extent": extents}, features=features)


def raw_conversation_index(spark: SparkSession, sf_dir: str) -> SpanIndex:
    """A conversation is a document, its turns joined by line ends; each turn is an annotation over its tokens."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id is not null")
    body = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.coalesce(t["text"], F.lit("")))
    texts = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(body, "\n").alias("text"))
    documents = document_table(texts)
    return SpanIndex(TURNS, documents, posting_table(documents, TURNS), {"Turn": _turn_spans(turns)})


def _turn_spans(turns: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    before = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    size = F.size(tokens(F.coalesce("text", F.lit(""))))
    rows = turns.select("conv_id", "turn", "role", size.alias("length"), F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int").alias("start"))
    return rows.select(F.col("conv_id").alias("doc_id"), "start", "length", "role", "turn").where("length > 0")
