"""From raw documents to tokens: the stages of a training corpus, each written as Parquet for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.bpe import with_tokens
from spanforge.llm.common import discard, table, written
from spanforge.llm.line_templates import drop_recurring_lines
from spanforge.llm.mixing import mix
from spanforge.llm.ngram_jaccard import drop_near_copies
from spanforge.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic by the classifier of the labelled ones.

    Every row is judged by its own text, whole, whatever its length; null and empty texts, and rows without an id,
    stay. Repeated rows share their fate. A score at the very threshold is toxic. Without toxic or clean labels all
    stay; an empty table stays empty. All columns are kept, whatever their names.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one of which nothing is left goes. n_chars, if there is one, follows the text.

    Null and empty texts, and those without a recurring line, stay as they are. Rows without an id lose recurring
    lines too, but don't make lines recur; rows of one id are one document in that. Every row loses the lines of its
    own text, of any length. All columns are kept, whatever their names; an empty table stays empty.
    """
    out = drop_recurring_lines(docs)
    changed = F.col("n_dropped") > 0
    left = out.where(~changed | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that of the smallest doc_id, of its texts that of smallest hash.

    Null and empty texts, those without words, and rows without an id are similar to nothing and stay. Rows that
    repeat an id and its text are one document, of which the row of the first other values stays; different texts of
    one id are documents of their own. Texts of any length are compared whole. All columns are kept, whatever their names; an empty table stays empty.
    """
    return drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture wants them, each at least once.

    Null sources and languages are groups of their own; null and empty texts, which have no tokens, come once.
    Repeated rows have equal copies; rows without an id round by the hash of null. All columns are kept, whatever
    their names; an empty table stays empty.
    """
    return mix(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``tokens`` and ``n_tokens``, which take the place of columns of these names.

    A null text has null tokens, an empty one none; a text of any length is encoded whole. Rows are kept as they
    are, repeated ones and those without an id too; an empty table stays empty.
    """
    return with_tokens(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("source_mixing", source_mixing),
    ("bpe_tokens", bpe_tokens),
]

#: Viterbi readings, templates, verified similarity groups, tilted rates and merges are beyond SQL: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage has written goes when the next one's is there."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*last)
        last = [docs]
    return docs
