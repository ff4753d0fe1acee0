"""Terms queries: aggregates over postings and annotations that yield (term, length, count, description)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.resolvers import described
from spanforge.plans.ast import Annotation
from spanforge.plans.compile import Compiler
from spanforge.sources.index import SpanIndex

#: Frequent English function words and fillers; any other list can be given.
STOP_WORDS = tuple(
    "a able about above abroad according accordingly across actually after afterwards again against ago ahead all allow allows almost alone along alongside already also although always am amid among amongst an and "
    "another any anybody anyhow anymore anyone anything anyway anyways anywhere apart are around as aside ask asking associated at away back backward backwards be became because become becomes becoming been before "
    "beforehand begin behind being below beside besides best better between beyond both brief but by came can cannot cant cause causes certain certainly clearly come comes concerning consequently consider considering "
    "contain containing contains corresponding could course currently dare despite did different directly do does doing done down downwards during each either else elsewhere end ending enough entirely especially etc "
    "even ever evermore every everybody everyone everything everywhere exactly example except fairly far few fewer first five followed following follows for forever former formerly forth forward found four from further "
    "furthermore get gets getting given gives go goes going gone got had half happens hardly has have having he hello help hence her here hereafter hereby herein hereupon hers herself high him himself his hither hopefully "
    "how however hundred i if ignored immediate in inasmuch inc indeed indicate indicated indicates inner inside insofar instead into inward is it its itself just keep keeps kept know known knows last lately later latter "
    "latterly least less lest let like liked likely likewise little look looking looks low lower made mainly make makes many may maybe me mean meantime meanwhile merely might mine minus more moreover most mostly much must "
    "my myself namely near nearly necessary need needs neither never nevertheless new next nine no nobody non none nonetheless nor normally not nothing notwithstanding now nowhere obviously of off often oh ok okay old on "
    "once one ones only onto opposite or other others otherwise ought our ours ourselves out outside over overall own particular particularly past per perhaps placed please plus possible presumably probably provided "
    "provides quite rather really reasonably recent recently regarding regardless relatively respectively right round said same saw say saying says second secondly see seeing seem seemed seeming seems seen self selves "
    "sensible sent serious seriously seven several shall she should since six so some somebody someday somehow someone something sometime sometimes somewhat somewhere soon sorry specified specify specifying still sub such "
    "sup sure take taken taking tell tends than thank thanks that the their theirs them themselves then thence there thereafter thereby therefore therein thereupon these they thing things think third this thorough "
    "thoroughly those though three through throughout thru thus till to together too took toward towards tried tries truly try trying twice two under underneath undoing unfortunately unless unlike unlikely until unto up "
    "upon upwards us use used useful uses using usually value various versus very via want wants was way we welcome well went were what whatever when whence whenever where whereafter whereas whereby wherein whereupon "
    "wherever whether which whichever while whilst whither who whoever whole whom whomever whose why will willing wish with within without wonder would yes yet you your yours yourself yourselves zero".split()
)
STRATEGIES = ("first", "max", "min", "sum")
_COLUMNS = ("term", "length", "count", "description")


def _shaped(rows: DataFrame) -> DataFrame:
    """The columns of a terms result; those that a query doesn't have are null."""
    kinds = {"term": "string", "length": "int", "count": "bigint", "description": "string"}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _without(rows: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    return rows.where(~F.col("term").isin(list(stop_words))) if stop_words else rows


def term_type(index: SpanIndex, feature: str | None = None, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Every term of a token feature with its occurrences; deleted documents count too."""
    return _shaped(_without(index.term_counts(feature or index.config.default_feature), stop_words))


def document_terms(index: SpanIndex, doc_id: int, feature: str | None = None, stop_words: tuple[str, ...] = ()) -> DataFrame:
    return documents_or(index, [doc_id], feature, stop_words)


def documents_or(index: SpanIndex, doc_ids: list[int], feature: str | None = None, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Terms of any of the documents, with summed counts."""
    rows = _without(index.terms_of(doc_ids, feature or index.config.default_feature), stop_words)
    return _shaped(rows.groupBy("term").agg(F.count(F.lit(1)).alias("count")))


def documents_and(index: SpanIndex, doc_ids: list[int], feature: str | None = None, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Terms of all the documents, with summed counts."""
    rows = _without(index.terms_of(doc_ids, feature or index.config.default_feature), stop_words)
    # one row a term and document first, so that the count of documents needs no distinct
    each = rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    both = each.groupBy("term").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("in"))
    return _shaped(both.where(F.col("in") == len(set(doc_ids))))


def annotation_terms(compiler: Compiler, query: Annotation, pattern: str | None = None) -> DataFrame:
    """Distinct feature tuples and lengths that satisfy an annotation query, with their occurrences."""
    kind = compiler.index.config.annotation_types[query.type]
    names = kind.features if any(c.feature in kind.features and c.feature not in kind.nominal for c in query.constraints) else kind.nominal
    rows = compiler.annotation_rows(query).select("doc_id", "start", "length", *[F.col(f"`{n}`") for n in names]).distinct()
    described_rows = rows.select("length", described(names, pattern).alias("description"), F.concat(F.lit(f"{query.type}:"), described(names)).alias("term"))
    return _shaped(described_rows.groupBy("term", "length", "description").agg(F.count(F.lit(1)).alias("count")))


def const_terms(index: SpanIndex, terms: list[str], counts: list[int] | None = None) -> DataFrame:
    return _shaped(index.spark.createDataFrame([(t, None if counts is None else counts[k]) for k, t in enumerate(terms)], "term string, count bigint"))


def _combined(parts: list[DataFrame], strategy: str, everywhere: bool) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown count strategy: {strategy}")
    tagged = [p.select(F.lit(k).alias("k"), *_COLUMNS) for k, p in enumerate(parts)]
    rows = reduce(DataFrame.union, tagged)
    positive = F.when(F.col("count") > 0, F.col("count"))
    count = {"first": F.min_by(positive, F.when(positive.isNotNull(), F.col("k"))), "max": F.max(positive), "min": F.min(positive), "sum": F.sum(positive)}[strategy]
    out = rows.groupBy("term").agg(count.alias("count"), F.min_by("length", F.when(F.col("length").isNotNull(), F.col("k"))).alias("length"), F.min_by("description", F.when(F.col("description").isNotNull(), F.col("k"))).alias("description"), F.count_distinct("k").alias("in"))
    return _shaped(out.where(F.col("in") == len(parts)) if everywhere else out)


def and_terms(*parts: DataFrame, strategy: str = "first") -> DataFrame:
    """Terms of all inputs. Only positive counts are combined."""
    return _combined(list(parts), strategy, True)


def or_terms(*parts: DataFrame, strategy: str = "first") -> DataFrame:
    """Terms of any input. Only positive counts are combined."""
    return _combined(list(parts), strategy, False)


def federated_terms(*parts: DataFrame) -> DataFrame:
    """One terms query's answers by several indexes: counts of a term are summed, the first length and description stay."""
    return _combined(list(parts), "sum", False)


def _order(by: tuple[str, ...]) -> list[Column]:
    out = []
    for x in by:
        name, _, way = x.partition(" ")
        column = {"count": "count", "string": "term", "description": "description"}[name]
        out.append(F.desc_nulls_last(column) if way == "desc" else F.asc_nulls_last(column))
    return out


def sorted_terms(terms: DataFrame, by: tuple[str, ...] = ("count desc", "string")) -> DataFrame:
    return terms.orderBy(*_order(by))


def limit_terms(terms: DataFrame, n: int, by: tuple[str, ...] = ("count desc", "string")) -> DataFrame:
    """The first n terms in an order; a top-k, not a full sort."""
    return terms.orderBy(*_order(by)).limit(n)


def group_by_description(terms: DataFrame) -> DataFrame:
    """One row a description: counts summed, the first length, terms sorted and joined by " | "."""
    out = terms.groupBy("description").agg(F.sum("count").alias("count"), F.min_by("length", "term").alias("length"), F.array_join(F.array_sort(F.collect_set("term")), " | ").alias("term"), F.array_sort(F.collect_set("term")).alias("original_terms"))
    return out.select("term", F.col("length").cast("int").alias("length"), "count", "description", "original_terms")


def filter_by_description(terms: DataFrame, banned: list[str]) -> DataFrame:
    """Without the terms of banned descriptions; those without a description stay."""
    return terms.where(F.col("description").isNull() | ~F.col("description").isin(list(banned)))
