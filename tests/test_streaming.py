from pyspark.sql import functions as F

from spanforge.operators.results import Search
from spanforge.sources.index import AnnotationType, IndexConfig, SpanIndex, document_annotations, document_table, posting_table
from spanforge.streaming.ingest import Ingest, batches, compact, indexed, ingest, manifest


def parts(spark, source, rows, n):
    for k in range(n):
        size = len(rows) // n
        spark.createDataFrame(rows[size * k : size * k + size], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(source)


def hits(index, query="the and"):
    return sorted(map(tuple, Search(index, query).hits().collect()))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"word{k % 3} the and the {k}") for k in range(30)]
    path, config = str(tmp_path / "index"), IndexConfig()
    ingest(parts(spark, str(tmp_path / "in"), rows, 3), path, config, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(batches(spark, path)) >= 2 and manifest(spark, path) is None
    docs = document_table(spark.createDataFrame(rows, "doc_id bigint, text string"))
    expected = hits(SpanIndex(config, docs, posting_table(docs, config), {}))
    assert hits(SpanIndex(config, *indexed(spark, path), {})) == expected and len(expected) == 30
    before = SpanIndex(config, *indexed(spark, path), {})
    compact(spark, path)
    compact(spark, path)
    # a reader that opened the index before compaction goes on
    assert hits(before) == hits(SpanIndex(config, *indexed(spark, path), {})) == expected


def test_compaction_after_some_batches(spark, tmp_path):
    rows = [(k, f"Été the and {k}") for k in range(30)]
    path = str(tmp_path / "index")
    config = IndexConfig({"string": "lower", "plain": "accents"}, {"Even": AnnotationType(nominal=("kind",), document_mode=True)})
    even = lambda batch, documents: document_annotations(documents, batch.where("doc_id % 2 = 0").select("doc_id", F.lit("x").alias("kind")), config.annotation_types["Even"])
    job = Ingest(path, config, features={"plain": F.col("tokens")}, annotations={"Even": even}, compact_at=2)
    stream = parts(spark, str(tmp_path / "in"), rows, 6)
    job.writer(stream.withColumn("text", F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    upto = manifest(spark, path)["upto"]
    assert upto >= 3 and min(batches(spark, path)) >= 2
    index = job.index(spark)
    assert len(hits(index)) == 30 and index.documents.count() == 30
    assert hits(index, "plain:ete IN {Even kind=x}") == [(k, 0, 1) for k in range(0, 30, 2)]
    # bytes that aren't UTF-8 are marked
    assert len(hits(index, '"[" "?" "]"')) == 30
    # a batch that is run again after a failure takes the place of its first run
    last = batches(spark, path)[-1]
    if last > upto:
        job.append(spark.createDataFrame([(k, "again") for k in range(25, 30)], "doc_id bigint, text string"), last)
        assert job.index(spark).documents.count() <= 30


def test_compaction_leaves_full_parts_and_shuffles_no_batch_by_term(spark, tmp_path):
    """What is written again doesn't grow with the batches before; a feature's row is the first one's where both agree."""
    path = str(tmp_path / "index")
    config = IndexConfig({"string": "lower", "plain": "accents"})
    job = Ingest(path, config, features={"plain": F.col("tokens")})
    seen = []
    for n in range(6):
        job.append(spark.createDataFrame([(10 * n + k, f"Für the and {k}") for k in range(10)], "doc_id bigint, text string"), n)
        compact(spark, path, full=1)
        seen.append(manifest(spark, path)["parts"])
        assert len(hits(job.index(spark))) == 10 * (n + 1)
    # every batch is full here: none was written again, and none is lost
    assert seen[-1] == [f"batch={n}" for n in range(6)] == [f"batch={n}" for n in batches(spark, path)]
    compact(spark, path)
    job.append(spark.createDataFrame([(60, "für")], "doc_id bigint, text string"), 6)
    compact(spark, path)
    job.append(spark.createDataFrame([(61, "fur")], "doc_id bigint, text string"), 7)
    compact(spark, path)
    # small ones are merged, and a term is found under both features
    index = job.index(spark)
    assert len(manifest(spark, path)["parts"]) < 8 and index.documents.count() == 62
    assert len(hits(index, "plain:für")) == 62 and len(hits(index, "für")) == 61 and len(hits(index, "fur")) == 1
    stored = spark.read.parquet(f"{path}/postings-by-hash/batch=7")
    assert [(r.feature, r.term, r.also) for r in stored.collect()] == [("string", "fur", 2)]
