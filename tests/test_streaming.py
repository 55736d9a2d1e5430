"""The feature plan as a Structured Streaming job equals the batch plan."""

import os

from conftest import SF001
from tessera.plans.catalog import QUERIES
from tessera.plans.features import extract_features
from tessera.session import shared_path
from tessera.sources.fixtures import articles, articles_from
from tessera.sources.tables import load_table
from tessera.streaming.features import read_stream, start_feature_stream


def test_stream_equals_batch(spark):
    docs = read_stream(spark, SF001, load_table(spark, SF001, "documents").schema, glob="documents.parquet")
    pages = read_stream(spark, SF001, load_table(spark, SF001, "pages").schema, glob="pages.parquet")
    sink, ckpt = shared_path(spark, "t-sink"), shared_path(spark, "t-ckpt")
    q = start_feature_stream(articles_from(docs, pages), sink, ckpt)
    q.awaitTermination()
    streamed = spark.read.parquet(sink)
    batch = extract_features(articles(spark, SF001))
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0
    # a restart with the same checkpoint finds nothing new: exactly-once output
    q2 = start_feature_stream(articles_from(docs, pages), sink, ckpt)
    q2.awaitTermination()
    assert spark.read.parquet(sink).count() == batch.count()


def test_tables_that_are_folders_are_streamed_whole(spark, tmp_dir):
    docs = [(k, f"Title {k}\nThe text of {k}!") for k in range(40)]
    pages = [(k, f"http://a.net/{k}", f"<title>Page {k}</title> the end") for k in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(os.path.join(tmp_dir, "documents.parquet"))
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(os.path.join(tmp_dir, "pages.parquet"))
    streamed = QUERIES["streaming_features"].build(spark, tmp_dir)
    batch = QUERIES["feature_pipeline"].build(spark, tmp_dir).select(*streamed.columns)
    assert streamed.count() == 70 and streamed.exceptAll(batch).count() == 0
