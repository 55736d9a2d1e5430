"""The article feature plan on Structured Streaming.

All features are stateless row-wise expressions, so the streaming plan is
the batch plan over a streaming source: no watermark, no state store, any
output mode works. Exactly-once output comes from the file sink plus the
checkpoint location (which must be a shared, durable folder on a cluster:
a restarted query resumes from its offsets after executor or driver loss).
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.features import extract_features
from tessera.sources.tables import load_table, table_path


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream over the folder ``path`` (new files are picked up as they
    land); ``glob`` restricts it to matching file names."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Stream over a test table, be it one Parquet file or a folder of them.

    The file source takes a plain path for a folder; a pattern (here one that
    only the table's own name fits) may name either."""
    folder, file = os.path.split(table_path(sf_dir, name))
    return read_stream(spark, os.path.join(folder, f"{{{file}}}"), load_table(spark, sf_dir, name).schema)


def start_feature_stream(stream: DataFrame, sink_path: str, checkpoint: str,
                         keywords: Iterable[str] | None = None,
                         stopwords: Iterable[str] | None = None,
                         fmt: str = "parquet", available_now: bool = True,
                         processing_time: str | None = None) -> StreamingQuery:
    """Start the feature stream into a file sink.

    ``available_now=True`` processes everything present and stops (batch-
    style backfill with streaming bookkeeping); otherwise a micro-batch
    trigger every ``processing_time``.
    """
    features = extract_features(stream, keywords=keywords, stopwords=stopwords)
    writer = (features.writeStream.format(fmt).outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", sink_path))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
