"""From raw documents to packed training sequences, one operator per stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
into the shared folder and rereads it as the next stage's documents. All but the last return the columns
of their input. Null texts and ids, repeated rows and empty tables follow the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, minmax, packing, pii, quality
from tessera.llm.catalog import tokenizer_path
from tessera.llm.common import ship_package, written
from tessera.sources.tables import load_table

#: SQL cannot express the boosted trees of the PII stage; tests/llm holds the brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Of rows that repeat that id, one with the smallest text hash stays. Rows without an id are in no group.
    """
    ship_package(spark)
    ids = minmax.near_duplicates(docs.select("doc_id", "text")).where("kept and doc_id is not null").select("doc_id").distinct()
    h = F.xxhash64("text")
    one = docs.groupBy("doc_id").agg(F.min(h).alias("__hash")).join(ids, "doc_id", "left_semi")
    first = docs.withColumn("__hash", h).join(one, ["doc_id", "__hash"], "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return first.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    ship_package(spark)
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), load_table(spark, sf_dir, "benchmark"))
    bad = found.where("n_hit > 0").select(F.col("key").alias("__key")).distinct()
    marked = docs.withColumn("__key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    return marked.join(bad, "__key", "left_anti").select(*docs.columns)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks like <EMAIL>; n_chars follows the new text."""
    ship_package(spark)
    clean = pii.redacted(docs, pii.train(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens."""
    ship_package(spark)
    pieces = packing.tokenize_pieces(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack_pieces(pieces, docs.count())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("pii_redaction", pii_redaction), ("sequence_packing", sequence_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
