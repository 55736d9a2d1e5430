"""Registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, discriminant, html_text, lexical, minmax, packing, pii, quality, spelling, substring_dedup, suffix_dedup, url_filter, warc
from tessera.llm.common import ship_package
from tessera.llm.sql import SQL
from tessera.sources.tables import load_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed values of the URL query's contract.
URL_RULES = [url_filter.UrlRule(*x) for x in (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"))]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.tokenize_pieces(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack_pieces(pieces, docs.count())


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(load_table(spark, sf_dir, "pages"), load_table(spark, sf_dir, "labels"), URL_RULES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(load_table(spark, sf_dir, "documents").select("doc_id", "text"), load_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(load_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(load_table(spark, sf_dir, "pages"))
    full = F.col("record_type") == "response"
    return records.select(
        "page_id", F.when(full, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("header_digest")).alias("payload_digest"), "record_type", "refers_to")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.drop_repeated_bytes(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.drop_repeated_words(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(load_table(spark, sf_dir, "pages"))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.train(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")),
                        F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(load_table(spark, sf_dir, "documents").select("doc_id", "text"), load_table(spark, sf_dir, "benchmark"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.score_quality(load_table(spark, sf_dir, "documents").select("doc_id", "text"), load_table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(load_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _shipped(build: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f) for f in (op1_packing, op2_url_filters, op3_quality_rules, op4_decontamination, op5_minhash_dedup, op6_warc,
    op7_suffix_array_dedup, op8_substring_dedup, op9_html_extraction, op10_pii, op11_ranked_search, op12_quality_classifier, op13_spelling_variants)}
ORACLE_SQL: dict[str, str] = {k: v for k, v in SQL.items() if k in QUERIES}
