"""Derived views over the test tables, as Spark plans and as SQL text.

``articles``   (src, id, title, text)      input of the article features
``stage_runs`` long stage metrics           input of the stage / run analytics
``runs``       run header                   input of the scaling analytics

The Spark builders use the DataFrame API; the SQL strings are the same views
for the DuckDB oracle (used as CTEs). Both must describe identical rows.
NULLs are injected by key so the NULL paths of every feature are exercised;
no row is filtered out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.sources.tables import load_table

# --- fixed values -----------------------------------------------------------
# Keywords that do occur in the generated text (the article defaults hit nothing).
PROBE_KEYWORDS = ["ing", "tion", "ment", "eau", "sch", "the", "que"]
SCALING_TYPES = ["Strong_Scaling", "Weak_Scaling", "Worker_Sweep"]
# ---------------------------------------------------------------------------


def articles_from(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """The articles view over given (batch or streaming) documents and pages frames."""
    docs = documents.select(
        F.lit("doc").alias("src"),
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("title"),
        F.when(F.col("doc_id") % 23 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("text")).alias("text"),
    )
    pgs = pages.select(
        F.lit("page").alias("src"),
        F.col("page_id").alias("id"),
        F.regexp_extract(F.col("html"), r"<title>(.*?)</title>", 1).alias("title"),
        F.concat(F.col("url"), F.lit(" "), F.col("html")).alias("text"),
    )
    return docs.unionByName(pgs)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "pages"))


ARTICLES_SQL = """
SELECT 'doc' AS src, doc_id AS id,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS title,
       CASE WHEN doc_id % 23 = 0 THEN NULL ELSE text END AS text
FROM documents
UNION ALL
SELECT 'page', page_id, regexp_extract(html, '<title>(.*?)</title>', 1), url || ' ' || html FROM pages
"""


def stage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("job_id"),
        F.col("l_partkey").alias("stage_id"),
        F.col("l_suppkey").alias("tie"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("int"))
         .otherwise(F.col("l_linenumber") * 4).alias("num_tasks"),
        F.when(F.col("l_linenumber") == 6, F.lit(0.0))
         .otherwise(F.col("l_quantity") * 1000.0).alias("stage_duration_ms"),
        F.floor("l_extendedprice").cast("bigint").alias("records_read"),
        F.col("l_extendedprice").alias("executor_run_time"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("executor_cpu_time"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("jvm_gc_time"),
        (F.col("l_quantity") * 1024).cast("bigint").alias("bytes_read"),
    )


STAGE_RUNS_SQL = """
SELECT l_orderkey AS run_id, l_linenumber AS job_id, l_partkey AS stage_id, l_suppkey AS tie,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber * 4 END AS num_tasks,
       CASE WHEN l_linenumber = 6 THEN 0.0 ELSE l_quantity * 1000.0 END::DOUBLE AS stage_duration_ms,
       CAST(floor(l_extendedprice) AS BIGINT) AS records_read,
       l_extendedprice AS executor_run_time, l_extendedprice * (1 - l_discount) AS executor_cpu_time,
       l_extendedprice * l_tax AS jvm_gc_time, CAST(l_quantity * 1024 AS BIGINT) AS bytes_read
FROM lineitem
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("run_id"),
        F.when(k % 3 == 0, F.lit(SCALING_TYPES[0]))
         .when(k % 3 == 1, F.lit(SCALING_TYPES[1]))
         .otherwise(F.lit(SCALING_TYPES[2])).alias("scaling_type"),
        (1 + F.col("o_custkey") % 16).cast("int").alias("num_workers"),
        (4 * (1 + F.col("o_custkey") % 8)).cast("int").alias("cores_per_worker"),
        ((k % 16 + 1) / 16.0).cast("double").alias("dataset_scale"),
        F.floor("o_totalprice").cast("bigint").alias("num_rows"),
        F.when(k % 50 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / 1000.0)
         .cast("double").alias("e2e_time"),
    )


RUNS_SQL = """
SELECT o_orderkey AS run_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Strong_Scaling' WHEN o_orderkey % 3 = 1 THEN 'Weak_Scaling' ELSE 'Worker_Sweep' END AS scaling_type,
       CAST(1 + o_custkey % 16 AS INT) AS num_workers, CAST(4 * (1 + o_custkey % 8) AS INT) AS cores_per_worker,
       CAST((o_orderkey % 16 + 1) / 16.0 AS DOUBLE) AS dataset_scale,
       CAST(floor(o_totalprice) AS BIGINT) AS num_rows,
       CAST(CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE o_totalprice / 1000.0 END AS DOUBLE) AS e2e_time
FROM orders
"""


def with_views(sql: str, *names: str) -> str:
    """Prefix a query with the fixture views it uses, as CTEs."""
    texts = {"articles": ARTICLES_SQL, "stage_runs": STAGE_RUNS_SQL, "runs": RUNS_SQL}
    ctes = ",\n".join(f"{n} AS ({texts[n]})" for n in names)
    return f"WITH {ctes}\n{sql}"
