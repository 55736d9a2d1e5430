"""Registered queries: a Spark plan and (where SQL can say it) a DuckDB oracle.

Every query reads the given test tables (or data Spark derives from them)
in full; nothing is sub-set, capped or sampled unless the limit is the
feature itself (top-n report, scale-down).

``QUERIES[name] = Query(build, sql)`` where ``build(spark, sf_dir)`` returns
a DataFrame and ``sql`` is DuckDB SQL over the pre-registered tables, or
None when only a rows-only check is meaningful.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as T
from tessera.functions.lexicon import default_stopwords
from tessera.plans import sqltext as S
from tessera.plans.features import extract_features
from tessera.sources import fixtures as X


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = Query(fn, sql)
        return fn
    return deco


# ----------------------------------------------------------------------------
# Article features (F1-F19) over the `articles` view
# ----------------------------------------------------------------------------

KEY = ["src", "id"]


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.articles(spark, sf_dir)


def _sql_articles(select: str) -> str:
    return X.with_views(f"SELECT src, id, {select} FROM articles", "articles")


@register("feat_lengths", _sql_articles(
    f"{S.length('title')} AS title_length, {S.length('text')} AS text_length"))
def feat_lengths(spark, sf_dir):
    return _articles(spark, sf_dir).select(
        *KEY, T.char_length("title").alias("title_length"), T.char_length("text").alias("text_length"))


@register("feat_word_counts", _sql_articles(
    f"{S.word_count('title')} AS title_word_count, {S.word_count('text')} AS text_word_count"))
def feat_word_counts(spark, sf_dir):
    return _articles(spark, sf_dir).select(
        *KEY, T.word_count("title").alias("title_word_count"), T.word_count("text").alias("text_word_count"))


@register("feat_ratios", _sql_articles(
    f"{S.ratio('length(title)', 'length(text)')} AS title_text_length_ratio, "
    f"{S.ratio(S.word_count('title'), S.word_count('text'))} AS title_text_wordcount_ratio"))
def feat_ratios(spark, sf_dir):
    return _articles(spark, sf_dir).select(
        *KEY,
        T.smoothed_ratio(T.char_length("title"), T.char_length("text")).alias("title_text_length_ratio"),
        T.smoothed_ratio(T.word_count("title"), T.word_count("text")).alias("title_text_wordcount_ratio"))


@register("feat_punct", _sql_articles(
    f"{S.exclamation_count('title')} AS title_exclamation_count, "
    f"{S.exclamation_count('text')} AS text_exclamation_count, "
    f"{S.question_count('title')} AS title_question_count, "
    f"{S.question_count('text')} AS text_question_count"))
def feat_punct(spark, sf_dir):
    return _articles(spark, sf_dir).select(
        *KEY,
        T.count_char("title", "!").alias("title_exclamation_count"),
        T.count_char("text", "!").alias("text_exclamation_count"),
        T.count_char("title", "?").alias("title_question_count"),
        T.count_char("text", "?").alias("text_question_count"))


@register("feat_caps_ratio", _sql_articles(f"{S.caps_ratio('title')} AS title_caps_ratio"))
def feat_caps_ratio(spark, sf_dir):
    return _articles(spark, sf_dir).select(*KEY, T.caps_ratio("title").alias("title_caps_ratio"))


@register("feat_digits", _sql_articles(f"{S.digit_count('text')} AS text_digit_count"))
def feat_digits(spark, sf_dir):
    return _articles(spark, sf_dir).select(*KEY, T.digit_count("text").alias("text_digit_count"))


@register("feat_special_chars", _sql_articles(
    f"{S.special_char_count('text')} AS text_specialchar_count, "
    f"{S.special_char_count('title')} AS title_specialchar_count"))
def feat_special_chars(spark, sf_dir):
    return _articles(spark, sf_dir).select(
        *KEY, T.special_char_count("text").alias("text_specialchar_count"),
        T.special_char_count("title").alias("title_specialchar_count"))


@register("feat_contains_url", _sql_articles(
    f"{S.has_url('text')} AS contains_url, {S.has_url('title')} AS title_contains_url"))
def feat_contains_url(spark, sf_dir):
    return _articles(spark, sf_dir).select(
        *KEY, T.has_url("text").alias("contains_url"), T.has_url("title").alias("title_contains_url"))


@register("feat_keyword_hits", _sql_articles(
    f"{S.keyword_hits(['text', 'title'], X.PROBE_KEYWORDS)} AS fake_keywords_count"))
def feat_keyword_hits(spark, sf_dir):
    return _articles(spark, sf_dir).select(
        *KEY, T.keyword_hits(["text", "title"], X.PROBE_KEYWORDS).alias("fake_keywords_count"))


@register("feat_stopword_column", _sql_articles(
    f"CAST(len({S.sql_list(default_stopwords())}) AS INT) AS stopwords_size, "
    f"array_to_string({S.sql_list(default_stopwords())}, '|') AS stopwords_joined"))
def feat_stopword_column(spark, sf_dir):
    sw = _articles(spark, sf_dir).select(*KEY, T.stopword_array().alias("stopwords"))
    return sw.select(*KEY, F.array_size("stopwords").alias("stopwords_size"),
                     F.array_join("stopwords", "|").alias("stopwords_joined"))


@register("feat_clean_title", _sql_articles(f"{S.clean_text('title')} AS title_clean"))
def feat_clean_title(spark, sf_dir):
    return _articles(spark, sf_dir).select(*KEY, T.clean_text("title").alias("title_clean"))


@register("feat_clean_text", _sql_articles(f"{S.clean_text('text')} AS text_clean"))
def feat_clean_text(spark, sf_dir):
    return _articles(spark, sf_dir).select(*KEY, T.clean_text("text").alias("text_clean"))


_PIPELINE_SQL = _sql_articles(", ".join([
    "title", "text",
    f"{S.length('title')} AS title_length", f"{S.length('text')} AS text_length",
    f"{S.word_count('title')} AS title_word_count", f"{S.word_count('text')} AS text_word_count",
    f"{S.ratio('length(title)', 'length(text)')} AS title_text_length_ratio",
    f"{S.ratio(S.word_count('title'), S.word_count('text'))} AS title_text_wordcount_ratio",
    f"{S.exclamation_count('title')} AS title_exclamation_count",
    f"{S.exclamation_count('text')} AS text_exclamation_count",
    f"{S.question_count('title')} AS title_question_count",
    f"{S.question_count('text')} AS text_question_count",
    f"{S.caps_ratio('title')} AS title_caps_ratio",
    f"{S.digit_count('text')} AS text_digit_count",
    f"{S.special_char_count('text')} AS text_specialchar_count",
    f"{S.has_url('text')} AS contains_url",
    f"{S.keyword_hits(['text', 'title'], X.PROBE_KEYWORDS)} AS fake_keywords_count",
    f"{S.clean_text('title')} AS title_clean",
    f"{S.clean_text('text')} AS text_clean",
]))


@register("feature_pipeline", _PIPELINE_SQL)
def feature_pipeline(spark, sf_dir):
    return extract_features(_articles(spark, sf_dir), keywords=X.PROBE_KEYWORDS)


# ----------------------------------------------------------------------------
# Stage / run analytics (A1-A21) over `stage_runs` and `runs`
# ----------------------------------------------------------------------------

from tessera.functions.metrics import throughput  # noqa: E402
from tessera.operators import scaling as SC  # noqa: E402
from tessera.operators import stages as ST  # noqa: E402
from tessera.session import written  # noqa: E402
from tessera.operators.rowwise import WIDE_TOTALS, long_totals, with_wide_totals  # noqa: E402

# Widest run of the sf0.01 data: the oracle SQL spells out this many stage
# slots; the Spark side takes the width from the data.
PIVOT_STAGES = 24

_T = "stage_duration_ms / 1000.0"
_THR = f"CASE WHEN {_T} > 0 THEN records_read / ({_T}) ELSE 0.0 END"
_SQL_METRIC = {
    "time": _T, "throughput": _THR, "executorRunTime": "executor_run_time",
    "executorCpuTime": "executor_cpu_time", "jvmGCTime": "jvm_gc_time",
    "recordsRead": "records_read", "bytesRead": "bytes_read",
}
_SQL_TOTALS = f"""
SELECT run_id, coalesce(sum({_T}), 0.0) AS total_stage_time, avg({_THR}) AS average_stage_throughput,
       coalesce(sum(executor_run_time), 0.0) AS Total_Executor_Run_Time,
       coalesce(sum(executor_cpu_time), 0.0) AS Total_Executor_CPU_Time,
       coalesce(sum(jvm_gc_time), 0.0) AS Total_JVM_GC_Time
FROM stage_runs GROUP BY run_id"""
_SQL_SUMMARY = f"""
summary AS (
SELECT r.run_id, r.scaling_type, r.num_workers, r.cores_per_worker, r.dataset_scale,
       r.e2e_time AS E2E_time,
       CASE WHEN r.e2e_time > 0 THEN r.num_rows / r.e2e_time ELSE 0.0 END AS E2E_throughput,
       coalesce(t.total_stage_time, 0.0) AS total_stage_time, t.average_stage_throughput,
       coalesce(t.Total_Executor_Run_Time, 0.0) AS Total_Executor_Run_Time,
       coalesce(t.Total_Executor_CPU_Time, 0.0) AS Total_Executor_CPU_Time,
       coalesce(t.Total_JVM_GC_Time, 0.0) AS Total_JVM_GC_Time,
       r.num_workers * r.cores_per_worker AS total_cores,
       CASE WHEN coalesce(t.Total_Executor_Run_Time, 0.0) = 0 THEN NULL
            ELSE t.Total_Executor_CPU_Time / t.Total_Executor_Run_Time * 100 END AS CPU_Efficiency
FROM runs r LEFT JOIN ({_SQL_TOTALS}) t USING (run_id))"""
_ROUNDED = ["total_stage_time", "average_stage_throughput", "Total_Executor_Run_Time",
            "Total_Executor_CPU_Time", "Total_JVM_GC_Time", "CPU_Efficiency"]


def _r6(df: DataFrame, cols) -> DataFrame:
    """Round float sums to 6 decimals (summation order differs between engines)."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols if c in df.columns})


def _sql_r6(cols, rounded=_ROUNDED) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in rounded else c for c in cols)


def _summary(spark, sf_dir) -> DataFrame:
    return SC.scaling_summary(X.runs(spark, sf_dir), X.stage_runs(spark, sf_dir))


def _summary_sql(select: str, tail: str = "") -> str:
    base = X.with_views("SELECT 1", "runs", "stage_runs").replace("\nSELECT 1", "")
    return f"{base},{_SQL_SUMMARY}\nSELECT {select} FROM summary {tail}"


@register("run_totals", X.with_views(
    "SELECT run_id, CAST(count(*) AS BIGINT) AS num_stages, "
    "CAST(sum(coalesce(num_tasks, 0)) AS BIGINT) AS num_tasks FROM stage_runs GROUP BY run_id", "stage_runs"))
def q_run_totals(spark, sf_dir):
    return ST.run_totals(X.stage_runs(spark, sf_dir))


@register("stage_throughput", X.with_views(
    f"SELECT run_id, job_id, stage_id, tie, {_T} AS stage_time_s, {_THR} AS stage_throughput "
    "FROM stage_runs", "stage_runs"))
def q_stage_throughput(spark, sf_dir):
    return ST.stage_metrics(X.stage_runs(spark, sf_dir)).select(
        "run_id", "job_id", "stage_id", "tie", "stage_time_s", "stage_throughput")


@register("stage_index", X.with_views(
    "SELECT run_id, job_id, stage_id, tie, num_tasks, records_read, executor_run_time, CAST(row_number() OVER "
    "(PARTITION BY run_id ORDER BY job_id, stage_id, tie, num_tasks, records_read, executor_run_time) - 1 AS INT) "
    "AS stage_idx FROM stage_runs",
    "stage_runs"))
def q_stage_index(spark, sf_dir):
    # the payload columns break ties, so that the index of every whole row is defined
    order = (*ST.DEFAULT_ORDER, "num_tasks", "records_read", "executor_run_time")
    return ST.stage_index(X.stage_runs(spark, sf_dir), order=order, skew_safe=True).select(
        "run_id", "job_id", "stage_id", "tie", "num_tasks", "records_read", "executor_run_time", "stage_idx")


def _pivot_sql(n: int) -> str:
    slots = ",\n       ".join(
        f"max(CASE WHEN idx = {i} THEN {_SQL_METRIC[m]} END) AS stage{i}_{m}"
        for i in range(n) for m in ST.STAGE_METRICS)
    return X.with_views(
        "SELECT run_id, CAST(count(*) AS BIGINT) AS num_stages, "
        "CAST(sum(coalesce(num_tasks, 0)) AS BIGINT) AS num_tasks,\n       " + slots +
        "\nFROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY job_id, stage_id, tie, "
        + ", ".join(f"{_SQL_METRIC[m]} NULLS FIRST" for m in ST.STAGE_METRICS) + ") - 1 AS idx "
        "FROM stage_runs) GROUP BY run_id", "stage_runs")


@register("pivot_stages", _pivot_sql(PIVOT_STAGES))
def q_pivot_stages(spark, sf_dir):
    return ST.pivot_stages(X.stage_runs(spark, sf_dir), PIVOT_STAGES)


#: Slots of the wide records, two columns each (tests/test_plans.py has 5,000 columns).
WIDE_SLOTS = 100


@register("long_totals", X.with_views(f"""
, cells AS (SELECT tie, run_id % {WIDE_SLOTS} AS slot, sum(records_read) AS r, sum(bytes_read) AS b FROM stage_runs GROUP BY 1, 2)
SELECT tie, CAST(sum(r) AS DOUBLE) AS total_stage_time, round(sum(b) / count(b), 6) AS average_stage_throughput FROM cells GROUP BY tie""".replace("\n, cells", ", cells", 1), "stage_runs"))
def q_long_totals(spark, sf_dir):
    """Totals over wide records by unpivoting them: per supplier, records and bytes read in 100 slots."""
    cells = (X.stage_runs(spark, sf_dir).groupBy("tie", (F.col("run_id") % WIDE_SLOTS).cast("int").alias("slot"))
             .agg(F.sum("records_read").alias("r"), F.sum("bytes_read").alias("b")))
    filled = cells.groupBy("tie").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("r", "b")))).alias("m"))
    row = filled.select("tie", F.transform(F.sequence(F.lit(0), F.lit(WIDE_SLOTS - 1)), lambda i: F.try_element_at("m", i)).alias("a"))
    wide = written(row, "slots").select("tie", *[F.get("a", i)[f].alias(f"stage{i}_{n}") for i in range(WIDE_SLOTS) for f, n in (("r", "time"), ("b", "throughput"))])
    return long_totals(written(wide, "wide-records"), ["tie"], WIDE_TOTALS).withColumn("average_stage_throughput", F.round("average_stage_throughput", 6))


@register("wide_row_sums", X.with_views(
    "SELECT run_id, round(total_stage_time, 6) AS total_stage_time, "
    "round(Total_Executor_Run_Time, 6) AS Total_Executor_Run_Time, "
    "round(Total_Executor_CPU_Time, 6) AS Total_Executor_CPU_Time, "
    f"round(Total_JVM_GC_Time, 6) AS Total_JVM_GC_Time FROM ({_SQL_TOTALS})", "stage_runs"))
def q_wide_row_sums(spark, sf_dir):
    wide = with_wide_totals(ST.pivot_stages(X.stage_runs(spark, sf_dir)))
    return _r6(wide.select("run_id", "total_stage_time", "Total_Executor_Run_Time",
                           "Total_Executor_CPU_Time", "Total_JVM_GC_Time"), _ROUNDED)


@register("wide_row_mean", X.with_views(
    f"SELECT run_id, round(average_stage_throughput, 6) AS average_stage_throughput FROM ({_SQL_TOTALS})",
    "stage_runs"))
def q_wide_row_mean(spark, sf_dir):
    wide = with_wide_totals(ST.pivot_stages(X.stage_runs(spark, sf_dir)))
    return _r6(wide.select("run_id", "average_stage_throughput"), _ROUNDED)


_LABELS_SQL = ("CAST(num_workers AS VARCHAR) || 'W-' || CAST(cores_per_worker AS VARCHAR) || 'C' AS config_name, "
               "CASE WHEN scaling_type = 'Worker_Sweep' "
               "THEN CAST(num_workers AS VARCHAR) || 'W' || chr(10) || CAST(cores_per_worker AS VARCHAR) || 'C' "
               "ELSE CAST(num_workers * cores_per_worker AS VARCHAR) || chr(10) || '(scale=' "
               "|| CAST(dataset_scale AS VARCHAR) || ')' END AS x_label")


@register("config_label", X.with_views(
    f"SELECT run_id, {_LABELS_SQL}, num_workers * cores_per_worker AS total_cores FROM runs", "runs"))
def q_config_label(spark, sf_dir):
    return SC.with_labels(X.runs(spark, sf_dir)).select("run_id", "config_name", "x_label", "total_cores")


@register("total_product", X.with_views(
    "SELECT run_id, num_workers, cores_per_worker, num_workers * cores_per_worker AS total_cores FROM runs",
    "runs"))
def q_total_product(spark, sf_dir):
    from tessera.functions.metrics import total_cores
    return X.runs(spark, sf_dir).select("run_id", "num_workers", "cores_per_worker",
                                        total_cores().alias("total_cores"))


@register("speedup_vs_baseline", X.with_views("""
SELECT run_id, scaling_type, total_cores, E2E_throughput,
       CASE WHEN first_value(E2E_throughput) OVER w = 0 THEN NULL
            ELSE E2E_throughput / first_value(E2E_throughput) OVER w END AS speedup
FROM (SELECT run_id, scaling_type, num_workers * cores_per_worker AS total_cores,
             CASE WHEN e2e_time > 0 THEN num_rows / e2e_time ELSE 0.0 END AS E2E_throughput FROM runs)
WINDOW w AS (PARTITION BY scaling_type ORDER BY total_cores, run_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", "runs"))
def q_speedup(spark, sf_dir):
    from tessera.functions.metrics import total_cores
    r = X.runs(spark, sf_dir).select(
        "run_id", "scaling_type", total_cores().alias("total_cores"),
        throughput("num_rows", "e2e_time").alias("E2E_throughput"))
    return SC.speedup(r, ["scaling_type"], ["total_cores", "run_id"], "E2E_throughput").select(
        "run_id", "scaling_type", "total_cores", "E2E_throughput", "speedup")


_SUMMARY_COLS = ["run_id", "scaling_type", "num_workers", "cores_per_worker", "dataset_scale", "E2E_time",
                 "E2E_throughput", "total_stage_time", "average_stage_throughput", "Total_Executor_Run_Time",
                 "Total_Executor_CPU_Time", "Total_JVM_GC_Time", "total_cores", "CPU_Efficiency"]


@register("scaling_summary", _summary_sql(_sql_r6(_SUMMARY_COLS)))
def q_scaling_summary(spark, sf_dir):
    return _r6(SC.sorted_report(_summary(spark, sf_dir), ["scaling_type", "total_cores"], ["run_id"]),
               _ROUNDED)


@register("top_runs", _summary_sql(_sql_r6(_SUMMARY_COLS), "ORDER BY scaling_type, total_cores, run_id LIMIT 10"))
def q_top_runs(spark, sf_dir):
    """The order keys come from the run header: its top rows are taken first, only their stages are added up."""
    from tessera.functions.metrics import total_cores
    order = ["scaling_type", "total_cores", "run_id"]
    first = SC.top_n(X.runs(spark, sf_dir).withColumn("total_cores", total_cores()), order, 10)
    stages = X.stage_runs(spark, sf_dir).join(first.select("run_id"), "run_id", "left_semi")
    return _r6(SC.sorted_report(SC.scaling_summary(first, stages), order), _ROUNDED)


@register("wide_summary", _summary_sql(_sql_r6(_SUMMARY_COLS)))
def q_wide_summary(spark, sf_dir):
    """The summary by the wide route: run records with stage columns, one frame per group, tagged,
    united by name, totalled over their columns and projected by prefix."""
    wide = ST.pivot_stages(X.stage_runs(spark, sf_dir)).drop("num_stages", "num_tasks")
    header = X.runs(spark, sf_dir).withColumns({
        "E2E_time": F.col("e2e_time").cast("double"), "E2E_throughput": throughput("num_rows", "e2e_time")})
    records = header.join(wide, "run_id", "left")
    groups = {g: records.filter(F.col("scaling_type") == g).drop("scaling_type") for g in X.SCALING_TYPES}
    return _r6(SC.summarize_records(SC.tag_and_union(groups), keep=["run_id"]).select(*_SUMMARY_COLS), _ROUNDED)


@register("cpu_efficiency", _summary_sql(
    _sql_r6(["run_id", "total_cores", "Total_Executor_Run_Time", "Total_Executor_CPU_Time", "CPU_Efficiency"]),
    "WHERE scaling_type = 'Strong_Scaling'"))
def q_cpu_efficiency(spark, sf_dir):
    return _r6(SC.executor_times(_summary(spark, sf_dir)), _ROUNDED)


@register("compare_scaling", _summary_sql(
    "run_id, scaling_type, " + _LABELS_SQL.split(", CASE")[0] + ", total_cores, dataset_scale, "
    "CAST(total_cores AS VARCHAR) || chr(10) || '(scale=' || CAST(dataset_scale AS VARCHAR) || ')' AS x_label, "
    "round(average_stage_throughput, 6) AS average_stage_throughput",
    "WHERE scaling_type IN ('Strong_Scaling', 'Weak_Scaling')"))
def q_compare_scaling(spark, sf_dir):
    return _r6(SC.compare_scaling(_summary(spark, sf_dir)), _ROUNDED)


@register("worker_sweep", _summary_sql(
    "run_id, " + _LABELS_SQL.split(", CASE")[0] + ", "
    "CAST(num_workers AS VARCHAR) || 'W' || chr(10) || CAST(cores_per_worker AS VARCHAR) || 'C' AS x_label, "
    "num_workers, cores_per_worker, total_cores, E2E_time, E2E_throughput",
    "WHERE scaling_type = 'Worker_Sweep'"))
def q_worker_sweep(spark, sf_dir):
    return SC.sorted_report(SC.worker_sweep(_summary(spark, sf_dir)), ["num_workers"], ["run_id"])


@register("gc_by_config", _summary_sql(
    "run_id, " + _LABELS_SQL.split(", CASE")[0] + ", num_workers, cores_per_worker, total_cores, E2E_time, "
    "round(Total_JVM_GC_Time, 6) AS Total_JVM_GC_Time",
    "WHERE scaling_type = 'Worker_Sweep'"))
def q_gc_by_config(spark, sf_dir):
    return _r6(SC.gc_by_config(_summary(spark, sf_dir)), _ROUNDED)


# ----------------------------------------------------------------------------
# Shaping (S3, S5-S7), sources and sinks (S1, S2, S4, S10, S11)
# ----------------------------------------------------------------------------

from pyspark.sql import types as Ty  # noqa: E402

from tessera.operators import shaping as SH  # noqa: E402
from tessera.session import shared_path  # noqa: E402
from tessera.sources import csv as CSV  # noqa: E402

ARTICLE_SCHEMA = Ty.StructType([
    Ty.StructField("src", Ty.StringType()), Ty.StructField("id", Ty.LongType()),
    Ty.StructField("title", Ty.StringType()), Ty.StructField("text", Ty.StringType()),
])
TAKE_SCALE = 0.0625


@register("union_ragged", X.with_views("""
SELECT run_id, scaling_type, num_workers, CAST(NULL AS BIGINT) AS num_stages, CAST(NULL AS BIGINT) AS num_tasks
FROM runs
UNION ALL
SELECT run_id, NULL, NULL, CAST(count(*) AS BIGINT), CAST(sum(coalesce(num_tasks, 0)) AS BIGINT)
FROM stage_runs GROUP BY run_id""", "runs", "stage_runs"))
def q_union_ragged(spark, sf_dir):
    header = X.runs(spark, sf_dir).select("run_id", "scaling_type", "num_workers")
    totals = ST.run_totals(X.stage_runs(spark, sf_dir))
    return SH.union_ragged([header, totals])


@register("replicate", X.with_views(
    "SELECT * FROM articles UNION ALL SELECT * FROM articles UNION ALL SELECT * FROM articles", "articles"))
def q_replicate(spark, sf_dir):
    return SH.replicate(_articles(spark, sf_dir), 3)


@register("count_rows", X.with_views("SELECT CAST(count(*) AS BIGINT) AS num_rows FROM articles", "articles"))
def q_count_rows(spark, sf_dir):
    return SH.count_rows(_articles(spark, sf_dir))


@register("take_fraction", X.with_views(f"""
SELECT src, id, title, text FROM (
  SELECT *, row_number() OVER (ORDER BY src, id) AS rn, count(*) OVER () AS total FROM articles)
WHERE rn <= CAST(floor(total * {TAKE_SCALE}) AS BIGINT)""", "articles"))
def q_take_fraction(spark, sf_dir):
    return SH.take_fraction(_articles(spark, sf_dir), TAKE_SCALE, KEY)


from tessera.operators import biglists as BL  # noqa: E402

_WORDS_SQL = f"unnest(string_split({S.clean_text('text', [])}, ' '))"


@register("clean_text_by_table", X.with_views(f"""
, stop AS (SELECT DISTINCT w FROM (SELECT {_WORDS_SQL} AS w FROM conversations) WHERE length(w) BETWEEN 1 AND 6),
kept AS (SELECT src, id, p, w FROM (SELECT src, id, unnest(t) AS w, generate_subscripts(t, 1) AS p
  FROM (SELECT src, id, string_split({S.clean_text('text', [])}, ' ') AS t FROM articles)) WHERE w <> '' AND w NOT IN (SELECT w FROM stop))
SELECT articles.src, articles.id, coalesce(string_agg(w, ' ' ORDER BY p), '') AS text_clean
FROM articles LEFT JOIN kept ON articles.src = kept.src AND articles.id = kept.id GROUP BY 1, 2""".replace("\n, stop", ", stop", 1), "articles"))
def q_clean_text_by_table(spark, sf_dir):
    """Cleaned texts with a stop-word table: the short words of all conversations."""
    from tessera.sources.tables import load_table
    words = load_table(spark, sf_dir, "conversations").select(F.explode(F.split(T.clean_text("text", []), " ")).alias("w"))
    stop = words.where(F.length("w").between(1, 6)).distinct()
    return BL.clean_text_by_table(_articles(spark, sf_dir), ["text"], stop, KEY).select(*KEY, "text_clean")


@register("keyword_hits_by_table", X.with_views(f"""
, words AS (SELECT w FROM (SELECT {_WORDS_SQL} AS w FROM benchmark) WHERE w <> '' GROUP BY w HAVING count(*) <= 20)
SELECT src, id, CAST(sum(CAST(contains(coalesce(lower(text), ''), w) AS INT) + CAST(contains(coalesce(lower(title), ''), w) AS INT)) AS INT) AS keyword_hits
FROM articles CROSS JOIN words GROUP BY src, id""".replace("\n, words", ", words", 1), "articles"))
def q_keyword_hits_by_table(spark, sf_dir):
    """Hits of a keyword table: the words of all benchmark items that occur there at most 20 times."""
    from tessera.sources.tables import load_table
    words = load_table(spark, sf_dir, "benchmark").select(F.explode(F.split(T.clean_text("text", []), " ")).alias("w")).where("w <> ''")
    rare = words.groupBy("w").agg(F.count("*").alias("n")).where("n <= 20").select("w")
    return BL.keyword_hits_by_table(_articles(spark, sf_dir), ["text", "title"], rare, KEY).select(*KEY, "keyword_hits")


@register("sample_fraction", X.with_views("""
SELECT src, id FROM articles
WHERE ('0x' || substr(md5('3' || chr(31) || coalesce('=' || src, '-') || chr(31) || coalesce('=' || CAST(id AS VARCHAR), '-')), 1, 15))::BIGINT
      < CAST(0.25 * 1152921504606846976 AS BIGINT)""", "articles"))
def q_sample_fraction(spark, sf_dir):
    """A quarter of the articles, approximately, by the hash of their key."""
    return SH.sample_fraction(_articles(spark, sf_dir), 0.25, KEY, seed=3).select(*KEY)


@register("scan_articles", X.with_views("SELECT src, id, title, text FROM articles", "articles"))
def q_scan_articles(spark, sf_dir):
    """Articles written as RFC-4180 CSV by Spark, read back with the CSV scan."""
    path = shared_path(spark, "articles-csv")
    CSV.write_csv(_articles(spark, sf_dir), path)
    return CSV.read_articles(spark, path, schema=ARTICLE_SCHEMA, strict=True)


@register("with_source", X.with_views(
    "SELECT src, id, title, text, src || '-files' AS folder FROM articles", "articles"))
def q_with_source(spark, sf_dir):
    """Provenance: each source's rows written to its own folder, read back in
    one scan; the folder name comes from the file path of every row."""
    root = shared_path(spark, "articles-by-source")
    arts = _articles(spark, sf_dir)
    for src in ("doc", "page"):
        CSV.write_csv(arts.filter(F.col("src") == src), f"{root}/{src}-files")
    read = CSV.read_with_source(spark, [f"{root}/doc-files", f"{root}/page-files"], ARTICLE_SCHEMA,
                                options={"header": "true", "multiLine": "true", "escape": '"'})
    return read.select("src", "id", "title", "text",
                       CSV.base_name(F.col("log_dir")).alias("folder"))


# Run files written per scaling group with different column sets (ragged).
_RUN_FILE_LAYOUTS = [
    ("SS-runs", SC.STRONG, ["run_id", "num_workers", "cores_per_worker", "dataset_scale", "num_rows", "e2e_time"]),
    ("WS-runs", SC.WEAK, ["run_id", "num_workers", "cores_per_worker", "dataset_scale", "num_rows"]),
    ("W-runs", SC.SWEEP, ["run_id", "num_workers", "cores_per_worker", "e2e_time"]),
]


@register("classify_runs", X.with_views("""
SELECT run_id, scaling_type, num_workers, cores_per_worker,
       CASE WHEN scaling_type <> 'Worker_Sweep' THEN dataset_scale END AS dataset_scale,
       CASE WHEN scaling_type <> 'Worker_Sweep' THEN num_rows END AS num_rows,
       CASE WHEN scaling_type <> 'Weak_Scaling' THEN e2e_time END AS e2e_time,
       CASE scaling_type WHEN 'Strong_Scaling' THEN 'SS-runs' WHEN 'Weak_Scaling' THEN 'WS-runs'
            ELSE 'W-runs' END AS log_name
FROM runs""", "runs"))
def q_classify_runs(spark, sf_dir):
    """Run records written as ragged CSV files per group folder, then read
    back by header layout, unioned by name and classified by folder prefix."""
    root = shared_path(spark, "run-files")
    r = X.runs(spark, sf_dir)
    for folder, label, cols in _RUN_FILE_LAYOUTS:
        CSV.write_runs(r.filter(F.col("scaling_type") == label).select(*cols), f"{root}/{folder}", order=cols)
    back = CSV.read_runs(spark, f"{root}/*/*.csv", classify_by="dir")
    return back.select("run_id", "scaling_type", "num_workers", "cores_per_worker", "dataset_scale",
                       "num_rows", "e2e_time",
                       CSV.base_name(F.col("log_dir")).alias("log_name"))


def _cut_short(spark, folder: str) -> None:
    """Replace the one file of a folder by its first half, by Hadoop's file system wherever the folder lies."""
    hadoop = spark._jvm.org.apache.hadoop
    path, whole = hadoop.fs.Path(folder), hadoop.fs.Path(folder + "/whole")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    status = next(s for s in fs.listStatus(path) if s.getPath().getName().startswith("part-"))
    fs.rename(status.getPath(), whole)
    half = spark._jvm.org.apache.commons.io.input.BoundedInputStream(fs.open(whole), status.getLen() // 2)
    hadoop.io.IOUtils.copyBytes(half, fs.create(status.getPath()), 1 << 16, True)


@register("read_or_report", """
SELECT 'orders' AS folder, o_orderkey AS id, o_orderstatus AS tag, o_totalprice AS amount, NULL AS reason FROM orders
UNION ALL SELECT 'nations', NULL, NULL, NULL, 'broken archive' UNION ALL SELECT 'customers', NULL, NULL, NULL, 'unexpected header'
UNION ALL SELECT 'suppliers', NULL, NULL, NULL, 'value of another type'""")
def q_read_or_report(spark, sf_dir):
    """Orders, customers, suppliers and nations written as packed CSV: the orders fit, the customers have another header,
    the suppliers words for numbers, and the nations' file is cut short. The rows of the good files and a report of the others."""
    from tessera.sources.quarantine import read_or_report
    from tessera.sources.tables import load_table

    root = shared_path(spark, "results")
    table = lambda name, *cols: load_table(spark, sf_dir, name).selectExpr(*cols)
    for folder, df in (("orders", table("orders", "o_orderkey id", "o_orderstatus tag", "o_totalprice amount")),
                       ("customers", table("customer", "c_custkey id", "c_name label", "c_acctbal amount")),
                       ("suppliers", table("supplier", "s_suppkey id", "s_name tag", "s_name amount")),
                       ("nations", table("nation", "n_nationkey id", "n_name tag", "n_regionkey amount").coalesce(1))):
        df.write.option("header", True).option("compression", "gzip").csv(f"{root}/{folder}")
    _cut_short(spark, f"{root}/nations")
    rows, rejected = read_or_report(spark, root, "id bigint, tag string, amount double")
    folder = CSV.base_name(F.col("log_dir")).alias("folder")
    return rows.select(folder, "id", "tag", "amount", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select(folder, "reason").distinct(), allowMissingColumns=True)


@register("summary_export", _summary_sql(_sql_r6(_SUMMARY_COLS)))
def q_summary_export(spark, sf_dir):
    """Processed summary exported as sorted CSV and read back."""
    path = shared_path(spark, "summary-csv")
    CSV.export_summary(_summary(spark, sf_dir), path, tie=["run_id"])
    schema = ", ".join(
        f"{c} {t}" for c, t in [
            ("run_id", "bigint"), ("scaling_type", "string"), ("num_workers", "int"),
            ("cores_per_worker", "int"), ("dataset_scale", "double"), ("E2E_time", "double"),
            ("E2E_throughput", "double"), ("total_stage_time", "double"),
            ("average_stage_throughput", "double"), ("Total_Executor_Run_Time", "double"),
            ("Total_Executor_CPU_Time", "double"), ("Total_JVM_GC_Time", "double"),
            ("total_cores", "int"), ("CPU_Efficiency", "double")])
    return _r6(CSV.read_articles(spark, path, schema=schema, strict=True), _ROUNDED)


# ----------------------------------------------------------------------------
# Validation (V1-V4) over `events`, measurement (M1), streaming
# ----------------------------------------------------------------------------

from tessera.operators import validation as V  # noqa: E402
from tessera.operators.measure import measure  # noqa: E402

_PROPS = Ty.StructType([Ty.StructField("k", Ty.LongType())])
_SQL_K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _events_with_k(spark, sf_dir) -> DataFrame:
    from tessera.sources.tables import load_table
    ev = V.parse_json(load_table(spark, sf_dir, "events"), "props", _PROPS, "doc")
    return ev.withColumn("k", F.col("doc.k"))


@register("validate_records", f"""
SELECT event_id, {_SQL_K} AS k, NOT coalesce(json_valid(props), true) AS malformed,
       CASE WHEN {_SQL_K} IS NULL THEN 'k' END AS missing_field
FROM events""")
def q_validate_records(spark, sf_dir):
    ev = V.require_fields(_events_with_k(spark, sf_dir), ["k"])
    return ev.select("event_id", "k", F.col("doc_malformed").alias("malformed"), "missing_field")


@register("validate_ranges", f"""
SELECT event_id, failed_rule IS NULL AS valid, failed_rule FROM (
  SELECT event_id, CASE WHEN NOT coalesce({_SQL_K} >= 1, false) THEN 'k>=1'
                        WHEN NOT coalesce(value BETWEEN 0 AND 50, false) THEN '0<=value<=50' END AS failed_rule
  FROM events)""")
def q_validate_ranges(spark, sf_dir):
    rules = {"k>=1": F.col("k") >= 1, "0<=value<=50": F.col("value").between(0, 50)}
    return V.check_ranges(_events_with_k(spark, sf_dir), rules).select("event_id", "valid", "failed_rule")


@register("fill_defaults", """
SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, '') AS remark,
       '' AS benchmark_name, 'logs/' || event_type AS log_dir
FROM events""")
def q_fill_defaults(spark, sf_dir):
    from tessera.sources.tables import load_table
    ev = load_table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("remark"),
        F.concat(F.lit("logs/"), F.col("event_type")).alias("log_dir"))
    return V.with_defaults(ev, V.RUN_CONFIG_DEFAULTS).select("event_id", "remark", "benchmark_name", "log_dir")


@register("validate_configs", f"""
SELECT event_id,
  CASE WHEN event_type = 'view' THEN 'missing field: log_dir'
       WHEN NOT (user_id >= 1) THEN 'out of range: num_workers>=1'
       WHEN NOT coalesce(k >= 1, false) THEN 'out of range: mem_per_worker>=1'
       WHEN NOT (length(event_type) >= 1) THEN 'out of range: cores_per_worker>=1'
       WHEN NOT (value / 100.0 BETWEEN 0 AND 1) THEN 'out of range: 0<=dataset_scale<=1'
  END AS reason,
  '' AS remark
FROM (SELECT *, {_SQL_K} AS k FROM events)""")
def q_validate_configs(spark, sf_dir):
    """Run requests as JSON documents (built from events), checked end to end:
    parse, required fields, ranges, defaults."""
    ev = _events_with_k(spark, sf_dir)
    cfg = F.to_json(F.struct(
        F.col("event_type").alias("name"), F.col("user_id").alias("num_workers"),
        F.col("k").alias("mem_per_worker"), F.length("event_type").cast("bigint").alias("cores_per_worker"),
        (F.col("value") / 100.0).alias("dataset_scale"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("logs/"), F.col("event_type"))).alias("log_dir")))
    checked = V.validate_configs(ev.select("event_id", cfg.alias("config")), "config")
    return checked.select("event_id", "reason", F.col("cfg.remark").alias("remark"))


# Request documents per event: an array of two, a single object, a truncated array, an array with a wrong
# type and a scalar, an empty array. The same text in Spark SQL and DuckDB.
_REQUEST = """CASE event_id % 5
  WHEN 0 THEN '[{"name":"' || event_type || '","num_workers":' || CAST(user_id % 4 AS STRING) ||
    ',"mem_per_worker":1,"cores_per_worker":2,"dataset_scale":' || CAST(event_id % 3 AS STRING) ||
    ',"log_dir":"logs"}, {"name":"x","num_workers":1}]'
  WHEN 1 THEN '{"name":"x","num_workers":1}'
  WHEN 2 THEN '[{"name":"x"'
  WHEN 3 THEN '[{"name":"x","num_workers":"two"}, 7]'
  ELSE '[]' END"""


@register("validate_requests", f"""
WITH docs AS (SELECT event_id, {_REQUEST} AS request FROM events),
items AS (SELECT event_id, CAST(unnest(range(CAST(CASE WHEN json_valid(request) THEN json_array_length(request) END AS BIGINT))) AS INT) AS pos, request FROM docs
          WHERE json_valid(request) AND json_type(request) = 'ARRAY'),
entries AS (SELECT event_id, pos, json_extract(request, '$[' || pos || ']') AS e FROM items)
SELECT event_id, pos, CASE
  WHEN json_type(e) <> 'OBJECT' OR json_type(e, '$.num_workers') = 'VARCHAR' THEN 'wrong type'
  WHEN json_type(e, '$.mem_per_worker') IS NULL THEN 'missing field: mem_per_worker'
  WHEN CAST(json_extract(e, '$.num_workers') AS BIGINT) < 1 THEN 'out of range: num_workers>=1'
  WHEN CAST(json_extract(e, '$.dataset_scale') AS DOUBLE) > 1 THEN 'out of range: 0<=dataset_scale<=1' END AS reason
FROM entries
UNION ALL
SELECT event_id, NULL, CASE WHEN json_valid(request) THEN 'not an array' ELSE 'malformed JSON' END
FROM docs WHERE NOT json_valid(request) OR json_type(request) <> 'ARRAY'""")
def q_validate_requests(spark, sf_dir):
    """Arrays of run configurations, good and bad, checked entry by entry."""
    from tessera.sources.tables import load_table
    docs = load_table(spark, sf_dir, "events").select("event_id", F.expr(_REQUEST).alias("request"))
    return V.validate_requests(docs).select("event_id", "pos", "reason")


@register("measured_rows", X.with_views("SELECT CAST(count(*) AS BIGINT) AS num_rows, true AS timed FROM articles", "articles"))
def q_measured_rows(spark, sf_dir):
    """The part of a measured run that does not vary: rows counted during the run, and that it took time."""
    run = measure(extract_features(_articles(spark, sf_dir), keywords=X.PROBE_KEYWORDS))
    return run.select("num_rows", (F.col("E2E_time") > 0).alias("timed"))


@register("measured_run", None)
def q_measured_run(spark, sf_dir):
    """One measured run of the full feature pipeline (time varies: rows-only)."""
    return measure(extract_features(_articles(spark, sf_dir), keywords=X.PROBE_KEYWORDS))


@register("streaming_features", _PIPELINE_SQL)
def q_streaming_features(spark, sf_dir):
    """The feature pipeline as a Structured Streaming job (file source ->
    file sink with checkpoint, availableNow trigger), read back."""
    from tessera.streaming.features import start_feature_stream, stream_table

    stream = X.articles_from(stream_table(spark, sf_dir, "documents"), stream_table(spark, sf_dir, "pages"))
    sink, ckpt = shared_path(spark, "stream-sink"), shared_path(spark, "stream-ckpt")
    q = start_feature_stream(stream, sink, ckpt, keywords=X.PROBE_KEYWORDS)
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(sink)
