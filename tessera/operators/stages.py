"""Stage-metric analytics: long table of (run, stage) rows -> per-run records.

Input columns (long, one row per stage of a run):
    run_id, job_id, stage_id[, tie], num_tasks, stage_duration_ms, records_read,
    executor_run_time, executor_cpu_time, jvm_gc_time, bytes_read

Plan shape: every operator here groups by the run key, so one hash
exchange on ``run_id`` serves the window (stage index) and the aggregate
that follows it; the aggregates are algebraic (count/sum/max/avg) and run
partial-then-final, so a run with many stages is combined map-side before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.metrics import ms_to_s, throughput

# --- fixed values -----------------------------------------------------------
# Wide run-record metric names, in per-stage column order.
STAGE_METRICS = ["time", "throughput", "executorRunTime", "executorCpuTime",
                 "jvmGCTime", "recordsRead", "bytesRead"]
# ---------------------------------------------------------------------------

DEFAULT_ORDER = ("job_id", "stage_id", "tie")


def run_totals(stages: DataFrame, run: str = "run_id", tasks: str = "num_tasks") -> DataFrame:
    """Per run: number of stages and total tasks (missing task counts -> 0)."""
    return stages.groupBy(run).agg(
        F.count(F.lit(1)).alias("num_stages"),
        F.sum(F.coalesce(F.col(tasks), F.lit(0)).cast("bigint")).alias("num_tasks"),
    )


def stage_index(stages: DataFrame, run: str = "run_id",
                order: Sequence[str] = DEFAULT_ORDER, name: str = "stage_idx",
                skew_safe: bool = False) -> DataFrame:
    """Zero-based stage position within its run, in (job, stage, tie) order.

    The order keys must make rows unique within a run for a deterministic index.

    ``skew_safe=False``: one window partitioned by run (one hash exchange);
    every run is ranked inside one task, which is right when runs are
    bounded (a run record holds at most ``max_stages`` stages).

    ``skew_safe=True``: no task ever holds a whole run. Rows are ranked within
    (run, first order key, second order key), so a hot run is split by its own
    data; the segments' offsets are running sums over one pre-aggregated row per
    segment: within (run, first key) over the second key, and within the run over
    the first key. Nothing depends on partition ids or sampling, so any columns
    may be kept and a recomputed task gives the same rows.
    """
    if not skew_safe:
        w = Window.partitionBy(run).orderBy(*[F.col(c) for c in order])
        return stages.withColumn(name, (F.row_number().over(w) - 1).cast("int"))
    lead = list(order[:2])
    earlier = (Window.unboundedPreceding, -1)
    segments = stages.groupBy(run, *lead).agg(F.count(F.lit(1)).alias("__n"))
    first = segments.groupBy(run, lead[0]).agg(F.sum("__n").alias("__m"))
    by_first = Window.partitionBy(run).orderBy(lead[0]).rowsBetween(*earlier)
    first = first.withColumn("__before", F.coalesce(F.sum("__m").over(by_first), F.lit(0))).drop("__m")
    offsets = _null_safe(segments, first, [run, lead[0]], ["__before"])
    by_second = Window.partitionBy(run, lead[0]).orderBy(*lead[1:] or lead).rowsBetween(*earlier)
    offsets = offsets.select(run, *lead, (F.col("__before") + F.coalesce(F.sum("__n").over(by_second), F.lit(0))).alias("__off"))
    local = Window.partitionBy(run, *lead).orderBy(*[F.col(c) for c in order])
    return (_null_safe(stages, offsets, [run, *lead], ["__off"])
            .withColumn(name, (F.col("__off") + F.row_number().over(local) - 1).cast("int"))
            .drop("__off"))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], take: Sequence[str]) -> DataFrame:
    """``left`` with the columns ``take`` of ``right``, joined on ``keys``; NULL keys meet."""
    named = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *take)
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return left.join(named, on).drop(*[f"__k{i}" for i in range(len(keys))])


def stage_metrics(stages: DataFrame) -> DataFrame:
    """Adds per-stage ``stage_time_s`` (ms -> s) and guarded ``stage_throughput``."""
    return (stages
            .withColumn("stage_time_s", ms_to_s("stage_duration_ms"))
            .withColumn("stage_throughput", throughput("records_read", "stage_time_s")))


def _metric_columns() -> dict[str, Column]:
    return {
        "time": F.col("stage_time_s"),
        "throughput": F.col("stage_throughput"),
        "executorRunTime": F.col("executor_run_time"),
        "executorCpuTime": F.col("executor_cpu_time"),
        "jvmGCTime": F.col("jvm_gc_time"),
        "recordsRead": F.col("records_read"),
        "bytesRead": F.col("bytes_read"),
    }


def max_stage_count(stages: DataFrame, run: str = "run_id") -> int:
    """Largest number of stages of any run (one small aggregate job)."""
    row = stages.groupBy(run).count().agg(F.max("count").alias("m")).first()
    return int(row["m"] or 0)


def pivot_stages(stages: DataFrame, max_stages: int | None = None, run: str = "run_id",
                 order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """Long -> wide run records: run, num_stages, num_tasks, then
    ``stage{i}_{metric}`` for the 7 metrics of every stage i < max_stages.
    Stages a run does not have are NULL.

    ``max_stages=None`` takes the width from the data (one extra small job).
    With an explicit width a run with more stages fails the query instead of
    silently losing columns.

    One aggregation gathers a run's stages into one array of structs, partly per task, and sorts it by the order keys,
    so its places are the stage indexes: no window, no aggregate per output column. Every output column then takes its
    field by place; stages with equal order keys follow their metrics. A run holds ``max_stages`` stages at most, which bounds the array.
    """
    if max_stages is None:
        max_stages = max_stage_count(stages, run)
    metrics = _metric_columns()
    stage = F.struct(*[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], *[metrics[m].alias(m) for m in STAGE_METRICS])
    wide = stage_metrics(stages).groupBy(run).agg(
        F.count(F.lit(1)).alias("num_stages"),
        F.sum(F.coalesce(F.col("num_tasks"), F.lit(0)).cast("bigint")).alias("num_tasks"),
        F.sort_array(F.collect_list(stage)).alias("__stages"),
    )
    slots = [F.get("__stages", i)[m].alias(f"stage{i}_{m}") for i in range(max_stages) for m in STAGE_METRICS]
    wide = wide.select(run, "num_stages", "num_tasks", *slots)
    guard = F.when(F.col("num_stages") > max_stages,
                   F.raise_error(F.lit(f"run has more than {max_stages} stages"))) \
        .otherwise(F.col("num_stages")).cast("bigint")
    return wide.withColumn("num_stages", guard)


def stage_totals(stages: DataFrame, run: str = "run_id") -> DataFrame:
    """Per-run totals straight from the long table (what the wide row sums give,
    without materialising the wide form): total_stage_time,
    average_stage_throughput, Total_Executor_Run_Time, Total_Executor_CPU_Time,
    Total_JVM_GC_Time. Sums skip NULLs (all-NULL -> 0), the mean skips NULLs
    (all-NULL -> NULL)."""
    s = stage_metrics(stages)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0)).cast("double")

    return s.groupBy(run).agg(
        total("stage_time_s").alias("total_stage_time"),
        F.avg("stage_throughput").alias("average_stage_throughput"),
        total("executor_run_time").alias("Total_Executor_Run_Time"),
        total("executor_cpu_time").alias("Total_Executor_CPU_Time"),
        total("jvm_gc_time").alias("Total_JVM_GC_Time"),
    )
