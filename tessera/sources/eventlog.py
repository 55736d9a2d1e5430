"""Stage metrics of finished runs, read from Spark's own event logs.

A session started with ``spark.eventLog.enabled=true``,
``spark.eventLog.dir=<folder>`` and plain files
(``spark.eventLog.compress=false``, ``spark.eventLog.rolling.enabled=false``;
see ``event_log_conf``) writes one JSON-lines file per application.
This reader turns those files into the long stage table the run analytics
consume (one row per completed stage):

    run_id (the application / log file name), job_group (set with
    ``SparkContext.setJobGroup``), job_id, stage_id, tie, attempt, num_tasks,
    stage_duration_ms, records_read, executor_run_time (ms),
    executor_cpu_time (ms), jvm_gc_time (ms), bytes_read

It is a distributed scan: lines are filtered by event type first, then
parsed with an explicit schema (no schema inference over the logs).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# --- fixed values -----------------------------------------------------------
STAGE_DONE = "SparkListenerStageCompleted"
JOB_START = "SparkListenerJobStart"
# Task-metric accumulators summed per stage -> output column.
STAGE_ACCUMULATORS = {
    "internal.metrics.executorRunTime": "executor_run_time",
    "internal.metrics.executorCpuTime": "executor_cpu_time",
    "internal.metrics.jvmGCTime": "jvm_gc_time",
    "internal.metrics.input.recordsRead": "records_read",
    "internal.metrics.input.bytesRead": "bytes_read",
}
# ---------------------------------------------------------------------------


def event_log_conf(folder: str) -> dict[str, str]:
    """Session settings that write plain JSON-lines event logs into ``folder``."""
    return {"spark.eventLog.enabled": "true", "spark.eventLog.dir": folder,
            "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}


_STAGE_SCHEMA = (
    "`Event` string, `Stage Info` struct<`Stage ID`: int, `Stage Attempt ID`: int, "
    "`Number of Tasks`: int, `Submission Time`: bigint, `Completion Time`: bigint, "
    "`Accumulables`: array<struct<`Name`: string, `Value`: string>>>"
)
_JOB_SCHEMA = "`Event` string, `Job ID` int, `Stage IDs` array<int>, `Properties` map<string, string>"


def _events(spark: SparkSession, paths: str | Sequence[str], event: str) -> DataFrame:
    path_list = [paths] if isinstance(paths, str) else list(paths)
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    app = F.when(name.endswith(".inprogress"), F.expr("substring(n, 1, length(n) - 11)")).otherwise(name)
    lines = (spark.read.option("recursiveFileLookup", True).text(path_list)
             .withColumn("n", name).select("value", app.alias("run_id")))
    return lines.filter(F.col("value").contains(f'"Event":"{event}"'))


def _accumulator(arr: str, name: str):
    """Value of the first accumulator called ``name`` (NULL when absent)."""
    return F.get(F.filter(arr, lambda a: a["Name"] == F.lit(name)), 0)["Value"]


def stage_metrics_from_event_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Long stage table of every completed stage in the given event logs."""
    stages = (_events(spark, paths, STAGE_DONE)
              .select("run_id", F.from_json("value", _STAGE_SCHEMA)["Stage Info"].alias("s")))
    acc = stages.select(
        "run_id",
        F.col("s.`Stage ID`").alias("stage_id"),
        F.col("s.`Stage Attempt ID`").alias("attempt"),
        F.col("s.`Number of Tasks`").alias("num_tasks"),
        (F.col("s.`Completion Time`") - F.col("s.`Submission Time`")).cast("double").alias("stage_duration_ms"),
        *[_accumulator("s.Accumulables", name).alias(out) for name, out in STAGE_ACCUMULATORS.items()],
    )
    metrics = acc.select(
        "run_id", "stage_id", "attempt", "num_tasks", "stage_duration_ms",
        F.coalesce(F.col("records_read").cast("bigint"), F.lit(0)).alias("records_read"),
        F.coalesce(F.col("executor_run_time").cast("double"), F.lit(0.0)).alias("executor_run_time"),
        # CPU time is recorded in nanoseconds; report milliseconds like the other times.
        F.coalesce(F.col("executor_cpu_time").cast("double") / 1.0e6, F.lit(0.0)).alias("executor_cpu_time"),
        F.coalesce(F.col("jvm_gc_time").cast("double"), F.lit(0.0)).alias("jvm_gc_time"),
        F.coalesce(F.col("bytes_read").cast("bigint"), F.lit(0)).alias("bytes_read"),
    )
    jobs = (_events(spark, paths, JOB_START)
            .select("run_id", F.from_json("value", _JOB_SCHEMA).alias("j"))
            .select("run_id", F.col("j.`Job ID`").alias("job_id"),
                    F.col("j.Properties").getItem("spark.jobGroup.id").alias("job_group"),
                    F.explode("j.`Stage IDs`").alias("stage_id"))
            .groupBy("run_id", "stage_id")
            .agg(F.min("job_id").alias("job_id"), F.min("job_group").alias("job_group")))
    return (metrics.join(jobs, ["run_id", "stage_id"], "left")
                   .withColumn("tie", F.col("attempt").cast("bigint"))
                   .select("run_id", "job_group", "job_id", "stage_id", "tie", "attempt", "num_tasks",
                           "stage_duration_ms",
                           "records_read", "executor_run_time", "executor_cpu_time", "jvm_gc_time",
                           "bytes_read"))
