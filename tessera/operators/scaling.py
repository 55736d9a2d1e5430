"""Scaling analysis over run records: labels, baselines, efficiency, reports.

Runs are tagged Strong_Scaling / Weak_Scaling / Worker_Sweep. Groups are few
and each may hold a third of all runs, so nothing here partitions a window
by the scaling group: the baseline of a group is found with a partial
aggregate (``min_by``) whose one-row-per-group result is joined back, broadcast
behind a check of its row count, else over salted keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.metrics import axis_label, config_label, efficiency_pct, throughput, total_cores
from tessera.operators.rowwise import with_wide_totals
from tessera.operators.stages import stage_totals

# --- fixed values -----------------------------------------------------------
STRONG, WEAK, SWEEP = "Strong_Scaling", "Weak_Scaling", "Worker_Sweep"
# File-name prefixes of the three run groups.
NAME_PREFIXES = [("SS", STRONG), ("WS", WEAK), ("W-", SWEEP)]
# Columns of the processed scaling summary, in export order.
SUMMARY_BASE = ["scaling_type", "num_workers", "cores_per_worker", "dataset_scale"]
SUMMARY_DERIVED = ["total_stage_time", "average_stage_throughput", "Total_Executor_Run_Time",
                   "Total_Executor_CPU_Time", "Total_JVM_GC_Time"]
# ---------------------------------------------------------------------------


def scaling_type_from_name(name: Column | str) -> Column:
    """Scaling group from a base name: 'SS*' strong, 'WS*' weak, 'W-*' sweep, else NULL."""
    name = F.col(name) if isinstance(name, str) else name
    expr = None
    for prefix, label in NAME_PREFIXES:
        cond = name.startswith(prefix)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def tag_and_union(groups: Mapping[str, DataFrame], tag: str = "scaling_type") -> DataFrame:
    """Tag each frame with its group name and union them by column name
    (missing columns NULL). Empty frames simply contribute no rows."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in groups.items()]
    if not frames:
        raise ValueError("tag_and_union needs at least one frame")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_labels(df: DataFrame) -> DataFrame:
    """config_name, total_cores and the chart label (x_label) of every run."""
    sweep = F.col("scaling_type") == F.lit(SWEEP)
    return df.withColumns({
        "config_name": config_label(),
        "total_cores": total_cores(),
        "x_label": F.when(sweep, axis_label("workers")).otherwise(axis_label("scale")),
    })


# Baselines of at most this many groups (one key and one number each) are broadcast.
BROADCAST_GROUPS = 10_000
SALTS = 64


def speedup(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str,
            out: str = "speedup", broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """value / value of the first row of its group in ``order`` (the smallest
    configuration present). NULL when the baseline is 0 or NULL.

    ``order`` must end in a unique key so the baseline is deterministic. The
    groups are counted first (a scan of the group columns; one partial row per group
    and task reaches the shuffle). Up to ``broadcast_groups`` baselines are broadcast, so
    the rows are not shuffled by a key that may have three values; more are
    replicated over salts and joined with rows salted by a hash, so a hot group is split.
    """
    if not group:
        raise ValueError("speedup needs at least one group column")
    key = F.struct(*[F.col(c) for c in order])
    base = df.groupBy(*group).agg(F.min_by(F.col(value), key).alias("_baseline"))
    if df.select(*group).distinct().limit(broadcast_groups + 1).count() <= broadcast_groups:
        joined = df.join(F.broadcast(base), list(group), "left")
    else:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
        copies = base.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, [*group, "_salt"], "left").drop("_salt")
    return (joined.withColumn(out, F.try_divide(F.col(value).cast("double"), F.col("_baseline")))
                  .drop("_baseline"))


def select_by_name(df: DataFrame, fixed: Iterable[str], prefixes: Iterable[str] = (),
                   derived: Iterable[str] = ()) -> DataFrame:
    """fixed columns, then every column starting with one of ``prefixes``
    (frame order), then ``derived``."""
    fixed, derived = list(fixed), list(derived)
    pref = [c for c in df.columns if any(c.startswith(p) for p in prefixes)
            and c not in fixed and c not in derived]
    return df.select(*fixed, *pref, *derived)


def sorted_report(df: DataFrame, by: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Global sort (range-partitioned, distributed) with tie keys appended."""
    return df.orderBy(*[F.col(c) for c in list(by) + list(tie)])


def top_n(df: DataFrame, by: Sequence[str], n: int = 10) -> DataFrame:
    """First n rows in ``by`` order (TakeOrderedAndProject: per-partition
    top-n, then a merge of n rows per partition)."""
    return df.orderBy(*[F.col(c) for c in by]).limit(n)


def _with_efficiency(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "total_cores": total_cores(),
        "CPU_Efficiency": efficiency_pct("Total_Executor_CPU_Time", "Total_Executor_Run_Time"),
    })


def scaling_summary(runs: DataFrame, stages: DataFrame, key: str = "run_id") -> DataFrame:
    """Processed summary, one row per run, from the run header table and the
    long stage table (per-run totals by one partial+final aggregate, joined on
    the run key). Runs without stages get 0 sums and a NULL mean.

    Columns: key, scaling_type, num_workers, cores_per_worker, dataset_scale,
    E2E_time, E2E_throughput, the five stage totals, total_cores, CPU_Efficiency.
    """
    header = runs.select(
        key, *SUMMARY_BASE,
        F.col("e2e_time").cast("double").alias("E2E_time"),
        throughput("num_rows", "e2e_time").alias("E2E_throughput"),
    )
    totals = stage_totals(stages, key)
    joined = header.join(totals, key, "left").fillna(
        0.0, subset=[c for c in SUMMARY_DERIVED if c != "average_stage_throughput"])
    return _with_efficiency(joined).select(
        key, *SUMMARY_BASE, "E2E_time", "E2E_throughput", *SUMMARY_DERIVED, "total_cores", "CPU_Efficiency")


def summarize_records(records: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """The same summary from wide (ragged) run records as written per run:
    row-wise totals over ``stage*`` columns, E2E_* columns by prefix."""
    totals = with_wide_totals(records)
    picked = select_by_name(totals, list(keep) + SUMMARY_BASE, ["E2E_"], SUMMARY_DERIVED)
    return _with_efficiency(picked)


def compare_scaling(summary: DataFrame) -> DataFrame:
    """Average stage throughput per configuration, strong vs weak scaling."""
    s = with_labels(summary).filter(F.col("scaling_type").isin(STRONG, WEAK))
    return s.select("run_id", "scaling_type", "config_name", "total_cores", "dataset_scale",
                    "x_label", "average_stage_throughput")


def worker_sweep(summary: DataFrame) -> DataFrame:
    """Worker sweep: E2E time and throughput per workers x cores split."""
    s = with_labels(summary).filter(F.col("scaling_type") == SWEEP)
    return s.select("run_id", "config_name", "x_label", "num_workers", "cores_per_worker",
                    "total_cores", "E2E_time", "E2E_throughput")


def gc_by_config(summary: DataFrame) -> DataFrame:
    """Total JVM GC time per worker-sweep configuration."""
    s = with_labels(summary).filter(F.col("scaling_type") == SWEEP)
    return s.select("run_id", "config_name", "num_workers", "cores_per_worker", "total_cores",
                    "E2E_time", "Total_JVM_GC_Time").orderBy("num_workers", "run_id")


def executor_times(summary: DataFrame) -> DataFrame:
    """Executor run vs CPU time and CPU efficiency per core count (strong scaling)."""
    s = summary.filter(F.col("scaling_type") == STRONG)
    return s.select("run_id", "total_cores", "Total_Executor_Run_Time", "Total_Executor_CPU_Time",
                    "CPU_Efficiency").orderBy("total_cores", "run_id")
