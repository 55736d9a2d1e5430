"""Row-wise folds over wildcard-selected columns of wide (ragged) run records.

``row_sum``, ``row_mean`` and ``with_wide_totals`` are pure projections: no shuffle, one codegen'd expression per output
column. For records of thousands of columns, where such an expression grows beyond what the JVM compiles, ``long_totals``
unpivots the records and adds up by (row, metric).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def matching_columns(df: DataFrame, prefix: str, suffix: str) -> list[str]:
    """Columns named ``prefix*suffix`` in frame order."""
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def row_sum_of(cols: list[str]) -> Column:
    """Sum of the columns, NULLs skipped; all-NULL (or none) -> 0."""
    if not cols:
        return F.lit(0.0)
    total = F.coalesce(F.col(cols[0]).cast("double"), F.lit(0.0))
    for c in cols[1:]:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return total


def row_mean_of(cols: list[str]) -> Column:
    """Mean of the non-NULL columns; all-NULL (or none) -> NULL."""
    if not cols:
        return F.lit(None).cast("double")
    present = F.lit(0)
    for c in cols:
        present = present + F.col(c).isNotNull().cast("int")
    return F.try_divide(row_sum_of(cols), present)


def row_sum(df: DataFrame, prefix: str, suffix: str) -> Column:
    return row_sum_of(matching_columns(df, prefix, suffix))


def row_mean(df: DataFrame, prefix: str, suffix: str) -> Column:
    return row_mean_of(matching_columns(df, prefix, suffix))


def long_totals(df: DataFrame, key: Sequence[str], totals: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """(key, one column per total) over records of any width; ``totals`` maps a name to (kind, prefix, suffix), kind "sum" or
    "mean", with the NULL rules of ``row_sum`` and ``row_mean``.

    ``key`` names columns that are unique and not NULL. Every record is unpivoted to (row, metric, value) without its NULLs,
    added up per task, and once more after a shuffle of one row per record and metric. No expression folds over the columns.
    """
    columns = {name: matching_columns(df, prefix, suffix) for name, (_, prefix, suffix) in totals.items()}
    metrics = [name for name in totals for _ in columns[name]]
    values = F.array(*[F.col(c).cast("double") for name in totals for c in columns[name]]).cast("array<double>")
    number = {name: k for k, name in enumerate(totals)}
    numbers = F.array(*[F.lit(number[m]) for m in metrics]).cast("array<int>")
    cells = (df.select(*key, F.posexplode(values).alias("__at", "__value")).where("__value is not null")
             .select(*key, F.get(numbers, F.col("__at")).alias("__metric"), "__value"))
    sums = cells.groupBy(*key, "__metric").agg(F.sum("__value").alias("__sum"), F.count("*").alias("__n"))
    pick = lambda c, name: F.max(F.when(F.col("__metric") == number[name], F.col(c)))
    out = {name: F.coalesce(pick("__sum", name), F.lit(0.0)) if kind == "sum" else pick("__sum", name) / pick("__n", name) for name, (kind, _, _) in totals.items()}
    found = sums.groupBy(*key).agg(*[c.alias(name) for name, c in out.items()])
    empty = {name: F.coalesce(name, F.lit(0.0)) if totals[name][0] == "sum" else F.col(name) for name in totals}
    return df.select(*key).join(found, list(key), "left").select(*key, *[c.alias(name) for name, c in empty.items()])


WIDE_TOTALS = {"total_stage_time": ("sum", "stage", "_time"), "average_stage_throughput": ("mean", "stage", "_throughput")}


def with_wide_totals(df: DataFrame, prefix: str = "stage") -> DataFrame:
    """Adds total_stage_time, average_stage_throughput, Total_Executor_Run_Time,
    Total_Executor_CPU_Time and Total_JVM_GC_Time from ``stage*_...`` columns."""
    return df.withColumns({
        "total_stage_time": row_sum(df, prefix, "_time"),
        "average_stage_throughput": row_mean(df, prefix, "_throughput"),
        "Total_Executor_Run_Time": row_sum(df, prefix, "_executorRunTime"),
        "Total_Executor_CPU_Time": row_sum(df, prefix, "_executorCpuTime"),
        "Total_JVM_GC_Time": row_sum(df, prefix, "_jvmGCTime"),
    })
