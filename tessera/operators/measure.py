"""Measure one pipeline run: rows, wall time and throughput.

The row count is collected with ``DataFrame.observe`` during the run itself
(an accumulator-style metric filled by the tasks), so no separate count pass
over the data is needed, and the run writes to a sink on the executors
instead of collecting rows on the driver.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, functions as F


def measure(df: DataFrame, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Run ``df`` into a sink (``noop`` when ``path`` is None) and return a
    one-row frame: num_rows, E2E_time (s), E2E_throughput (rows/s, 0 when the
    time is 0)."""
    obs = Observation("measure")
    observed = df.observe(obs, F.count(F.lit(1)).alias("num_rows"))
    start = time.perf_counter()
    writer = observed.write.mode("overwrite")
    if path is None:
        writer.format("noop").save()
    else:
        writer.format(fmt).save(path)
    elapsed = time.perf_counter() - start
    n = int(obs.get["num_rows"])
    spark = df.sparkSession
    return spark.createDataFrame(
        [(n, float(elapsed), float(n / elapsed) if elapsed > 0 else 0.0)],
        "num_rows bigint, E2E_time double, E2E_throughput double")
