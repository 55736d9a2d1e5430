"""Benchmark the headline queries; prints ONE JSON line on stdout.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Headline = the article feature pipeline over the articles table replicated
3x (the reference's workload shape: original + two copies), into the
``noop`` sink and into parquet, plus the run analytics. Every query runs
on executors into a sink; nothing is collected on the driver. A query's time is the median of
BENCH_RUNS runs (3) after one warm-up on the smallest tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tessera.operators import scaling as SC  # noqa: E402
from tessera.operators import shaping as SH  # noqa: E402
from tessera.operators import stages as ST  # noqa: E402
from tessera.plans.catalog import QUERIES  # noqa: E402
from tessera.plans.features import extract_features, write_features  # noqa: E402
from tessera.session import build_session  # noqa: E402
from tessera.sources import csv as CSV  # noqa: E402
from tessera.sources import fixtures as X  # noqa: E402
from tessera.sources.eventlog import event_log_conf, stage_metrics_from_event_log  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    out_root = tempfile.mkdtemp(prefix="tessera-bench-")
    event_dir = os.path.join(out_root, "eventlog")
    os.makedirs(event_dir)
    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"), **event_log_conf(event_dir)}
    spark = build_session(f"local[{cpus}]", "tessera-bench", shuffle_partitions=max(2, cpus * 2), extra=extra)
    sc = spark.sparkContext

    def timed(name: str, fn) -> float:
        sc.setJobGroup(name, name)
        t = time.perf_counter()
        fn()
        elapsed = time.perf_counter() - t
        sc.setJobGroup("bench-bookkeeping", "")
        return elapsed

    def plans(d: str) -> dict:
        """The headline queries over the tables in ``d`` (each returns a sink action)."""
        arts = X.articles(spark, d)
        # The test tables are single-row-group files: spread the rows over the
        # task slots before the CPU-heavy projection (a no-op for big inputs).
        feats = extract_features(SH.replicate(SH.spread(arts, ["src", "id"], 2 * spark.sparkContext.defaultParallelism), 3))
        runs, stages = X.runs(spark, d), X.stage_runs(spark, d)
        return {
            "features_noop": lambda: write_features(feats),
            "features_parquet": lambda: write_features(feats, tempfile.mkdtemp(prefix="f-", dir=out_root)),
            "pivot_stages": lambda: write_features(ST.pivot_stages(stages)),
            "scaling_summary": lambda: write_features(
                SC.sorted_report(SC.scaling_summary(runs, stages), ["scaling_type", "total_cores"], ["run_id"])),
            "speedup_vs_baseline": lambda: write_features(QUERIES["speedup_vs_baseline"].build(spark, d)),
            "stage_index_skew_safe": lambda: write_features(QUERIES["stage_index"].build(spark, d)),
            "take_fraction": lambda: write_features(SH.take_fraction(arts, 0.5, ["src", "id"])),
            "validate_configs": lambda: write_features(QUERIES["validate_configs"].build(spark, d)),
            "classify_runs": lambda: write_features(QUERIES["classify_runs"].build(spark, d)),
        }

    # Warm-up: every query once on the smallest tables (JIT, codegen caches), not timed.
    sc.setJobGroup("bench-warmup", "")
    for fn in plans("/root/testdata/sf0.001").values():
        fn()

    replicated = SH.replicate(X.articles(spark, sf_dir), 3)
    n_rows = replicated.count()
    n_chars = replicated.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0

    n_runs = int(os.environ.get("BENCH_RUNS", "3"))
    q: dict[str, float] = {}
    for name, fn in plans(sf_dir).items():
        q[name] = statistics.median([timed(name if k == 0 else f"{name}-again", fn) for k in range(n_runs)])

    total = sum(q.values())

    # Per-query stage metrics from the event log -> run records (one per query),
    # written like the original per-run CSV files (not part of the timing).
    stages = stage_metrics_from_event_log(spark, event_dir).filter(F.col("job_group").isin(list(q)))
    per_query = {r["run_id"]: (r["num_stages"], r["num_tasks"]) for r in
                 ST.run_totals(stages.withColumn("run_id", F.col("job_group"))).collect()}
    records = ST.pivot_stages(stages.withColumn("run_id", F.col("job_group")))
    CSV.write_runs(records, os.path.join(out_root, "run_records"))
    print(json.dumps({
        "metric": "total_query_sec",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in q.items()},
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": n_runs,
        "feature_rows": n_rows,
        "feature_rows_per_sec_noop": round(n_rows / q["features_noop"], 1),
        "feature_rows_per_sec_parquet": round(n_rows / q["features_parquet"], 1),
        "feature_rows_per_sec_per_core_noop": round(n_rows / q["features_noop"] / cpus, 1),
        "feature_text_chars_per_sec_noop": round(n_chars / q["features_noop"], 1),
        "stages_tasks": {k: list(v) for k, v in sorted(per_query.items())},
    }))


if __name__ == "__main__":
    main()
