"""Stage metrics from the session's own event log -> run records."""

from conftest import EVENT_LOG_DIR, SF001
from tessera.operators.stages import pivot_stages, run_totals
from tessera.plans.features import extract_features, write_features
from tessera.sources.eventlog import stage_metrics_from_event_log
from tessera.sources.fixtures import articles


def test_stage_metrics_of_a_labelled_run(spark):
    sc = spark.sparkContext
    sc.setJobGroup("features-run", "feature pipeline into noop")
    try:
        write_features(extract_features(articles(spark, SF001)))
    finally:
        sc.setJobGroup("other", "")
    sm = stage_metrics_from_event_log(spark, EVENT_LOG_DIR).filter("job_group = 'features-run'")
    rows = sm.collect()
    assert rows, "no completed stage recorded for the labelled run"
    assert sum(r["records_read"] for r in rows) == articles(spark, SF001).count()
    assert all(r["num_tasks"] >= 1 and r["stage_duration_ms"] >= 0 for r in rows)
    assert all(not r["run_id"].endswith(".inprogress") for r in rows)
    # the long table feeds the run analytics unchanged
    run = sm.withColumn("run_id", sm["job_group"])
    wide = pivot_stages(run).first()
    assert wide["num_stages"] == len(rows)
    assert wide["stage0_recordsRead"] is not None
    assert run_totals(run).first()["num_tasks"] == sum(r["num_tasks"] for r in rows)
