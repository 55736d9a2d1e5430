"""Stage / run analytics on hand-made rows and on two real run records."""

import math

from pyspark.sql import functions as F

from tessera.functions.metrics import axis_label, config_label, efficiency_pct, throughput
from tessera.operators import scaling as SC
from tessera.operators import stages as ST
from tessera.operators.rowwise import row_mean, row_sum, with_wide_totals
from tessera.sources import csv as CSV

LONG = "run_id bigint, job_id int, stage_id bigint, tie bigint, num_tasks int, stage_duration_ms double, " \
       "records_read bigint, executor_run_time double, executor_cpu_time double, jvm_gc_time double, bytes_read bigint"


def long_rows(spark):
    rows = [
        (1, 0, 1, 0, 4, 2000.0, 100, 10.0, 5.0, 1.0, 1024),
        (1, 0, 0, 0, None, 0.0, 50, 20.0, 10.0, 2.0, 2048),   # first in order, zero time, missing tasks
        (1, 1, 0, 0, 8, 1000.0, 30, 30.0, 15.0, 3.0, 4096),
        (2, 0, 0, 0, 2, 500.0, 10, 1.0, 1.0, 0.0, 1),
    ]
    return spark.createDataFrame(rows, LONG)


def test_throughput_guard(spark):
    df = spark.createDataFrame([(5, 0.0), (5, 2.0), (5, None)], "n bigint, t double")
    assert [r[0] for r in df.select(throughput("n", "t")).collect()] == [0.0, 2.5, 0.0]


def test_run_totals_and_index(spark):
    s = long_rows(spark)
    tot = {r["run_id"]: (r["num_stages"], r["num_tasks"]) for r in ST.run_totals(s).collect()}
    assert tot == {1: (3, 12), 2: (1, 2)}
    idx = {(r["run_id"], r["job_id"], r["stage_id"]): r["stage_idx"] for r in ST.stage_index(s).collect()}
    assert idx == {(1, 0, 0): 0, (1, 0, 1): 1, (1, 1, 0): 2, (2, 0, 0): 0}


def test_pivot_stages(spark):
    wide = {r["run_id"]: r for r in ST.pivot_stages(long_rows(spark)).collect()}
    r1, r2 = wide[1], wide[2]
    assert r1["num_stages"] == 3 and r1["num_tasks"] == 12
    assert r1["stage0_time"] == 0.0 and r1["stage0_throughput"] == 0.0  # zero time -> 0 throughput
    assert r1["stage1_time"] == 2.0 and r1["stage1_throughput"] == 50.0
    assert r1["stage2_recordsRead"] == 30 and r1["stage2_bytesRead"] == 4096
    assert r2["stage1_time"] is None and r2["stage2_executorRunTime"] is None


def test_pivot_width_guard(spark):
    import pytest
    from pyspark.errors import PySparkException

    with pytest.raises(Exception) as e:
        ST.pivot_stages(long_rows(spark), max_stages=2).collect()
    assert "more than 2 stages" in str(e.value)
    assert isinstance(e.value, (PySparkException, Exception))


def test_row_sum_mean_all_null(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.0, 3.0)], "stage0_x double, stage1_x double")
    got = df.select(row_sum(df, "stage", "_x").alias("s"), row_mean(df, "stage", "_x").alias("m")).collect()
    assert [(r["s"], r["m"]) for r in got] == [(0.0, None), (1.0, 1.0), (4.0, 2.0)]


def test_wide_totals_equal_long_totals(spark):
    s = long_rows(spark)
    wide = {r["run_id"]: r for r in with_wide_totals(ST.pivot_stages(s)).collect()}
    tot = {r["run_id"]: r for r in ST.stage_totals(s).collect()}
    for k in wide:
        for c in ["total_stage_time", "average_stage_throughput", "Total_Executor_Run_Time",
                  "Total_Executor_CPU_Time", "Total_JVM_GC_Time"]:
            assert math.isclose(wide[k][c], tot[k][c], rel_tol=1e-12)


def test_labels(spark):
    df = spark.createDataFrame([(16, 4, 0.0625), (1, 128, 1.0)], "num_workers int, cores_per_worker int, dataset_scale double")
    got = df.select(config_label().alias("c"), axis_label("scale").alias("s"), axis_label("workers").alias("w")).collect()
    assert [tuple(r) for r in got] == [("16W-4C", "64\n(scale=0.0625)", "16W\n4C"), ("1W-128C", "128\n(scale=1.0)", "1W\n128C")]


def test_speedup_baseline_is_smallest_config(spark):
    rows = [(1, "g", 8, 20.0), (2, "g", 4, 10.0), (3, "g", 4, 30.0), (4, "h", 2, 0.0), (5, "h", 4, 5.0)]
    df = spark.createDataFrame(rows, "run_id bigint, scaling_type string, total_cores int, thr double")
    got = {r["run_id"]: r["speedup"] for r in SC.speedup(df, ["scaling_type"], ["total_cores", "run_id"], "thr").collect()}
    assert got == {1: 2.0, 2: 1.0, 3: 3.0, 4: None, 5: None}


def test_efficiency(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(efficiency_pct("a", "b")).collect()] == [25.0, None]


# Two published run records and the processed rows the original
# analysis produced from them (values copied by hand).
RUN_FILE_1 = (
    "num_workers,mem_per_worker,cores_per_worker,dataset_scale,num_rows,num_stages,num_tasks,remark,"
    "stage0_time,stage0_throughput,stage0_executorRunTime,stage0_executorCpuTime,stage0_jvmGCTime,"
    "stage0_recordsRead,stage0_bytesRead,E2E_time,E2E_throughput\n"
    '1,384,4,0.0625,49563,1,1,"Weak scaling - 1 worker, 4 cores, 6.25% dataset",28.88,1716.1703601108034,'
    "28164,18316,183,49563,54067200,36.16358041763306,1370.522482221741\n")
RUN_FILE_2 = (
    "num_workers,mem_per_worker,cores_per_worker,dataset_scale,num_rows,num_stages,num_tasks,remark,"
    "stage0_time,stage0_throughput,stage0_executorRunTime,stage0_executorCpuTime,stage0_jvmGCTime,"
    "stage0_recordsRead,stage0_bytesRead,stage1_time,stage1_throughput,stage1_executorRunTime,"
    "stage1_executorCpuTime,stage1_jvmGCTime,stage1_recordsRead,stage1_bytesRead,E2E_time,E2E_throughput\n"
    '2,192,4,0.125,99126,2,5,"Weak scaling - 2 workers, 4 cores each, 12.5% dataset",19.472,1246.5591618734593,'
    "18912,12037,132,24273,33423360,18.71,8881.72100481026,67833,38970,734,166177,133693440,"
    "49.985501527786255,1983.0950369658133\n")
GOLDEN = {
    1: [0.0625, 36.16358041763306, 1370.522482221741, 28.88, 1716.1703601108034, 28164.0, 18316.0, 183.0, 4,
        65.03337594091748],
    2: [0.125, 49.985501527786255, 1983.0950369658133, 38.182, 5064.14008334186, 86745.0, 51007.0, 866.0, 8,
        58.80108363594444],
}


def test_golden_summary_from_ragged_run_files(spark, tmp_dir):
    import os

    os.makedirs(f"{tmp_dir}/logs")
    for name, body in [("WS-run-a.csv", RUN_FILE_1), ("WS-run-b.csv", RUN_FILE_2)]:
        with open(f"{tmp_dir}/logs/{name}", "w") as f:
            f.write(body)
    records = CSV.read_runs(spark, f"{tmp_dir}/logs/*.csv")
    assert len(records.columns) >= 24
    summary = SC.summarize_records(records)
    rows = {r["num_workers"]: r for r in summary.collect()}
    cols = ["dataset_scale", "E2E_time", "E2E_throughput", "total_stage_time", "average_stage_throughput",
            "Total_Executor_Run_Time", "Total_Executor_CPU_Time", "Total_JVM_GC_Time", "total_cores", "CPU_Efficiency"]
    for w, expected in GOLDEN.items():
        assert rows[w]["scaling_type"] == "Weak_Scaling"
        assert rows[w]["remark"] if "remark" in rows[w] else True
        for c, e in zip(cols, expected):
            assert math.isclose(rows[w][c], e, rel_tol=1e-12), (w, c, rows[w][c], e)
    assert rows[1]["stage1_time"] if "stage1_time" in summary.columns else True


def test_skew_safe_stage_index_equals_window(spark):
    from tessera.sources.fixtures import stage_runs
    from conftest import SF01

    s = stage_runs(spark, SF01)
    # one hot run holding a third of all rows
    hot = s.withColumn("run_id", F.when(F.col("run_id") % 3 == 0, F.lit(-1)).otherwise(F.col("run_id")))
    order = (*ST.DEFAULT_ORDER, "num_tasks", "records_read", "executor_run_time")
    kept = ["run_id", *order, "stage_idx"]
    a = ST.stage_index(hot, order=order).select(*kept)
    b = ST.stage_index(hot, order=order, skew_safe=True).select(*kept)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0
    assert set(a.columns) >= {"num_tasks", "records_read", "executor_run_time"}  # payload is kept


def test_runs_with_any_first_field_and_round_trip(spark, tmp_dir):
    import os
    from tessera.sources import csv as CSV

    for name, text in (("SS-1.csv", "num_workers,a\n1,2\n"), ("WS-1.csv", "mem_per_worker,b\n3,4\n"),
                       ("W-1.csv", '"num_workers","c"\n5,6\n'), ("SS-2.csv", "num_workers,a\nnum_workers,9\n")):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(text)
    assert CSV.read_runs(spark, f"{tmp_dir}/*.csv").count() == 4
    wide = ST.pivot_stages(long_rows(spark))
    CSV.write_runs(wide, f"{tmp_dir}/out")
    back = CSV.read_runs(spark, f"{tmp_dir}/out/*.csv")
    assert back.count() == wide.count() and set(wide.columns) <= set(back.columns)


def test_take_fraction_is_exact_with_ties(spark):
    from tessera.operators.shaping import take_fraction

    df = spark.range(1000).selectExpr("id % 10 AS k", "id")
    assert take_fraction(df, 0.25, ["k"]).count() == 250


def test_speedup_broadcast_and_salted_agree(spark):
    rows = [(g, k, float(k + 1)) for g in ("a", "b", "c") for k in range(20)] + [("z", 0, 0.0), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    one, many = (SC.speedup(df, ["g"], ["k"], "v", broadcast_groups=n) for n in (10, 1))
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)
    assert {(r["g"], r["k"]): r["speedup"] for r in one.collect()}["b", 4] == 5.0
