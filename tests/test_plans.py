"""Plan-shape assertions: the scale properties the README claims."""

from conftest import EVENT_LOG_DIR, SF001
from tessera.operators import scaling as SC
from tessera.operators import shaping as SH
from tessera.operators import stages as ST
from tessera.sources import fixtures as X


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()  # run it so AQE settles the final plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_aggregates_before_the_shuffle(spark):
    plan = executed(SC.scaling_summary(X.runs(spark, SF001), X.stage_runs(spark, SF001)))
    assert "partial_sum" in plan and "partial_avg" in plan
    # only the needed lineitem / orders columns are read
    assert "l_returnflag" not in plan and "o_orderdate" not in plan


def test_pivot_uses_one_exchange(spark):
    plan = executed(ST.pivot_stages(X.stage_runs(spark, SF001)))
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and plan.count("collect_list") <= 4


def test_take_fraction_result_is_a_filter_on_the_scan(spark):
    df = SH.take_fraction(X.articles(spark, SF001), 0.25, ["src", "id"])
    plan = executed(df)
    assert "Exchange" not in plan and "TakeOrderedAndProject" not in plan and "Window" not in plan


def test_replicate_scans_once(spark):
    plan = executed(SH.replicate(X.articles(spark, SF001), 3))
    assert plan.count("FileScan parquet") == 2  # documents + pages, once each


def test_speedup_has_no_window_over_the_group(spark):
    from tessera.functions.metrics import throughput, total_cores
    from pyspark.sql import functions as F

    r = X.runs(spark, SF001).select("run_id", "scaling_type", total_cores().alias("total_cores"),
                                    throughput("num_rows", "e2e_time").alias("E2E_throughput"))
    plan = executed(SC.speedup(r, ["scaling_type"], ["total_cores", "run_id"], "E2E_throughput"))
    assert "Window" not in plan and "partial_min_by" in plan


def test_totals_of_five_thousand_columns_compile(spark):
    from pyspark.sql import functions as F
    from tessera.operators.rowwise import WIDE_TOTALS, long_totals

    rows = [tuple([k] + [float((k * j) % 13) if (k + j) % 5 else None for j in range(5000)]) for k in range(4)]
    names = ["id", *(f"stage{j // 2}_{'time' if j % 2 == 0 else 'throughput'}" for j in range(5000))]
    spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'id' else 'double'}" for n in names)).write.parquet(path := f"{EVENT_LOG_DIR}/wide")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = {r.id: r for r in long_totals(spark.read.parquet(path), ["id"], WIDE_TOTALS).collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    for k, *v in rows:
        times, rates = [x for x in v[0::2] if x is not None], [x for x in v[1::2] if x is not None]
        assert got[k].total_stage_time == sum(times) and abs(got[k].average_stage_throughput - sum(rates) / len(rates)) < 1e-9
    none = spark.createDataFrame([(1, None)], "id long, stage0_throughput double")
    assert tuple(long_totals(none, ["id"], WIDE_TOTALS).first()) == (1, 0.0, None)
