"""Shaping operators: ragged union, replicate, count, exact scale-down."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import shaping as SH


def test_union_ragged(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    c = spark.createDataFrame([(2, 3.5)], "a int, c double")
    out = SH.union_ragged([a, c])
    assert out.columns == ["a", "b", "c"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "x", None), (2, None, 3.5)]
    assert SH.union_ragged([], spark).count() == 0


def test_replicate_and_count(spark):
    df = spark.range(10)
    assert SH.count_rows(SH.replicate(df, 3)).first()["num_rows"] == 30
    assert sorted(r["id"] for r in SH.replicate(df, 2, "copy").filter("copy = 2").collect()) == list(range(10))
    plan = SH.replicate(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range") == 1  # one scan, not one per copy


def test_take_fraction_exact(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("v"))
    for scale, n in [(0.0625, 62), (0.0, 0), (1.0, 1000), (0.5, 500), (0.999, 999)]:
        got = sorted(r["k"] for r in SH.take_fraction(df, scale, ["k"]).collect())
        assert got == list(range(n)), scale


def test_take_fraction_composite_key(spark):
    rows = [(s, i) for s in ("b", "a") for i in range(50)]
    df = spark.createDataFrame(rows, "s string, i bigint")
    got = [(r["s"], r["i"]) for r in SH.take_fraction(df, 0.3, ["s", "i"]).orderBy("s", "i").collect()]
    assert got == sorted(rows)[:30]


def test_take_fraction_plan_has_no_single_partition(spark):
    df = spark.range(100)
    out = SH.take_fraction(df, 0.5, ["id"])
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_spread_only_when_few_partitions(spark):
    small = spark.range(0, 100, 1, 1)
    assert SH.spread(small, ["id"], partitions=4).rdd.getNumPartitions() == 4
    many = spark.range(0, 100, 1, 8)
    assert SH.spread(many, ["id"]) is many


def first_rows(rows, n):
    """The first n rows in Spark's order: NULL first, strings by their UTF-8 bytes."""
    part = lambda x: (x is not None, x.encode() if isinstance(x, str) else x if x is not None else 0)
    return sorted(map(lambda r: tuple(map(part, r)), rows))[:n]


@pytest.mark.parametrize("seed", range(4))
def test_take_fraction_by_sketch_and_sub_ranges(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "é", "b", None, "hot", "hot"]), rng.choice([None, 7, rng.randrange(50), rng.randrange(10**9)])) for _ in range(6000)]
    rows += [("hot", 7)] * 2500
    df = spark.createDataFrame(rows, "s string, i bigint").repartition(5)
    for scale in (0.0005, 0.31, 0.5, 0.77, 0.9996):
        got = [tuple(r) for r in SH.take_fraction(df, scale, ["s", "i"], task_keys=rng.choice([10, 200, 3000]), sketch_keys=rng.choice([30, 500])).collect()]
        assert first_rows(got, len(got)) == first_rows(rows, int(len(rows) * scale))


def test_take_fraction_of_one_repeated_key(spark):
    df = spark.range(5000).select(F.lit("x").alias("k"), "id")
    assert SH.take_fraction(df, 0.25, ["k"], task_keys=100, sketch_keys=50).count() == 1250


def test_sketch_passes_scan_without_sorting_all_keys(spark):
    """Two passes over the keys: one sample, one count; the rest is a filter."""
    df = spark.range(400_000)
    done = []
    group_by, sample = type(df).groupBy, type(df).sample
    type(df).groupBy = lambda self, *a: (done.append("count"), group_by(self, *a))[1]
    type(df).sample = lambda self, *a: (done.append("sample"), sample(self, *a))[1]
    try:
        key, ties, wanted = SH.nth_key(df, ["id"], 123_457, 400_000, task_keys=2000, sketch_keys=20_000)
    finally:
        type(df).groupBy, type(df).sample = group_by, sample
    assert (key, ties, wanted) == ((123_456,), 1, 1)
    assert done == ["sample", "count", "count"]


def test_sample_fraction_is_stable_and_bounded(spark):
    df = spark.range(40_000).withColumn("s", F.concat(F.lit("k"), "id"))
    taken = {r.id for r in SH.sample_fraction(df, 0.1, ["id", "s"]).collect()}
    assert abs(len(taken) - 4000) < 5 * (40_000 * 0.1 * 0.9) ** 0.5
    assert {r.id for r in SH.sample_fraction(df.repartition(7), 0.1, ["id", "s"]).collect()} == taken
    grown = spark.range(60_000).withColumn("s", F.concat(F.lit("k"), "id"))
    assert {r.id for r in SH.sample_fraction(grown, 0.1, ["id", "s"]).collect() if r.id < 40_000} == taken
    assert taken < {r.id for r in SH.sample_fraction(df, 0.2, ["id", "s"]).collect()}
    assert taken != {r.id for r in SH.sample_fraction(df, 0.1, ["id", "s"], seed=1).collect()}
    assert SH.sample_fraction(df, 0.0, ["id"]).count() == 0 and SH.sample_fraction(df, 1.0, ["id"]).count() == 40_000
    nulls = spark.createDataFrame([(None, "a"), ("", "a"), (None, None)], "x string, y string")
    assert nulls.select(SH.key_number(["x", "y"])).distinct().count() == 3
    plan = SH.sample_fraction(df, 0.1, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
