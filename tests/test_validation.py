"""Validation and measurement."""

from pyspark.sql import functions as F, types as T

from tessera.operators import validation as V
from tessera.operators.measure import measure


def test_parse_json_and_required(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "{oops"), (3, "{}"), (4, None)], "id int, props string")
    schema = T.StructType([T.StructField("k", T.LongType())])
    out = V.require_fields(V.parse_json(df, "props", schema), ["k"], prefix="doc.")
    got = {r["id"]: (r["doc_malformed"], r["missing_field"]) for r in out.collect()}
    assert got[1] == (False, None) and got[2][0] is True and got[3] == (False, "k")
    assert got[4][1] == "k"


def test_check_ranges_null_is_failure(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (2, 1.5), (None, 0.1)], "w int, s double")
    rules = {"w>=1": F.col("w") >= 1, "0<=s<=1": F.col("s").between(0, 1)}
    got = [(r["valid"], r["failed_rule"]) for r in V.check_ranges(df, rules).collect()]
    assert got == [(True, None), (False, "w>=1"), (False, "0<=s<=1"), (False, "w>=1")]
    ok, bad = V.split_valid(df, rules)
    assert ok.count() == 1 and bad.count() == 3


def test_validate_configs(spark):
    docs = [
        ('{"name":"a","num_workers":1,"mem_per_worker":2,"cores_per_worker":4,"dataset_scale":1.0,"log_dir":"x"}',),
        ('{"name":"a","num_workers":0,"mem_per_worker":2,"cores_per_worker":4,"dataset_scale":1.0,"log_dir":"x"}',),
        ('{"name":"a","num_workers":1,"mem_per_worker":2,"cores_per_worker":4,"dataset_scale":1.0}',),
        ('[not json',),
    ]
    out = V.validate_configs(spark.createDataFrame(docs, "config string")).collect()
    assert [r["reason"] for r in out] == [None, "out of range: num_workers>=1", "missing field: log_dir",
                                          "malformed JSON"]
    assert out[0]["cfg"]["remark"] == "" and out[0]["cfg"]["benchmark_name"] == ""


def test_validate_requests(spark):
    good = '{"name":"a","num_workers":1,"mem_per_worker":2,"cores_per_worker":4,"dataset_scale":1.0,"log_dir":"x"}'
    docs = [(1, f"[{good}, {good.replace('1,', '0,', 1)}]"), (2, good), (3, f"[{good}"), (4, None), (5, "[]"),
            (6, f' [ {good.replace("2", chr(34) + "two" + chr(34))}, 7, null]'), (7, ""), (8, "3")]
    out = V.validate_requests(spark.createDataFrame(docs, "id int, request string"))
    got = {(r["id"], r["pos"]): r["reason"] for r in out.collect()}
    assert got == {(1, 0): None, (1, 1): "out of range: num_workers>=1", (2, None): "not an array", (3, None): "malformed JSON",
                   (4, None): "missing document", (6, 0): "wrong type", (6, 1): "wrong type", (6, 2): "missing field: name",
                   (7, None): "malformed JSON", (8, None): "not an array"}


def test_with_defaults(spark):
    df = spark.createDataFrame([(None,), ("r",)], "remark string")
    got = V.with_defaults(df, {"remark": "", "benchmark_name": ""}).collect()
    assert [tuple(r) for r in got] == [("", ""), ("r", "")]


def test_measure_counts_during_the_run(spark):
    r = measure(spark.range(1234)).first()
    assert r["num_rows"] == 1234 and r["E2E_time"] > 0 and r["E2E_throughput"] > 0
