"""CSV sources and sinks."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import csv as CSV


def test_quoted_newline_default_vs_strict(spark, tmp_dir):
    path = f"{tmp_dir}/a.csv"
    with open(path, "w") as f:
        f.write('title,text\n"A","line1\nline2"\n')
    assert CSV.read_articles(spark, path, schema="title string, text string").count() == 2
    strict = CSV.read_articles(spark, path, schema="title string, text string", strict=True).collect()
    assert [tuple(r) for r in strict] == [("A", "line1\nline2")]


def test_csv_round_trip_keeps_blanks_and_quotes(spark, tmp_dir):
    rows = [("a ", ' "q", x\n y '), ("", None)]
    df = spark.createDataFrame(rows, "title string, text string")
    CSV.write_csv(df, f"{tmp_dir}/out")
    back = CSV.read_articles(spark, f"{tmp_dir}/out", schema="title string, text string", strict=True)
    want = [("a ", ' "q", x\n y '), (None, None)]  # "" reads back as NULL (nullValue "")
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(want, key=repr)


def test_read_runs_ragged_and_classified(spark, tmp_dir):
    import os

    os.makedirs(f"{tmp_dir}/r")
    files = {
        "SS-run-a.csv": "num_workers,cores_per_worker,stage0_time,E2E_time\n1,4,2.5,10.0\n",
        "WS-run-b.csv": "num_workers,cores_per_worker,stage0_time,stage1_time,E2E_time\n2,4,1.0,2.0,5.0\n",
        "W-run-c.csv": 'num_workers,cores_per_worker,remark,E2E_time\n2,64,"a, b",3.0\n',
    }
    for name, body in files.items():
        with open(f"{tmp_dir}/r/{name}", "w") as f:
            f.write(body)
    df = CSV.read_runs(spark, f"{tmp_dir}/r/*.csv")
    got = {r["scaling_type"]: r for r in df.collect()}
    assert set(got) == {"Strong_Scaling", "Weak_Scaling", "Worker_Sweep"}
    assert got["Strong_Scaling"]["stage1_time"] is None and got["Weak_Scaling"]["stage1_time"] == 2.0
    assert got["Worker_Sweep"]["remark"] == "a, b" and got["Worker_Sweep"]["stage0_time"] is None
    assert got["Strong_Scaling"]["log_dir"].endswith("/r")


def test_path_pieces(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("file:/a/b/SS-runs/part-0.csv",)], "p string")
    r = df.select(CSV.base_name(F.col("p")), CSV.parent_name(F.col("p")), CSV.parent_dir(F.col("p"))).first()
    assert tuple(r) == ("part-0.csv", "SS-runs", "file:/a/b/SS-runs")


def test_files_with_a_bad_record_are_left_out_whole(spark, tmp_dir):
    for name, lines in {"a": ["1,x", "2,y"], "b": ["3,x", "4,y,z", "5,w"], "c": ["six,x", "7,y"], "d": []}.items():
        os.makedirs(f"{tmp_dir}/intact/{name}")
        with open(f"{tmp_dir}/intact/{name}/results.csv", "w") as f:
            f.write("\n".join(["id,tag", *lines]) + "\n")
    rows, rejected = CSV.read_intact_files(spark, f"{tmp_dir}/intact/*", "id int, tag string", {"header": "true"})
    assert sorted((r.id, r.tag, r.log_dir[-1]) for r in rows.collect()) == [(1, "x", "a"), (2, "y", "a")]
    assert sorted((r.source_file.split("/")[-2], r.n_bad, r.record) for r in rejected.collect()) == [("b", 1, "4,y,z"), ("c", 1, "six,x")]


def test_truncated_file_fails_the_read(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/cut")
    packed = gzip.compress("".join(f"{i},{i * i}\n" for i in range(20000)).encode())
    with open(f"{tmp_dir}/cut/a.csv.gz", "wb") as f:
        f.write(packed[:len(packed) // 2])
    with pytest.raises(Exception, match="(?i)end of|EOF|FAILED_READ_FILE"):
        CSV.read_with_source(spark, f"{tmp_dir}/cut", "id int, sq long").agg(F.sum("sq")).collect()
