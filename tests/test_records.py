"""Parallel RFC-4180 reading, ragged files in one body scan, quarantine of whole files."""

import bz2
import csv
import gzip
import os
import random

import pytest

from tessera.sources import csv as CSV
from tessera.sources import quarantine as Q
from tessera.sources import records as R

SCHEMA = "id bigint, title string, text string"


@pytest.fixture()
def split_conf(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def put(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    for k, v in keep.items():
        spark.conf.set(k, v)


def made(path, seed, n, eol="\n", end=True):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        t = lambda: "".join(rng.choice(["a", '"', ",", eol, eol * 2, "é", "x y", ""]) for _ in range(rng.choice([0, 3, 30, 400 if k % 40 == 0 else 5])))  # noqa: E731, B023
        rows.append((k, t(), t()))
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=eol)
        w.writerow(["id", "title", "te\nxt" if eol == "\n" else "text"])
        w.writerows(rows)
    if not end:
        with open(path, "rb+") as f:
            f.truncate(os.path.getsize(path) - len(eol))
    return [(k, a or None, b or None) for k, a, b in rows]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [64, 300, 5000, 10**8])
def test_parallel_read_equals_the_multi_line_read(spark, tmp_dir, split_conf, size):
    want = made(f"{tmp_dir}/a.csv", 1, 400) + made(f"{tmp_dir}/b.csv", 2, 3, end=False) + made(f"{tmp_dir}/c.csv", 3, 0)
    split_conf(size)
    files = [f"{tmp_dir}/{x}.csv" for x in "abc"]
    got = CSV.read_articles(spark, files, schema=SCHEMA, strict=True)
    assert rows_of(got) == sorted(want, key=repr)
    spark_read = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(files)
    assert rows_of(got) == rows_of(spark_read)
    if size == 300:
        assert R.csv_lines(spark, files).rdd.getNumPartitions() > 20 and spark_read.rdd.getNumPartitions() <= 3


def test_carriage_returns_and_blank_records(spark, tmp_dir, split_conf):
    want = made(f"{tmp_dir}/w.csv", 5, 150, eol="\r\n")
    with open(f"{tmp_dir}/w.csv", "a", newline="") as f:
        f.write("\r\n\r\n7000,x,\"y\r\n\r\nz\"\r\n\r\n")
    for size in (100, 10**8):
        split_conf(size)
        assert rows_of(CSV.read_articles(spark, f"{tmp_dir}/w.csv", schema=SCHEMA, strict=True)) == sorted([*want, (7000, "x", "y\r\n\r\nz")], key=repr)


def test_a_record_longer_than_many_blocks(spark, tmp_dir, split_conf):
    long = "line, \"quoted\"\n" * 2000
    with open(f"{tmp_dir}/l.csv", "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "title", "text"])
        w.writerows([[1, "a", "b"], [2, long, long], [3, "c", ""]])
    split_conf(500)
    assert rows_of(CSV.read_articles(spark, f"{tmp_dir}/l.csv", schema=SCHEMA, strict=True)) == [(1, "a", "b"), (2, long, long), (3, "c", None)]


def test_lines_of_an_arrow_batch_may_cut_a_record(spark, tmp_dir):
    want = made(f"{tmp_dir}/a.csv", 9, 300)
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert rows_of(CSV.read_articles(spark, f"{tmp_dir}/a.csv", schema=SCHEMA, strict=True)) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)


def test_inferred_types_and_empty_file(spark, tmp_dir):
    made(f"{tmp_dir}/a.csv", 1, 20)
    assert CSV.read_articles(spark, f"{tmp_dir}/a.csv", strict=True).dtypes[0][1] in ("int", "bigint")
    open(f"{tmp_dir}/empty.csv", "w").close()
    assert CSV.read_articles(spark, f"{tmp_dir}/empty.csv", schema=SCHEMA, strict=True).count() == 0


# -- ragged run files

def test_ragged_files_take_two_scans_whatever_their_layouts(spark, tmp_dir):
    rng = random.Random(3)
    want = []
    for k in range(25):
        stages = k % 12 + 1
        names = ["num_workers", "remark", *(f"stage{i}_time" for i in range(stages)), "E2E_time"]
        rng.shuffle(names)
        rows = [{n: "a, \"b\"" if n == "remark" else rng.randrange(100) if n == "num_workers" else rng.random() for n in names} for _ in range(3)]
        with open(f"{tmp_dir}/{rng.choice(['SS', 'WS', 'W-'])}-{k}.csv", "w", newline="") as f:
            w = csv.DictWriter(f, names)
            w.writeheader()
            w.writerows(rows)
        want += rows
    df = CSV.read_runs(spark, f"{tmp_dir}/*.csv")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") - plan.count("parquet") <= 1 and "Union" not in plan
    got = [{k: v for k, v in r.asDict().items() if v is not None and k not in ("source_file", "log_dir", "scaling_type")} for r in df.collect()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(got, key=key) == sorted(want, key=key)


# -- quarantine

GOOD = [(1, "a", 2.5), (2, None, None), (3, 'q "x"\ny', -1e-3)]


def text_of(rows, header=("id", "tag", "v")):
    import io
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(header)
    w.writerows([["" if x is None else x for x in r] for r in rows])
    return out.getvalue().encode()


def test_bad_files_are_reported_whole(spark, tmp_dir):
    many = [(k, f"t{k % 7}", k / 3) for k in range(12_000)]
    files = {
        "good/a.csv": text_of(GOOD), "good/b.csv.gz": gzip.compress(text_of(GOOD)) + gzip.compress(b"4,d,1.0\n"), "good/c.csv.bz2": bz2.compress(text_of(many)),
        "cut/d.csv.gz": gzip.compress(text_of(many))[:9000], "cut/e.csv.bz2": bz2.compress(text_of(many))[:5000], "cut/f.csv.gz": b"no archive",
        "head/g.csv": text_of(GOOD, ("id", "label", "v")), "type/h.csv": text_of([*many, ("x", "y", 1.0)]), "more/i.csv": text_of(many) + b"1,2,3,4\n",
        "bytes/j.csv": text_of(GOOD) + b"5,\xff\xfe,1\n", "none/k.csv.gz": gzip.compress(b""), "zero/z.csv": b"", "large/l.csv": text_of([(2**63, "a", 1.0)]), "quote/m.csv": text_of(GOOD) + b'6,"open,1\n'}
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{tmp_dir}/{name}"), exist_ok=True)
        with open(f"{tmp_dir}/{name}", "wb") as f:
            f.write(data)
    rows, rejected = Q.read_or_report(spark, tmp_dir, "id bigint, tag string, v double")
    want = [(*r, "good") for r in [*GOOD, *GOOD, (4, "d", 1.0), *many]]
    assert sorted(((r.id, r.tag, r.v, r.log_dir.split("/")[-1]) for r in rows.collect()), key=repr) == sorted(want, key=repr)
    assert {(r.source_file.split("/")[-1][0], r.reason) for r in rejected.collect()} == {
        ("d", "broken archive"), ("e", "broken archive"), ("f", "broken archive"), ("g", "unexpected header"), ("h", "value of another type"),
        ("i", "wrong number of fields"), ("j", "not UTF-8"), ("k", "empty file"), ("l", "value of another type"), ("m", "malformed record")}
    assert rejected.count() == 10


def test_quarantine_of_no_files_and_unknown_types(spark, tmp_dir):
    rows, rejected = Q.read_or_report(spark, tmp_dir, "id int")
    assert rows.count() == rejected.count() == 0 and rows.columns == ["id", "source_file", "log_dir"]
    with pytest.raises(ValueError, match="not supported"):
        Q.read_or_report(spark, tmp_dir, "id decimal(3,1)")
