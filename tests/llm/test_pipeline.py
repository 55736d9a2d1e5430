"""The pipeline's stages one by one against brute force, on the small table and on odd rows."""

import re

import corpus_pipeline as P
from conftest import SF001
from test_operators import brute_base, frame, shingles, split

from tessera.llm.common import written


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    seen = docs
    for name, stage in P.STAGES[:-1]:
        out = written(stage(spark, seen, SF001), name)
        assert out.columns == docs.columns, name
        before, after = {r.doc_id: r for r in seen.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if name == "near_dedup":
            kept = [shingles(r.text) for r in after.values()]
            gone = [shingles(r.text) for d, r in before.items() if d not in after]
            near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
            assert not any(near(a, b) for k, a in enumerate(kept) for b in kept[:k])
            assert all(any(near(a, b) for b in kept + gone if b is not a) for a in gone)
        if name == "decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            grams = {" ".join(w[k:k + 10]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
                     for w in [words(r.text)] for k in range(max(1, len(w) - 9)) if w}
            hit = lambda w: any(" ".join(w[k:k + 10]) in grams for k in range(max(1, len(w) - 9)))
            assert {d for d, r in before.items() if not hit(words(r.text))} == set(after)
        if name == "pii_redaction":
            assert set(after) == set(before)
            for d, r in after.items():
                assert r.n_chars == len(r.text) and not brute_base(r.text)
        seen = out
    pieces = P.run(spark, SF001).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in seen.collect()}


def test_odd_rows_pass_through(spark):
    long = " ".join(f"the word{k} of" for k in range(40))
    rows = [(1, long), (1, long), (1, long + " other"), (None, long), (None, long), (2, None), (3, ""), (4, long.title())]
    docs = frame(spark, rows)
    first = P.quality_rules(spark, docs, SF001)
    assert first.columns == docs.columns and sorted(r.doc_id or 0 for r in first.collect()) == [0, 0, 1, 1, 1, 4]
    assert sorted(r.doc_id or 0 for r in P.near_dedup(spark, first, SF001).collect()) == [0, 0, 1]
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, SF001).count() == 0
    assert split(None) == []


def test_quality_rules_keep_upper_case_text(spark):
    long = " ".join(f"the word{k} of" for k in range(40)).upper()
    assert [r.text for r in P.quality_rules(spark, frame(spark, [(4, long)]), SF001).collect()] == [long]
