"""Stop-word and keyword tables of any size against the literal lists."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tessera.functions import text as T
from tessera.operators import biglists as B
from tessera.sources import fixtures as X


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def articles(spark):
    return X.articles(spark, SF001)


def corpus_words(articles):
    words = articles.select(F.explode(F.split(T.letters_of(F.col("text")), r"\s+")).alias("w")).where("w <> ''").distinct()
    return sorted(r.w for r in words.collect())


def test_hundred_thousand_stop_words(spark, articles):
    rng = random.Random(1)
    known = corpus_words(articles)
    stop = rng.sample(known, len(known) // 2) + [f"absent{k}" for k in range(100_000)] + ["the", "not", "gim"]
    table = spark.createDataFrame([(w,) for w in stop] + [(None,), ("",), ("the",)], "w string")
    got = B.clean_text_by_table(articles, ["title", "text"], table, ["src", "id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "absent7" not in plan and len(plan) < 200_000
    few = [w for w in stop if not w.startswith("absent")]
    letters = articles.select("src", "id", *[T.letters_of(F.col(c)).alias(c) for c in ("title", "text")]).collect()
    drop = set(few)
    want = sorted(((r.src, r.id, *(" ".join(w for w in (r[c] or "").split() if w not in drop) for c in ("title", "text"))) for r in letters), key=repr)
    assert rows_of(got.select("src", "id", "title_clean", "text_clean")) == want


def test_small_table_equals_the_literal_list(spark):
    texts = ["I cannot, gimme the Don't", None, "", "  the\tthe\nTHE ", "a b c " * 3000, "très bien"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    stop = ["the", "can", "a", "me", "dont"]
    got = B.clean_text_by_table(df, ["text"], spark.createDataFrame([(w,) for w in stop], "w string"), ["id"])
    assert rows_of(got.select("id", "text_clean")) == rows_of(df.select("id", T.clean_text("text", stop).alias("x")))
    none = B.clean_text_by_table(df, ["text"], spark.createDataFrame([], "w string"), ["id"])
    assert rows_of(none.select("id", "text_clean")) == rows_of(df.select("id", T.clean_text("text", []).alias("x")))
    assert B.clean_text_by_table(df.limit(0), ["text"], spark.createDataFrame([("a",)], "w string"), ["id"]).count() == 0


def test_words_that_the_filter_takes_for_stop_words_stay(spark, monkeypatch):
    monkeypatch.setattr(B, "BITS_A_WORD", 1)  # nearly every word passes such a filter
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnopq"]
    df = spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(60)], "id long, text string")
    stop = words[::3]
    got = B.clean_text_by_table(df, ["text"], spark.createDataFrame([(w,) for w in stop], "w string"), ["id"])
    assert rows_of(got.select("id", "text_clean")) == rows_of(df.select("id", T.clean_text("text", stop).alias("x")))


def test_fifty_thousand_keywords(spark, articles):
    rng = random.Random(3)
    texts = [x.lower() for r in articles.select("title", "text").collect() for x in r if x]
    cut = lambda: (lambda t: t[(i := rng.randrange(len(t))):i + rng.randint(1, 12)])(rng.choice([t for t in texts[:50] if t]))
    words = [cut() for _ in range(300)] + ["a", "a", "é", "th", "que", "ing", "", "😀"]
    absent = [f"zq{k}" for k in range(50_000)]
    got = B.keyword_hits_by_table(articles, ["text", "title"], spark.createDataFrame([(w,) for w in words + absent] + [(None,)], "w string"), ["src", "id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "zq7" not in plan and len(plan) < 200_000
    hits = lambda r: sum(w in x for x in ((r.text or "").lower(), (r.title or "").lower()) for w in words + absent)
    want = sorted(((r.src, r.id, hits(r)) for r in articles.select("src", "id", "title", "text").limit(40).collect()), key=repr)
    have = {(r.src, r.id): r.keyword_hits for r in got.collect()}
    assert [(s, i, have[s, i]) for s, i, _ in want] == want and len(have) == articles.count()


def test_keywords_on_odd_rows(spark):
    texts = ["", None, "abc", "ABCD abcd", "x" * 50_000 + "needle", "😀😀 smile", "aaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for words in (["abc", "abcd", "needle", "aa", "aaaaa", "😀", "😀 s"], ["", "b"], [], ["nothing here"]):
        got = B.keyword_hits_by_table(df, ["text"], spark.createDataFrame([(w,) for w in words], "w string"), ["id"])
        assert rows_of(got.select("id", "keyword_hits")) == [(k, sum(w in (t or "").lower() for w in words)) for k, t in enumerate(texts)]


def test_texts_are_not_exploded_for_a_list_that_fits_a_task(spark, articles, monkeypatch):
    stop = corpus_words(articles)[::2]
    table = spark.createDataFrame([(w,) for w in stop], "w string")
    got = B.clean_text_by_table(articles, ["text"], table, ["src", "id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    monkeypatch.setattr(B, "BROADCAST_WORDS", 0)  # the list by Bloom filter and joins
    assert rows_of(got) == rows_of(B.clean_text_by_table(articles, ["text"], table, ["src", "id"]))


def test_rows_of_one_key_share_their_tokens_and_null_keys_have_none(spark):
    df = spark.createDataFrame([(1, "b the a"), (1, "c d"), (None, "x"), (2, "the y")], "id long, text string")
    got = B.clean_text_by_table(df, ["text"], spark.createDataFrame([("the",)], "w string"), ["id"])
    assert rows_of(got.select("id", "text_clean").distinct()) == [(1, "b c d a"), (2, "y"), (None, "")]
    unique = B.clean_text_by_table(df.where("id = 2 or id is null"), ["text"], spark.createDataFrame([("the",)], "w string"), ["id"])
    assert rows_of(unique.select("id", "text_clean")) == [(2, "y"), (None, "")]


def test_keywords_are_counted_where_the_texts_lie(spark, articles, monkeypatch):
    listed = [("a",), ("the",), ("tion",), ("tions",), (". ",), ("://",), ("of the",), ("e, a",), ("é",), ("the",), ("ABC",), ("",)]
    words = spark.createDataFrame([*listed, *[(w,) for w in corpus_words(articles)[::40]]], "w string")
    got = B.keyword_hits_by_table(articles, ["text", "title"], words, ["src", "id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    monkeypatch.setattr(B, "BROADCAST_WORDS", 0)  # the list by its gram index
    assert rows_of(got) == rows_of(B.keyword_hits_by_table(articles, ["text", "title"], words, ["src", "id"]))


def test_kept_words_are_given_up_and_found_again(monkeypatch):
    monkeypatch.setattr(B, "KEPT_WORDS", 3)
    listed = {"ab": 1, "bcde": 2, "x-ab": 4, "--": 8, "bcdefg": 16}
    count = B.keyword_counter(listed)
    for text in ["ab abcde x-ab", "b c d e -- abcdefgh", "", "q w e r t y ab", "ab" * 1000 + "-bcdefg"] * 2:
        assert count(text) == sum(n for k, n in listed.items() if k in text)
