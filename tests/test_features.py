"""Article features on hand-made rows (cases the test data cannot show)."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lexicon import DEFAULT_KEYWORDS, default_stopwords, matchable_stopwords
from tessera.plans.features import FEATURE_COLUMNS, extract_features


def one(spark, expr, *values, schema="a string, b string"):
    rows = [v if isinstance(v, tuple) else (v, None) for v in values]
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_default_keywords(spark):
    got = one(spark, T.keyword_hits(["b", "a"], DEFAULT_KEYWORDS), ("BREAKING: viral", "viral leaked"))
    assert got == [4]


def test_keyword_substring_and_null(spark):
    assert one(spark, T.keyword_hits(["b", "a"], DEFAULT_KEYWORDS), ("", "antiviral"), (None, None)) == [1, 0]


def test_word_count(spark):
    assert one(spark, T.word_count("a"), "a  b ", "", None, "a\tb\nc") == [4, 1, None, 1]


def test_char_counts(spark):
    assert one(spark, T.count_char("a", "!"), "!!a!", "", None) == [3, 0, None]
    assert one(spark, T.count_char("a", "?"), "a?b??", "x") == [3, 0]
    assert one(spark, T.char_length("a"), "é😀") == [2]


def test_ratios(spark):
    assert one(spark, T.smoothed_ratio(T.char_length("a"), T.char_length("b")), ("abc", "")) == [3.0]
    assert one(spark, T.caps_ratio("a"), "ÉAb") == [0.25]
    assert one(spark, T.smoothed_ratio(T.char_length("a"), T.char_length("b")), ("abc", None)) == [None]


def test_special_chars(spark):
    assert one(spark, T.special_char_count("a"), "a-b_c é!", None, "x y z\x1c") == [3, 0, 0]


def test_digits(spark):
    assert one(spark, T.digit_count("a"), "a1b22٣", None) == [3, None]


def test_url(spark):
    assert one(spark, T.has_url("a"), "HTTP://x", "see https://x", None, "http:/x") == [0, 1, 0, 0]


def test_clean_text_contractions(spark):
    got = one(spark, T.clean_text("a", ["can", "not", "me"]), "très don't cannot gimme", None, "")
    assert got == ["trs dont gim", "", ""]


def test_clean_text_default_list(spark):
    got = one(spark, T.clean_text("a"), "The cat, and THE dog!\tWanna  go?")
    assert got == ["cat dog wan na go"]


# --- property: cleaning equals a plain-Python statement of the rules -----------

_TOKEN_SPLITS = {"cannot": ("can", "not"), "gimme": ("gim", "me"), "gonna": ("gon", "na"),
                 "gotta": ("got", "ta"), "lemme": ("lem", "me"), "wanna": ("wan", "na")}


def brute_clean(s, stopwords):
    if s is None:
        return ""
    letters = re.sub(r"[^a-zA-Z \t\n\x0b\f\r]", "", s.lower())
    out = []
    for tok in letters.split():
        pieces = _TOKEN_SPLITS.get(tok, (tok,))
        out += [p for p in pieces if p not in stopwords]
    return " ".join(out)


def brute_special(s):
    if s is None:
        return 0
    return sum(1 for ch in s if not ch.isalnum() and not ch.isspace())


_ALPHABET = st.sampled_from(list("abcAZ  \t\n!?'.,-_0123éÉßçÑ😀 \x0b\x1c ") +
                            ["cannot", "gimme", "wanna", "the", "The", "and", "i", "me", "not", "can"])
_TEXTS = st.lists(_ALPHABET, max_size=30).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(_TEXTS, min_size=1, max_size=20))
def test_clean_and_special_match_brute_force(spark, texts):
    sw = default_stopwords()
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    rows = df.select("a", T.clean_text("a").alias("c"), T.clean_text_tokens("a").alias("k"),
                     T.special_char_count("a").alias("s")).collect()
    sset = set(matchable_stopwords(sw))
    for r in rows:
        assert r["c"] == brute_clean(r["a"], sset)
        assert r["k"] == r["c"]
        assert r["s"] == brute_special(r["a"])


def test_word_alternation_matches_exactly_the_words():
    words = ["a", "an", "and", "about", "i", "in", "is", "it", "its", "itself", "the"]
    rx = re.compile(r"(?<![a-z])(?:" + T.word_alternation(words) + r")(?![a-z])")
    for w in words:
        assert rx.fullmatch(w)
    for w in ["aa", "ann", "ab", "itse", "th", "them", "x"]:
        assert not rx.fullmatch(w)


# --- pipeline shape and plan ------------------------------------------------------

def test_pipeline_columns_and_types(spark):
    df = spark.createDataFrame([("t", "x")], "title string, text string")
    out = extract_features(df, with_stopwords_column=True)
    assert out.columns == ["title", "text"] + FEATURE_COLUMNS[:15] + ["stopwords"] + FEATURE_COLUMNS[15:]
    types = dict(out.dtypes)
    assert types["title_length"] == "int" and types["fake_keywords_count"] == "int"
    assert types["title_text_length_ratio"] == "double" and types["stopwords"] == "array<string>"


def test_pipeline_nulls(spark):
    df = spark.createDataFrame([(None, None)], "title string, text string")
    r = extract_features(df).first().asDict()
    assert r["title_length"] is None and r["text_word_count"] is None
    assert r["text_specialchar_count"] == 0 and r["contains_url"] == 0 and r["fake_keywords_count"] == 0
    assert r["title_clean"] == "" and r["text_clean"] == ""


def test_pipeline_plan_is_narrow_and_native(spark):
    from tessera.sources.fixtures import articles
    from conftest import SF001

    plan = extract_features(articles(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "WholeStageCodegen" in plan or "*(" in plan


def test_stopword_list_equals_spark_default(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert default_stopwords() == StopWordsRemover.loadDefaultStopWords("english")


def test_special_characters_over_all_code_points(spark):
    """Every code point but surrogates and NUL: special unless Python counts it as alphanumeric or white space."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame(pa.table({"id": points, "c": [chr(c) for c in points]})).repartition(4)
    got = {r.id for r in df.where(T.special_char_count("c") == 1).select("id").collect()}
    assert got == {c for c in points if not (chr(c).isalnum() or chr(c).isspace())}
