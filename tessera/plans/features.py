"""The article feature pipeline: all input columns plus the derived ones.

One ``select`` (not a chain of ``withColumn``), all native expressions, no
shuffle: every partition is processed where it was read, so the plan scales
with the number of input splits and never funnels rows through one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import text as T
from tessera.functions.lexicon import DEFAULT_KEYWORDS

# Output column order of the feature set (the optional stop-word literal
# column sits between fake_keywords_count and title_clean).
FEATURE_COLUMNS = [
    "title_length", "text_length", "title_word_count", "text_word_count",
    "title_text_length_ratio", "title_text_wordcount_ratio",
    "title_exclamation_count", "text_exclamation_count",
    "title_question_count", "text_question_count",
    "title_caps_ratio", "text_digit_count", "text_specialchar_count",
    "contains_url", "fake_keywords_count", "title_clean", "text_clean",
]


def feature_columns(title: Column | str = "title", text: Column | str = "text",
                    keywords: Iterable[str] | None = None,
                    stopwords: Iterable[str] | None = None,
                    with_stopwords_column: bool = False) -> list[Column]:
    """The derived columns, aliased, in output order."""
    title = F.col(title) if isinstance(title, str) else title
    text = F.col(text) if isinstance(text, str) else text
    kw = list(DEFAULT_KEYWORDS if keywords is None else keywords)
    sw = None if stopwords is None else list(stopwords)
    cols = [
        T.char_length(title).alias("title_length"),
        T.char_length(text).alias("text_length"),
        T.word_count(title).alias("title_word_count"),
        T.word_count(text).alias("text_word_count"),
        T.smoothed_ratio(T.char_length(title), T.char_length(text)).alias("title_text_length_ratio"),
        T.smoothed_ratio(T.word_count(title), T.word_count(text)).alias("title_text_wordcount_ratio"),
        T.count_char(title, "!").alias("title_exclamation_count"),
        T.count_char(text, "!").alias("text_exclamation_count"),
        T.count_char(title, "?").alias("title_question_count"),
        T.count_char(text, "?").alias("text_question_count"),
        T.caps_ratio(title).alias("title_caps_ratio"),
        T.digit_count(text).alias("text_digit_count"),
        T.special_char_count(text).alias("text_specialchar_count"),
        T.has_url(text).alias("contains_url"),
        T.keyword_hits([text, title], kw).alias("fake_keywords_count"),
    ]
    if with_stopwords_column:
        cols.append(T.stopword_array(sw).alias("stopwords"))
    cols += [
        T.clean_text(title, sw).alias("title_clean"),
        T.clean_text(text, sw).alias("text_clean"),
    ]
    return cols


def extract_features(df: DataFrame, keywords: Iterable[str] | None = None,
                     stopwords: Iterable[str] | None = None,
                     with_stopwords_column: bool = False,
                     title: str = "title", text: str = "text") -> DataFrame:
    """All input columns followed by the feature columns (F1-F18)."""
    return df.select("*", *feature_columns(title, text, keywords, stopwords, with_stopwords_column))


def write_features(df: DataFrame, path: str | None = None, fmt: str = "parquet",
                   mode: str = "overwrite") -> None:
    """Materialise a feature frame on the executors (never on the driver).

    ``path=None`` runs the full plan into the ``noop`` sink (measurement).
    """
    if path is None:
        df.write.format("noop").mode("overwrite").save()
    else:
        df.write.format(fmt).mode(mode).save(path)
