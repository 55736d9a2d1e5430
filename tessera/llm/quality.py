"""Quality rules: a threshold table compiled into one native Spark projection.

Nulls and empty texts have no words: every count is 0 and the row fails the base
rule. Each row is judged on its own, so repeated rows and ties need no rule. Columns
are added under the given names; an input column of that name is replaced. Very long
texts stay one row: counting is O(n log n) in the words of the row. Stop words count in
any case; their bound judges only rows whose ``lang`` the list covers (every row of a
table without that column).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import spark_words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages (en, fr, de, es).
STOP_WORDS = (
    "the of and to in is that it was on are with for as by at from or an be this have not "
    "le la les de des du et un une en est que qui dans pour par sur au aux avec se ne pas il elle "
    "der die das und ist von zu den dem mit ein eine nicht auf im sich des auch es an werden aus "
    "el los las del y un una que en por con para se su no es al lo como "
).split()
#: The languages of the list.
STOP_LANGS = ("en", "fr", "de", "es")


@dataclass(frozen=True)
class Threshold:
    """Keep a row while low <= metric <= high; a bound of None is open. NULL metrics pass."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The method's table, over the ratio columns of :func:`with_ratios`.
THRESHOLDS = (
    Threshold("mean_word_chars", 2.0, 12.0),
    Threshold("symbol_ratio", None, 0.25),
    Threshold("dup_line_ratio", None, 0.5),
    Threshold("stop_word_ratio", 0.02, None),
)


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words (all long).

    n_repeat_words: words inside a 3-word window that occurs at least twice in the
    text. A window is one long: its hash above, its start in as many low bits as the
    text needs. Sorted, neighbours with the same hash are the repeated ones (for a text
    of 20,000 words that leaves 49 bits of hash, a chance of 4e-7 of a false pair), and
    the words they cover are the sum of the gaps between repeated starts, each at most 3.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    step = df.withColumn("__words", spark_words(t))
    w = F.col("__words")
    step = step.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
        # enough low bits for any position in this text
        "__bits": F.ceil(F.log2(F.size(w) + F.lit(2))).cast("int"),
    })
    bits = F.col("__bits")
    packed = lambda x, i: F.call_function(
        "shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long"))
    step = step.withColumn("__windows", F.sort_array(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), packed)))
    s = F.col("__windows")
    step = step.withColumn("__mask", F.call_function("shiftleft", F.lit(-1).cast("long"), bits))
    same = lambda a, b: F.coalesce(a.bitwiseXOR(b).bitwiseAND(F.col("__mask")) == 0, F.lit(False))
    step = step.withColumns({
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__at": F.sort_array(F.transform(
            F.filter(s, lambda e, j: same(e, F.get(s, j - 1)) | same(e, F.get(s, j + 1))),
            lambda e: e.bitwiseAND(F.bitwise_not(F.col("__mask"))))),
    })
    at = F.col("__at")
    covered = F.transform(at, lambda p, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, k + 1) - p, F.lit(3).cast("long"))))
    return (step.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
            .drop("__words", "__lines", "__windows", "__at", "__bits", "__mask"))


def with_ratios(df: DataFrame) -> DataFrame:
    """Add the metrics that the threshold table speaks about (NULL without words or lines).

    stop_word_ratio is NULL too where ``lang`` names no language of the list (or none at all).
    """
    per_word = {"mean_word_chars": "word_chars", "symbol_ratio": "n_symbols",
                "stop_word_ratio": "n_stop_words", "repeat_word_ratio": "n_repeat_words"}
    ratios = {k: F.try_divide(F.col(v), F.col("n_words")) for k, v in per_word.items()}
    if "lang" in df.columns:
        covered = F.regexp_extract(F.lower("lang"), "^[a-z]+", 0).isin(*STOP_LANGS)
        ratios["stop_word_ratio"] = F.when(covered, ratios["stop_word_ratio"])
    return df.withColumns(ratios | {"dup_line_ratio": F.try_divide(F.col("n_dup_lines"), F.col("n_lines"))})


def passes(thresholds: Sequence[Threshold]) -> Column:
    """The table as one boolean expression."""
    tests = [F.coalesce(test, F.lit(True)) for t in thresholds for test in (
        *([F.col(t.metric) >= t.low] if t.low is not None else []),
        *([F.col(t.metric) <= t.high] if t.high is not None else []))]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def judge_quality(df: DataFrame, text: str = "text", thresholds: Sequence[Threshold] = THRESHOLDS,
                  min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """Every row with its counts, ratios, ``base_failed`` and ``kept``."""
    out = with_ratios(with_counts(df, text))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & passes(thresholds))


def keep_quality(df: DataFrame, text: str = "text", **rules) -> DataFrame:
    """The rows of ``df`` that the rules keep, its columns unchanged.

    A plain filter would be pushed below the projections that compute the counts and evaluate each
    of their nested expressions over and over; an exploded array of one or no element is not.
    """
    lang = [F.col("lang")] if "lang" in df.columns and text != "lang" else []
    judged = judge_quality(df.select(F.struct("*").alias("__row"), F.col(text).alias(text), *lang), text, **rules)
    return judged.select("__row", F.explode(F.when(F.col("kept"), F.array(F.lit(1)))).alias("__one")).select("__row.*")
