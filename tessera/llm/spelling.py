"""Spelling variants by permuterm rotations.

Every word gets a terminator (``$``, which no word holds) and stands in the sorted list of all its rotations. A
rotation that begins right after a character c reads ``y$x`` + c, where the word is x + c + y: all words that differ
only in that character share the prefix ``y$x``, and the word x + y, which lacks it, is the rotation ``y$x`` itself.
So each prefix range holds exactly the words near each other by one replaced, inserted or deleted character at one
place. A row carries the prefix and the skipped character; the word is rebuilt from them, so it travels once. The
ranges are sorted by the words' counts and scanned once: every member takes the number of its neighbours and the best
of them, without pairing the members. A range holds one word per character of the alphabet at most (91 rows), so none
grows with the data. A word found twice from a longer one (a character out of a run of equal ones) counts once: only
the first place of such a run counts.

Null and empty texts have no words; a null doc_id counts as the empty string in the drop rule; repeated rows count
again; of words with equal counts the smallest in code-point order is the better; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, written

#: Runs of letters; fixed by the operator's contract.
LETTERS = r"[A-Za-zÀ-ÿ]+"
END = "$"


def word_counts(docs: DataFrame, drop_every: int | None = 199) -> DataFrame:
    """(word, n): lower-cased (A-Z) runs of all texts, added up per task before the shuffle.

    With ``drop_every``, a run loses the character at h % length where that number divides h, the CRC-32 of
    ``<doc_id>:<run>``.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS})"), F.lit(1))).alias("run"))
    runs = runs.select("doc", lower_ascii(F.col("run")).alias("run"))
    word: Column = F.col("run")
    if drop_every:
        h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
        at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
        dropped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs, word = runs.withColumn("h", h), F.when(F.col("h") % drop_every == 0, dropped).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, n): for every place of a word the rotation after it, less the character there; for every
    cut of a word the whole rotation, with an empty ``skipped``."""
    rotation = F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at")
    cut = words.select("word", "n", rotation)
    before, after = F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 1, F.length("word"))
    rest = F.substring("word", F.col("at") + 2, F.length("word"))
    # one row per cut, with the whole rotation and the one that skips the next character
    both = F.array(F.struct(F.concat(after, F.lit(END), before).alias("prefix"), F.lit("").alias("skipped")),
                   F.struct(F.concat(rest, F.lit(END), before).alias("prefix"), F.substring("word", F.col("at") + 1, F.lit(1)).alias("skipped")))
    return (cut.select("n", "word", "at", F.posexplode(both).alias("kind", "r"))
            .where((F.col("kind") == 0) | (F.col("at") < F.length("word"))).select("r.prefix", "r.skipped", "n"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best): scan of the prefix ranges; words without neighbours have n_near 0."""
    at = F.instr("prefix", END)
    after, before = F.expr(f"substring(prefix, 1, instr(prefix, '{END}') - 1)"), F.substring("prefix", at + 1, F.length("prefix"))
    rows = rotations(words).select("prefix", "skipped", "n", F.concat(before, "skipped", after).alias("word"),
                                   ((F.col("skipped") != "") & ~F.endswith(before, F.col("skipped"))).alias("first"))
    whole = Window.partitionBy("prefix").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    skips = F.col("skipped") != ""
    seen = rows.select(
        "word", "n", "skipped", "first", F.count("*").over(whole).alias("members"),
        F.sum(skips.cast("long")).over(whole).alias("skips"), F.sum(F.col("first").cast("long")).over(whole).alias("firsts"),
        *(F.nth_value(c, k).over(whole).alias(f"{c}{k}") for k in (1, 2) for c in ("n", "word"))).where("members > 1")
    whole_word = F.col("members") > F.col("skips")
    near = F.when(skips, F.col("skips") - 1 + (whole_word & F.col("first")).cast("long")).otherwise(F.col("firsts"))
    second = F.col("word") == F.col("word1")
    found = seen.select("word", "n", near.alias("near"), F.struct((-F.when(second, F.col("n2")).otherwise(F.col("n1"))).alias("less"),
                                                               F.when(second, F.col("word2")).otherwise(F.col("word1")).alias("best")).alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    return (found.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
            .select("word", "n", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.best").alias("best")))


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root) of (word, form): each round doubles the number of forms followed."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return at


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, drop_every: int | None = 199) -> DataFrame:
    """Every word with at least ``least_length`` characters and ``least_count`` occurrences: (word, form, root, n, n_near, form_n).

    ``form`` is the most frequent near word where its count is at least ``times`` the word's own, ``root`` the end of the
    chain of forms. Counts grow ``times``-fold along a chain, so its length, and the number of rounds, is logarithmic.
    """
    words = written(word_counts(docs, drop_every).where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    near = written(neighbours(words), "near")
    better = F.col("best_n") >= times * F.col("n")
    judged = near.select("word", "n", "n_near", F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n"))
    most = words.agg(F.max("n")).first()[0] or 1
    longest = int(math.log(max(1, most / least_count), times)) + 1
    ends = roots(judged.where("form is not null").select("word", "form"), max(0, math.ceil(math.log2(longest + 1))))
    return (judged.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
