"""Stop-word and keyword lists too large to travel as literals in the plan.

Both lists are tables (one string column). Nothing in the plans grows with them but one Bloom filter of a bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import text as T
from tessera.session import written

#: Bits a word, hash functions, and the largest filter (16 MB); beyond it false positives rise, results stay exact.
BITS_A_WORD, HASHES, MOST_BITS = 12, 4, 1 << 27
#: Words that may be broadcast.
BROADCAST_WORDS = 100_000
#: Longest pieces of text that the keyword index looks up.
GRAM = 4
#: Words of a text, whose matches a task keeps, and the most words and letters that it keeps them for.
WORD, KEPT_WORDS, KEPT_LENGTH = "[0-9A-Za-z\x80-\U0010ffff]+", 200_000, 40
#: A frequent gram is dealt over so many tasks.
SALTS = 16


def _bit(word: Column, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(word, F.lit(i)), F.lit(bits))


def bloom_filter(words: DataFrame, column: str, n: int) -> tuple[DataFrame, int]:
    """(one row with ``bits`` array<bigint>, number of bits) of a Bloom filter over ``n`` words."""
    slots = max(1, -(-min(MOST_BITS, BITS_A_WORD * n) // 64))
    places = words.select(F.explode(F.array(*[_bit(F.col(column), i, 64 * slots) for i in range(HASHES)])).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    filled = places.select(F.floor(F.col("bit") / 64).alias("slot"), one.alias("one")).groupBy("slot").agg(F.bit_or("one").alias("bits"))
    every = words.sparkSession.range(slots).withColumnRenamed("id", "slot").join(filled, "slot", "left")
    bits = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(bits, lambda x: x["bits"]).alias("bits")), 64 * slots


def _maybe(word: Column, bits: Column, n: int) -> Column:
    """Whether the filter may hold ``word``."""
    test = None
    for i in range(HASHES):
        at = _bit(word, i, n)
        hit = F.expr("0L") != F.get(bits, F.floor(at / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.expr("1L"), (at % 64).cast("int")))
        test = hit if test is None else test & hit
    return test


def keys_repeat(df: DataFrame, key: Sequence[str]) -> bool:
    """Whether two rows of ``df`` have the same ``key`` without NULL."""
    known = df.select(*key).dropna()
    return bool(known.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count())


def _named(key: Sequence[str]) -> Column:
    """Whether no column of ``key`` is NULL."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])


def clean_text_by_table(df: DataFrame, columns: Sequence[str], stopwords: DataFrame, key: Sequence[str], suffix: str = "_clean") -> DataFrame:
    """``df`` with a cleaned copy of each of ``columns``: the same text as ``functions.text.clean_text`` with a list of any size.

    ``stopwords`` has one string column; ``key`` names columns of ``df`` that are unique and not NULL.
    A list of at most BROADCAST_WORDS words is broadcast, and each row looks up its own tokens: no text is shuffled.
    For a longer one, and where keys do repeat (their rows share their tokens), tokens are exploded with their positions and tested against a Bloom filter of the list. What it cannot hold stays. What
    it may hold is a stop word or one of few others: the distinct candidates of the whole table (combined per task), less the
    list, by a left-anti join. Candidates that equal one of those stay as well; where they are few they are broadcast
    (counted first), else frequent candidates are dealt over several tasks. The tokens that stay are regrouped by row in their
    order, each task's first.
    """
    word = stopwords.columns[0]
    words = written(stopwords.select(F.col(word).alias("word")).where("word is not null and word <> ''").distinct(), "stop-words")
    tokens = lambda c: F.array_remove(F.split(T.letters_of(F.col(c)), r"\s+"), "")
    n = words.count()
    if n <= BROADCAST_WORDS and not keys_repeat(df, key):
        listed = df.sparkSession.sparkContext.broadcast(frozenset(r.word for r in words.collect()))
        left = F.udf(lambda text: text and " ".join([w for w in text.split() if w not in listed.value]), "string", useArrow=True)
        cleaned = {c + suffix: left(T.letters_of(F.when(_named(key), F.col(c)))) for c in columns}
        return df.withColumns({c: F.coalesce(x, F.lit("")) for c, x in cleaned.items()}).select(*df.columns, *cleaned)
    places = df.select(*key, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), tokens(c).alias("w")) for k, c in enumerate(columns)])).alias("t"))
    places = places.select(*key, F.col("t.k").alias("__column"), F.posexplode("t.w").alias("__pos", "__word"))
    if n:
        row, size = bloom_filter(words, "word", n)
        maybe = _maybe(F.col("__word"), written(row, "bloom").scalar(), size)
        held = places.where(maybe)
        others = written(held.select("__word").distinct().join(words, F.col("__word") == F.col("word"), "left_anti"), "other-words")
        n_others = others.count()
        places = places.where(~maybe)
        if n_others:
            if n_others <= BROADCAST_WORDS:
                back = held.join(F.broadcast(others), "__word")
            else:
                salted = others.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                back = held.withColumn("__salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).join(salted, ["__word", "__salt"])
            places = places.unionByName(back.select(*places.columns))
    one = lambda k: F.array_sort(F.collect_list(F.when(F.col("__column") == k, F.struct("__pos", "__word"))))
    regrouped = places.groupBy(*key).agg(*[F.transform(one(k), lambda x: x["__word"]).alias(f"__kept{k}") for k in range(len(columns))])
    cleaned = {c + suffix: F.coalesce(F.array_join(f"__kept{k}", " "), F.lit("")) for k, c in enumerate(columns)}
    return df.join(regrouped, list(key), "left").withColumns(cleaned).select(*df.columns, *cleaned)


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters, in time linear in the text."""
    chars = F.array_remove(F.split(text, ""), "")
    grams = chars
    for k in range(1, size):  # the shifted copy is shorter, and a pair without a partner is NULL
        grams = F.zip_with(grams, F.slice(chars, k + 1, 2 * F.length(text)), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.array_compact(grams))


def keyword_counter(listed: dict[str, int]) -> Callable[[str], int]:
    """A function: the sum of the numbers of ``listed`` keywords that a text holds.

    A keyword is looked for by its longest word, first within the distinct words of the text. A word's substrings are looked up
    by their first GRAM characters, then by the lengths that the list has for these; what was found in a word is kept for the next text.
    """
    word, exact, longer, wordless, short, starts = re.compile(WORD), {}, {}, [], set(), {}
    for keyword, times in listed.items():
        anchor = max(word.findall(keyword), key=len, default="")
        if anchor == keyword:
            exact[anchor] = times
        elif anchor:
            longer.setdefault(anchor, []).append((keyword, times))
        else:
            wordless.append((keyword, times))
    anchors = exact.keys() | longer.keys()
    for anchor in anchors:
        if len(anchor) < GRAM:
            short.add(len(anchor))
        else:
            starts.setdefault(anchor[:GRAM], set()).add(len(anchor))
    gram, most, longest, seen = GRAM, KEPT_WORDS, KEPT_LENGTH, {}

    def within(w: str) -> list[str]:
        found = {w[i:i + n] for n in short for i in range(len(w) - n + 1) if w[i:i + n] in anchors}
        for i in range(len(w) - gram + 1):
            for n in starts.get(w[i:i + gram], ()):
                if w[i:i + n] in anchors:
                    found.add(w[i:i + n])
        return [*found]

    def count(text: str) -> int:
        found = set()
        for w in set(word.findall(text)):
            held = seen.get(w)
            if held is None:
                held = within(w)
                if len(w) <= longest:
                    if len(seen) >= most:
                        seen.clear()
                    seen[w] = held
            found.update(held)
        hits = sum(times for keyword, times in wordless if keyword in text)
        for anchor in found:
            hits += exact.get(anchor, 0) + sum(times for keyword, times in longer.get(anchor, ()) if keyword in text)
        return hits

    return count


def keyword_hits_by_table(df: DataFrame, columns: Sequence[str], keywords: DataFrame, key: Sequence[str], name: str = "keyword_hits") -> DataFrame:
    """``df`` with ``functions.text.keyword_hits`` over a list of any size: for each keyword and each of ``columns``, +1 if the
    keyword is a substring of the lower-cased column; NULL counts as "".

    ``keywords`` has one string column, and repeated keywords count again; ``key`` names columns of ``df`` that are unique and not NULL.
    A list of at most BROADCAST_WORDS keywords is broadcast, and each row is scanned where it lies (``keyword_counter``).
    For a longer one, and where keys do repeat (a keyword in k rows of one key counts k times in each), an inverted index posts every keyword under one of its grams of four characters (a shorter keyword under itself): the
    one that the fewest texts hold. Texts meet it in a join on their distinct grams, frequent ones dealt over several
    tasks, and the candidates of a row are checked with ``contains``. No expression grows with the list.
    """
    column = keywords.columns[0]
    listed = written(keywords.select(F.col(column).alias("keyword")).where("keyword is not null").groupBy("keyword").agg(F.count("*").alias("times")), "keywords")
    words = listed.where("keyword <> ''").withColumn("length", F.length("keyword"))
    always = listed.where("keyword = ''").agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0] * len(columns)
    sizes = sorted(r[0] for r in words.select(F.least("length", F.lit(GRAM)).alias("n")).distinct().collect())
    lowered = [F.coalesce(F.lower(c), F.lit("")) for c in columns]
    texts = df.select(*key, F.posexplode(F.array(*lowered)).alias("__column", "__text"))
    if not sizes:
        return df.withColumn(name, F.lit(always).cast("int"))
    if words.count() <= BROADCAST_WORDS and not keys_repeat(df, key):
        listed = df.sparkSession.sparkContext.broadcast({r.keyword: r.times for r in words.collect()})
        kept: dict = {}  # one counter per task

        def hits(*texts: str | None) -> int:
            count = kept.get("count") or kept.setdefault("count", keyword_counter(listed.value))
            return sum(count(t) for t in texts if t)

        texts = [F.lower(F.when(_named(key), F.col(c))) for c in columns]
        return df.withColumn(name, (F.udf(hits, "long", useArrow=True)(*texts) + F.lit(always)).cast("int")).select(*df.columns, name)
    grams = texts.select(*key, "__column", F.explode(F.concat(*[_grams(F.col("__text"), n) for n in sizes])).alias("gram"))
    of_words = words.select("keyword", "times", F.explode(F.concat(*[
        F.when(F.col("length") == n, F.array("keyword")).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM)],
        F.when(F.col("length") >= GRAM, _grams(F.col("keyword"), GRAM)).otherwise(F.array().cast("array<string>")))).alias("gram"))
    known = of_words.select("gram").distinct()
    # texts per gram of the list; a gram that no text holds rules its keywords out
    counts = written(grams.join(known, "gram").groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")
    index = written(of_words.join(counts, "gram", "left").groupBy("keyword", "times")
                    .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
                    .where("n > 0").select("gram", "keyword", "times"), "keyword-index")
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = grams.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int"))
    found = (dealt.join(salted, ["gram", "salt"]).groupBy(*key, "__column").agg(F.collect_list(F.struct("keyword", "times")).alias("__found")))
    hits = (texts.join(found, [*key, "__column"]).select(*key, F.aggregate(
        F.filter("__found", lambda k: F.contains("__text", k["keyword"])), F.lit(0).cast("long"), lambda a, k: a + k["times"]).alias("__hits"))
        .groupBy(*key).agg(F.sum("__hits").alias("__hits")))
    return (df.join(hits, list(key), "left").withColumn(name, (F.coalesce("__hits", F.lit(0)) + F.lit(always)).cast("int")).select(*df.columns, name))
