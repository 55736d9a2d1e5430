"""Benchmark decontamination over a distributed positional inverted index.

The corpus is counted for the benchmark's terms; of every phrase (a window of benchmark words) the
two rarest terms become its anchors. Postings (term, text key, positions) of the anchor terms are
stored in the shared folder. A phrase's candidate starts are the rarest term's positions, shifted by
its offset in the phrase, intersected with those of the second term; each is then checked word by
word against the text. With a slop, the two lists are intersected within that distance and a match is
all words of the phrase in order, within its length plus the slop.

Words are lower-cased (A-Z) runs of digits, letters and characters beyond ASCII. A null or empty text
has no words and no hits; an item without words has no phrase; a shorter item is one phrase. Texts are
keyed by their MD5, so copies are searched once and share their result; repeated rows and repeated
items change nothing. Items with a null id are listed as ``null``. Terms travel to the tasks in blocks
of the benchmark of at most ``block_bytes`` of text, so what is sent stays bounded at any size.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: bytes.translate table: A-Z lower-cased, every other byte that is not part of a word becomes a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def text_key(text: bytes | None) -> bytes:
    return hashlib.md5(text or b"", usedforsecurity=False).digest()


def benchmark_phrases(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(item string, phrase string) of every window of ``width`` words; shorter items are one phrase."""
    schema = pa.schema([("item", pa.string()), ("phrase", pa.string())])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                w = words_of(text)
                out += [{"item": item, "phrase": b" ".join(w[k:k + width]).decode()} for k in range(max(1, len(w) - width + 1)) if w]
            yield pa.RecordBatch.from_pylist(out, schema)

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string"))
    return items.mapInArrow(windows, "item string, phrase string").distinct()


def term_frequencies(texts: DataFrame, terms: frozenset[bytes]) -> DataFrame:
    """(term, n) of ``terms`` over the whole corpus; counted per task, then added up."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for b in batches:
            for t in _texts(b.column(0)):
                n.update(filter(sent.value.__contains__, words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(n.values(), pa.int64())], names=["term", "n"])

    return texts.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(texts: DataFrame, terms: frozenset[bytes]) -> DataFrame:
    """The positional index of ``terms``: one row (term, key, positions) per term and text."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("term", pa.string()), ("key", pa.binary()), ("positions", pa.list_(pa.int32()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sent.value
        for b in batches:
            terms_, keys, places = [], [], []
            for t in _texts(b.column(0)):
                at: dict[bytes, list[int]] = {}
                for k, w in enumerate(words_of(t)):
                    if w in kept:
                        at.setdefault(w, []).append(k)
                if at:
                    terms_ += [w.decode() for w in at]
                    keys += [text_key(t)] * len(at)
                    places += at.values()
            yield pa.RecordBatch.from_arrays([pa.array(terms_, pa.string()), pa.array(keys, pa.binary()),
                                              pa.array(places, pa.list_(pa.int32()))], schema=schema)

    return texts.select("text").mapInArrow(index, "term string, key binary, positions array<int>").distinct()


def anchors(phrases: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(phrase, length, term, offset, rank): the two rarest places of every phrase whose words all occur in the corpus."""
    w = F.split("phrase", " ")
    places = phrases.select("phrase", F.size(w).alias("length"), F.posexplode(w).alias("offset", "term")).join(frequencies, "term", "left")
    by_rarity = Window.partitionBy("phrase").orderBy("n", "offset")  # a phrase's own few words
    return (places.withColumn("rank", F.row_number().over(by_rarity))
            .withColumn("known", F.count("n").over(Window.partitionBy("phrase")) == F.col("length"))
            .where("known and rank <= 2").select("phrase", "length", "term", "offset", "rank"))


def candidate_starts(places: DataFrame, index: DataFrame, slop: int = 0) -> DataFrame:
    """(key, phrase, start) where the offset-adjusted lists of a phrase's anchors meet."""
    def starts(rank: int) -> DataFrame:
        return (places.where(F.col("rank") == rank).join(index, "term")
                .select("key", "phrase", "length", F.explode("positions").alias("position"), "offset")
                .select("key", "phrase", "length", (F.col("position") - F.col("offset")).alias("start")))

    first = starts(1).where(F.col("start") >= -slop)
    second = starts(2).select(F.col("key").alias("k2"), F.col("phrase").alias("p2"), F.col("start").alias("s2"))
    near = F.col("start") == F.col("s2") if slop == 0 else F.abs(F.col("start") - F.col("s2")) <= slop
    both = first.where("length > 1").join(second, (F.col("key") == F.col("k2")) & (F.col("phrase") == F.col("p2")) & near, "left_semi")
    return both.unionByName(first.where("length = 1")).select("key", "phrase", "start")


def match_at(words: list[bytes], phrase: list[bytes], start: int, slop: int) -> tuple[int, int] | None:
    """(start, end) of the phrase in ``words`` at ``start``; with a slop, the first match that begins within it."""
    if slop == 0:
        return (start, start + len(phrase)) if start >= 0 and words[start:start + len(phrase)] == phrase else None
    for s in range(max(0, start - slop), min(len(words), start + slop + 1)):
        at = s - 1
        try:
            for w in phrase:
                at = words.index(w, at + 1, s + len(phrase) + slop)
        except ValueError:
            continue
        if words[s] == phrase[0]:
            return s, at + 1
    return None


def find_hits(docs: DataFrame, candidates: DataFrame, hot: DataFrame, slop: int = 0) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with key, n_words, n_hit (words inside matches) and the matched phrases.

    Rows meet their candidates by the text's key; the rows of a frequent text (``hot``) are dealt over several tasks,
    each with a copy of that text's candidates.
    """
    places = candidates.groupBy("key").agg(F.collect_set(F.struct("start", "phrase")).alias("places"))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                        ("phrases", pa.list_(pa.string()))])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, key, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2)), b.column(3).to_pylist()):
                words = words_of(text)
                hit, phrases = set(), set()
                for p in found or ():
                    if span := match_at(words, p["phrase"].encode().split(b" "), p["start"], slop):
                        hit.update(range(*span))
                        phrases.add(p["phrase"])
                out.append((doc, key, len(words), len(hit), sorted(phrases)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, schema.types)], schema=schema)

    rows = dealt(keyed(docs), hot).join(copied(places, hot), ["key", "part"], "left")
    return rows.select("doc_id", "key", "text", "places").mapInArrow(check, "doc_id long, key binary, n_words long, n_hit long, phrases array<string>")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key is the text's digest, so copies of a text share their candidates."""
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), "text")


def frequent_texts(rows: DataFrame, hot_share: int = 1000) -> DataFrame:
    """(key, parts) of the texts that more than one row in ``hot_share`` repeats, fewer than ``hot_share`` by that.

    ``parts`` is the number of tasks that their rows are dealt to, each about one ``hot_share``-th of all rows.
    """
    n = max(rows.count(), 1)
    return (rows.groupBy("key").count().where(F.col("count") > F.greatest(F.lit(1), F.lit(n // hot_share)))
            .select("key", F.ceil(F.col("count") * hot_share / n).alias("parts")))


def dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with ``part``: rows of a frequent text are dealt over its parts by doc_id."""
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1).cast("long")))
    return rows.join(F.broadcast(hot), "key", "left").withColumn("part", part).drop("parts")


def copied(by_key: DataFrame, hot: DataFrame) -> DataFrame:
    """``by_key`` (a row per text) with a copy for every ``part``."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))
    return by_key.join(F.broadcast(hot), "key", "left").withColumn("part", parts).drop("parts")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0, block_bytes: int = 32 << 20) -> DataFrame:
    """Every document (doc_id) with n_words, n_hit and ``items``, the sorted ids (strings) of the items it holds."""
    phrases = written(benchmark_phrases(benchmark, width), "phrases")
    size = phrases.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    blocks = max(1, -(-size // (block_bytes * width)))
    texts = docs.select("text")
    found = None
    for b in range(blocks):
        part = phrases.select("phrase").distinct().where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)
        vocabulary = frozenset(r[0].encode() for r in part.select(F.explode(F.split("phrase", " "))).distinct().collect())
        places = written(anchors(part, term_frequencies(texts, vocabulary)), "anchors")
        rare = frozenset(r[0].encode() for r in places.select("term").distinct().collect())
        one = candidate_starts(places, written(postings(texts, rare), "postings"), slop)
        found = one if found is None else found.unionByName(one)
    hot = written(frequent_texts(keyed(docs)), "frequent-texts")  # fewer than 1,000 rows, so it may be broadcast
    hits = written(find_hits(docs, found, hot, slop), "hits")
    items = (hits.select("key", F.explode("phrases").alias("phrase")).distinct().join(phrases, "phrase")
             .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    return (dealt(hits.select("doc_id", "key", "n_words", "n_hit"), hot).join(copied(items, hot), ["key", "part"], "left")
            .select("doc_id", "key", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")))
