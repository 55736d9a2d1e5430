"""Ranked lexical search by Block-Max MaxScore over a document-partitioned inverted index.

The corpus is cut into shards of about ``shard_bytes`` of text where it lies, without a shuffle; a longer text is a
shard of its own. One row of the index table is one shard: its documents and lengths, its sorted terms with their
document counts, and their postings in blocks of 64. A block packs document numbers (as distances from its first) and
frequencies in as few bytes as its largest needs, and its header keeps its first and last document and its largest
impact. The corpus figures behind an impact (documents, terms) come from a counting pass before.

A query is scored shard by shard in one task, its heap of the best k going from shard to shard. The weighted largest
impact of each list in the shard bounds it. Lists are ordered by that bound, and the longest prefix of weak lists whose
bounds add up to less than the k-th best score is non-essential: documents found only there cannot enter. Essential
lists are decoded and their documents scored. Then the non-essential lists follow, strongest first: a candidate whose
score, plus the maximum of the block it would fall into, plus the bounds of the lists to come, stays below the k-th
best is rejected from the block headers alone, and only blocks with a candidate left are decoded. All bounds are exact
integers, so the result is that of scoring every document. Each task sends its heaps, and ranks merge them.

Terms are lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII; queries go to the tasks in
blocks of at most ``block_bytes`` of text, so what is sent is bounded at any size. Null and empty texts have no terms:
such documents are never found and count for nothing, such items have no rows. Items that repeat id and text count
once; texts that share an id are ranked each by itself. Repeated documents are ranked as documents of their own; equal
scores follow the doc_id, a null one last. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import shared_path, written
from tessera.llm.decontaminate import words_of

BLOCK = 64
SHARDS_A_FILE = 8
#: doc_id of rows without one, inside the index: it sorts last.
NO_ID = np.iinfo(np.int64).max
INDEX = pa.schema([("ids", pa.binary()), ("norms", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("first", pa.binary()),
                   ("last", pa.binary()), ("width", pa.binary()), ("maxima", pa.binary()), ("packed", pa.binary())])
INDEX_DDL = ", ".join(f"{name} binary" for name in INDEX.names)


def corpus_figures(docs: DataFrame) -> tuple[int, int]:
    """(documents with at least one term, all their terms)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(words_of(t.as_py())) for t in b.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([sum(k > 0 for k in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["docs", "terms"])

    row = docs.select(F.col("text").cast("string")).mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def length_norms(lengths: list[int], n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 75 + ((75 * n * N) div L) of every document length n."""
    return np.array([100 - 75 + 75 * n * n_docs // max(1, n_terms) for n in lengths], np.int64)


def impacts(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """A term's score in a document before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * norms)


def _pack(values: np.ndarray, at: np.ndarray, width: np.ndarray, out: np.ndarray) -> None:
    for k in range(4):
        on = width > k
        out[at[on] + k] = (values[on] >> (8 * k)) & 255


def _widths(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


def block_bounds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block of each term and one more, first posting of each block, postings of each block)."""
    blocks = -(-counts // BLOCK)
    of_term = np.concatenate([[0], np.cumsum(blocks)])
    starts = np.concatenate([[0], np.cumsum(counts)])
    start = np.repeat(starts[:-1], blocks) + BLOCK * (np.arange(of_term[-1]) - np.repeat(of_term[:-1], blocks))
    return of_term, start, np.diff(np.append(start, starts[-1]))


def shard_row(ids: list[int | None], texts: list[bytes | None], n_docs: int, n_terms: int) -> list[bytes]:
    """One row of the index over these documents."""
    words = [words_of(t) for t in texts]
    kept = [k for k, w in enumerate(words) if w]
    words = [words[k] for k in kept]
    flat = [w for doc in words for w in doc]
    terms = sorted(set(flat))
    number = dict(zip(terms, range(len(terms))))
    lengths = [len(w) for w in words]
    norms = length_norms(lengths, n_docs, n_terms)
    key = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)) * max(1, len(kept)) + np.repeat(np.arange(len(kept)), lengths)
    key, tf = np.unique(key, return_counts=True)
    doc = key % max(1, len(kept))
    counts = np.bincount(key // max(1, len(kept)), minlength=len(terms))
    _, start, size = block_bounds(counts)
    if len(start):
        first, last = doc[start], doc[start + size - 1]
        maxima = np.maximum.reduceat(impacts(tf, norms[doc]), start)
        wide, deep = _widths(last - first), _widths(np.maximum.reduceat(tf, start))
    else:
        first = last = maxima = wide = deep = np.zeros(0, np.int64)
    block = np.repeat(np.arange(len(start)), size)
    offset = np.concatenate([[0], np.cumsum(size * (wide + deep))])
    place = np.arange(len(doc)) - np.repeat(start, size)
    packed = np.zeros(int(offset[-1]), np.uint8)
    _pack(doc - first[block], offset[block] + place * wide[block], wide[block], packed)
    _pack(tf, offset[block] + (size * wide)[block] + place * deep[block], deep[block], packed)
    named = np.array([NO_ID if ids[k] is None else ids[k] for k in kept], np.int64)
    return [named.tobytes(), norms.tobytes(), b"\n".join(terms), counts.astype(np.uint32).tobytes(), first.astype(np.uint32).tobytes(),
            last.astype(np.uint32).tobytes(), (wide * 8 + deep).astype(np.uint8).tobytes(), maxima.astype(np.uint32).tobytes(), packed.tobytes()]


def build_index(docs: DataFrame, n_docs: int, n_terms: int, shard_bytes: int = 4 << 20) -> DataFrame:
    """The index table, one row a shard; every document and every term of ``docs`` (doc_id, text) is in it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in shard_row(ids, texts, n_docs, n_terms)], schema=INDEX)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                text = t.as_py()
                if size and size + len(text or b"") > shard_bytes:
                    yield emit()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text or b"")
        if ids:
            yield emit()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, INDEX_DDL)


class Shard:
    """One row of the index, with its lists opened as they are needed."""

    def __init__(self, row: dict[str, bytes]):
        self.ids, self.norms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.first, self.last = (np.frombuffer(row[c], np.uint32).astype(np.int64) for c in ("first", "last"))
        self.maxima, self.packed = np.frombuffer(row["maxima"], np.uint32).astype(np.int64), np.frombuffer(row["packed"], np.uint8)
        width = np.frombuffer(row["width"], np.uint8).astype(np.int64)
        self.wide, self.deep = width // 8, width % 8
        self.of_term, _, self.size = block_bounds(self.counts)
        self.offset = np.concatenate([[0], np.cumsum(self.size * (self.wide + self.deep))])
        self.number = dict(zip(row["terms"].split(b"\n"), range(len(self.counts))))
        self.decoded = 0

    def _values(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(4):
            on = width > k
            if not on.any():
                break
            out[on] |= self.packed[at[on] + k].astype(np.int64) << (8 * k)
        return out

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of the blocks, in order."""
        self.decoded += len(blocks)
        size = self.size[blocks]
        block = np.repeat(blocks, size)
        place = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)
        wide, deep = self.wide[block], self.deep[block]
        doc = self.first[block] + self._values(self.offset[block] + place * wide, wide)
        tf = self._values(self.offset[block] + self.size[block] * wide + place * deep, deep)
        return doc, impacts(tf, self.norms[doc])


@dataclass
class Best:
    """The best k (score, id) of a query so far, highest first, equal scores by id."""
    k: int
    scores: np.ndarray
    ids: np.ndarray

    @property
    def least(self) -> int:
        """A score that a document must reach to enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_shard(shard: Shard, query: dict[bytes, int], best: Best) -> None:
    """Block-Max MaxScore of one query (term -> weight times its repeats) over one shard."""
    found = [(shard.number[t], c) for t, c in query.items() if c > 0 and t in shard.number]
    lists = sorted((c * int(shard.maxima[shard.of_term[t]:shard.of_term[t + 1]].max()), t, c) for t, c in found)
    before = np.concatenate([[0], np.cumsum([x[0] for x in lists])]).astype(np.int64) if lists else np.zeros(1, np.int64)
    weak = int(np.searchsorted(before, best.least, "left")) - 1  # lists whose bounds add up to less than a score that can enter
    if weak >= len(lists):
        return
    score = np.zeros(len(shard.ids), np.int64)
    for _, t, c in lists[weak:]:
        doc, impact = shard.postings(np.arange(shard.of_term[t], shard.of_term[t + 1]))
        score[doc] += c * impact
    at = np.flatnonzero(score)
    for k in range(weak - 1, -1, -1):
        at = at[score[at] + before[k + 1] >= best.least]
        if not len(at):
            return
        _, t, c = lists[k]
        lo, hi = shard.of_term[t], shard.of_term[t + 1]
        block = lo + np.searchsorted(shard.last[lo:hi], at)
        inside = block < hi
        inside[inside] = shard.first[block[inside]] <= at[inside]
        bound = np.zeros(len(at), np.int64)
        bound[inside] = c * shard.maxima[block[inside]]
        alive = score[at] + bound + before[k] >= best.least
        at, block, inside = at[alive], block[alive], inside[alive]
        if inside.any():
            doc, impact = shard.postings(np.unique(block[inside]))
            place = np.minimum(np.searchsorted(doc, at), len(doc) - 1)
            hit = doc[place] == at
            score[at[hit]] += c * impact[place[hit]]
    at = at[score[at] >= best.least]
    if len(at):
        best.add(score[at], shard.ids[at])


def document_counts(index: DataFrame, terms: frozenset[bytes]) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each of ``terms``."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for b in batches:
            for names, counts in zip(b.column(0), b.column(1)):
                number = dict(zip(names.as_py().split(b"\n"), np.frombuffer(counts.as_py(), np.uint32).tolist()))
                for t in sent.value & number.keys():
                    n[t] += number[t]
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.term): r.n for r in rows}


def _best_rows(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``k`` documents of every item (item_id, text)."""
    kind = items.schema["item_id"].dataType
    asked = written(items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct(), "items")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    schema = pa.schema([("item", pa.int64()), ("item_id", to_arrow_type(kind)), ("id", pa.int64()), ("score", pa.int64())])
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        terms = [Counter(words_of(r.text.encode())) for r in rows]
        counts = document_counts(index, frozenset(t for q in terms for t in q))
        weight = {t: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * n + 1)))) for t, n in counts.items()}
        queries = [{t: n * weight[t] for t, n in q.items() if t in weight} for q in terms]
        sent = index.sparkSession.sparkContext.broadcast((queries, [r.item_id for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries, names = sent.value
            best = [Best(k, np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
            for b in batches:
                for j in range(b.num_rows):
                    shard = Shard({c: b.column(c)[j].as_py() for c in INDEX.names})
                    for query, top in zip(queries, best):
                        search_shard(shard, query, top)
            size = [len(x.ids) for x in best]
            joined = lambda part: np.concatenate([np.zeros(0, np.int64), *part])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(best)), size), pa.int64()), pa.array([x for x, n in zip(names, size) for _ in range(n)], schema.field("item_id").type),
                pa.array(joined(x.ids for x in best)), pa.array(joined(x.scores for x in best))], schema=schema)

        found = index.mapInArrow(run, f"item long, item_id {kind.simpleString()}, id long, score long").withColumn("block", F.lit(block))
        out = found if out is None else out.unionByName(found)
    # heaps of many tasks are merged in two steps, so no task gets all heaps of an item
    salted = out.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    part = _best_rows(salted, ["block", "item", "salt"], k).drop("rank", "salt")
    return _best_rows(part, ["block", "item"], k).select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = 4 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): index ``docs`` (doc_id, text) and rank them for every item (item_id, text)."""
    n_docs, n_terms = corpus_figures(docs)
    path = shared_path(docs.sparkSession, "index")
    # a reader holds the shards of one file at a time
    build_index(docs, n_docs, n_terms, shard_bytes).write.option("maxRecordsPerFile", SHARDS_A_FILE).parquet(path)
    return search(docs.sparkSession.read.schema(INDEX_DDL).parquet(path), n_docs, items, k)
