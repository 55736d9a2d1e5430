"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct five-word shingles, as 64-bit hashes. Of every random permutation
both the smallest and the largest image are kept, so ``permutations`` hash evaluations give twice as many
signature values, each equal for two sets with a probability of their similarity. Bands of ``rows``
values name buckets. Documents with the same words form one class; only its first document goes on.

Within a bucket every member is compared with the bucket's first member, on full sets. Components are
then formed, and only buckets whose remaining members lie in different components go on. In each further round
members outside the bucket's largest component, 64 times as many as before, are compared with the members of
other components; a member's turn follows from its hash, the round and the bucket's size. After the last round all of
them had it, so every pair of a bucket that could join two components was compared, without pairs inside components.
Large buckets are dealt over several tasks, each with its part of the members and all members whose turn it is.
Three exact bounds spare work: items that no other open set has are in no intersection, which bounds the sizes that
a set's partners may have, and members leave whose bucket holds no such size; and pairs go on only if bit maps of
both sets leave room for the intersection they need.

With 80 permutations and bands of 4 (two minima and two maxima, of four permutations), two sets of similarity 0.75
share no bucket with a probability of about 2.6e-7 (bands agree with a probability of 0.316, measured for 3 of 4, 9 of
12 and 90 of 120 shared items; less above it). Sets of at most 11 items together are linked exactly: each also names
the buckets of its subsets that lack up to two items.

Null or empty texts have an empty set and are linked with nothing. Rows that repeat a doc_id belong
together; a row with a null doc_id is linked with nothing, its component is null and it is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import chunks, mix, word_hashes
from tessera.llm.common import LOWER_BYTES, written
from tessera.llm.components import connected_components


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    words, firsts = word_hashes([t.translate(LOWER_BYTES) for t in texts])
    rolled = np.zeros(len(words), np.uint64)
    for k in range(width):
        rolled[:max(len(words) - k, 0)] += mix(words[k:] + np.uint64(k + 1))
    rolled = mix(rolled)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        else:
            parts = mix(words[a:b] + np.arange(1, b - a + 1, dtype=np.uint64))
            out.append(mix(parts.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def band_names(sets: list[np.ndarray], multipliers: np.ndarray, shifts: np.ndarray, rows: int) -> np.ndarray:
    """One name per set and band, from the smallest and largest image under each permutation. Sets must not be empty."""
    items = np.concatenate(sets)
    firsts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    signature = np.empty((2 * len(multipliers), len(sets)), np.uint64)
    for k, (m, s) in enumerate(zip(multipliers, shifts)):
        image = items * m + s
        signature[2 * k] = np.minimum.reduceat(image, firsts)
        signature[2 * k + 1] = np.maximum.reduceat(image, firsts)
    bands = len(signature) // rows
    order = np.concatenate([np.arange(0, len(signature), 2), np.arange(1, len(signature), 2)])[:bands * rows].reshape(rows, bands)
    names = np.zeros((bands, len(sets)), np.uint64)
    for r in range(rows):
        # maxima are shifted, so that a band takes values of different permutations
        at = np.roll(order[r], -(7 * r - 1)) if 2 * r >= rows else order[r]
        names = mix(names + mix(signature[at]))
    return mix(names + np.arange(1, bands + 1, dtype=np.uint64)[:, None]).T.copy()


#: Two sets of at most so many items together differ in two items at most where they are similar (3 of 4).
SMALL = 11


def subset_names(items: np.ndarray) -> np.ndarray:
    """Names of a small set's subsets that lack none, one or two of its items."""
    parts = mix(items)
    total = parts.sum(dtype=np.uint64)
    i, j = np.triu_indices(len(parts), 1)
    sums = np.concatenate([[total], total - parts, total - parts[i] - parts[j]])
    sizes = np.concatenate([[len(parts)], np.full(len(parts), len(parts) - 1), np.full(len(i), len(parts) - 2)])
    return np.unique(mix(sums[sizes > 0] + np.uint64(77)))


def signed(docs: DataFrame, permutations: int, rows: int, width: int = 5, seed: int = 7) -> DataFrame:
    """(doc_id, class, n, bands): ``class`` is the digest of the lower-cased words, null without words."""
    rng = np.random.default_rng(seed)
    multipliers = rng.integers(0, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, permutations, dtype=np.uint64)
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi], width)
                full = [s for s in sets if len(s)]
                bands = band_names(full, multipliers, shifts, rows) if full else []
                names = iter([np.concatenate([x, subset_names(f)] if len(f) <= SMALL else [x]).view(np.int64).tolist() for x, f in zip(bands, full)])
                key = lambda t: hashlib.md5(b" ".join(t.translate(LOWER_BYTES).split()), usedforsecurity=False).digest()
                out = [(d, key(t) if len(s) else None, len(s), next(names) if len(s) else None) for d, t, s in zip(ids[lo:hi], texts[lo:hi], sets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, class binary, n long, bands array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, width: int = 5) -> DataFrame:
    """(node, items): the whole sets of the documents in ``nodes``, as sorted little-endian 64-bit values."""
    schema = pa.schema([("node", pa.int64()), ("items", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(texts):
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()),
                                                  pa.array([s.tobytes() for s in shingle_sets(texts[lo:hi], width)], pa.binary())], schema=schema)

    wanted = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    return wanted.mapInArrow(build, "node long, items binary").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those with 100 * |A and B| >= percent * |A or B|."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = ([np.frombuffer(x, np.uint64) for x in b.column(k).to_pylist()] for k in (2, 3))
            keep = []
            for x, y in zip(left, right):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    rows = (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
            .where(F.least(F.length("x"), F.length("y")) * 100 >= F.greatest(F.length("x"), F.length("y")) * percent)
            .select("a", "b", "x", "y"))
    return rows.mapInArrow(check, "a long, b long")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


#: Words of a set's bit map.
BIT_WORDS = 16
BITS = [f"b{k}" for k in range(BIT_WORDS)]


def set_facts(sets: DataFrame) -> DataFrame:
    """(node, n, own, b0, b1, ...): size, number of items that no other set here has, and a bit map of the items."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = np.zeros((b.num_rows, 64 * BIT_WORDS), np.uint8)
            sizes = []
            for k, x in enumerate(b.column(1).to_pylist()):
                items = np.frombuffer(x, np.uint64)
                maps[k, (items % np.uint64(64 * BIT_WORDS)).astype(np.int64)] = 1
                sizes.append(len(items))
            words = np.packbits(maps, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *(pa.array(words[:, k]) for k in range(BIT_WORDS))],
                                             names=["node", "n", *BITS])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            nodes = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in parts])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))], names=["node", "item"])

    own = (sets.mapInArrow(items, "node long, item long").groupBy("item").agg(F.count("*").alias("k"), F.min("node").alias("node"))
           .where("k = 1").groupBy("node").agg(F.count("*").alias("own")))
    return (sets.mapInArrow(facts, "node long, n long, " + ", ".join(f"{c} long" for c in BITS))
            .join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long"))))


def _mixed(open_members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their component, of buckets whose members lie in several; ``largest`` is the bucket's most frequent
    component and ``size`` its members. Where ``n`` and ``cap`` are known, members stay whose bucket holds a set of a
    size within their cap that has room for theirs."""
    at = open_members.drop("component", "largest", "size").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    bounded = "cap" in at.columns
    extra = [F.min("n").alias("lo"), F.max("cap").alias("hi")] if bounded else []
    outer = [F.min("lo").alias("lo"), F.max("hi").alias("hi")] if bounded else []
    sizes = at.groupBy("bucket", "component").agg(F.count("*").alias("n_members"), *extra)
    mixed = (sizes.groupBy("bucket").agg(F.max(F.struct("n_members", "component")).alias("top"), F.count("*").alias("parts"),
                                         F.sum("n_members").alias("size"), *outer)
             .where("parts > 1").select("bucket", F.col("top.component").alias("largest"), "size", *(["lo", "hi"] if bounded else [])))
    out = at.join(mixed, "bucket")
    return out.where("n <= hi and lo <= cap").drop("lo", "hi") if bounded else out


#: Members of a bucket that one task compares.
TASK_MEMBERS = 256


def near_links(members: DataFrame, sets: DataFrame, percent: int = 75, centres_a_round: int = 64) -> tuple[DataFrame, DataFrame]:
    """(links, labels) that join all documents of ``members`` (bucket, node) with a link in some bucket."""
    centres = members.groupBy("bucket").agg(F.min("node").alias("centre"))
    rest = members.join(centres, "bucket").where("node <> centre")
    pairs = written(rest.select(*_ordered("node", "centre")).distinct(), "pairs")
    links = written(confirmed(pairs, sets, percent), "links")
    labels = connected_components(links)
    at = written(_mixed(rest.select("bucket", "node"), labels).select("bucket", "node"), "open")
    if at.isEmpty():
        return links, labels
    # two sets need an intersection of percent / (100 + percent) of the sum of their sizes;
    # items that no other open set has are in no intersection, so a partner is no larger than ``cap``
    facts = written(set_facts(sets.join(at.select("node").distinct(), "node", "left_semi")), "facts")
    able = (facts.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
            .withColumn("cap", F.floor(((100 + percent) * (F.col("n") - F.col("own")) - percent * F.col("n")) / percent)))
    ones = lambda side: sum((F.bit_count(F.col(side + c)) for c in BITS), F.lit(0))
    both = sum((F.bit_count(F.col(c).bitwiseAND(F.col("c_" + c))) for c in BITS), F.lit(0))
    most = both + F.least(F.col("n") - F.col("ones"), F.col("c_n") - F.col("c_ones"))
    near = ((F.col("component") != F.col("c_component")) & (F.col("c_n") <= F.col("cap")) & (F.col("n") <= F.col("c_cap"))
            & ((100 + percent) * most >= percent * (F.col("n") + F.col("c_n"))))
    at, tried, turn = at.join(able.withColumn("ones", ones("")), "node"), pairs, centres_a_round
    facts_of = ("component", "n", "cap", "ones", *BITS)
    while True:
        at = written(_mixed(at, labels), "open")
        largest_bucket = at.agg(F.max("size")).first()[0]
        if largest_bucket is None:
            return links, labels
        tasks = F.ceil(F.col("size") / TASK_MEMBERS)
        its_turn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.col("size") < turn * (1 << 30)
        centre = (at.where((F.col("component") != F.col("largest")) & its_turn)
                  .select(F.col("bucket").alias("c_bucket"), F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("c_part"),
                          F.col("node").alias("c_node"), *(F.col(c).alias("c_" + c) for c in facts_of)))
        dealt = at.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), tasks))
        pairs = (dealt.join(centre, (F.col("bucket") == F.col("c_bucket")) & (F.col("part") == F.col("c_part")) & near)
                 .select(*_ordered("node", "c_node")).distinct().join(tried, ["a", "b"], "left_anti"))
        pairs = written(pairs, "pairs")
        more = written(confirmed(pairs, sets, percent), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = connected_components(links)
        if largest_bucket <= turn:
            return links, labels
        tried = tried.unionByName(pairs)
        turn *= centres_a_round


def near_duplicates(docs: DataFrame, permutations: int = 80, rows: int = 4, percent: int = 75, width: int = 5) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_shingles, component_id and kept."""
    all_rows = written(signed(docs, permutations, rows, width), "signed")
    known = all_rows.where("class is not null and doc_id is not null")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    named = classes.select("node", F.explode("bands").alias("bucket"))
    shared = named.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = written(named.join(shared, "bucket").select("bucket", "node").distinct(), "members")
    nodes = members.select("node").distinct()
    sets = written(sets_of(docs, nodes, width), "sets")
    links, labels = near_links(members, sets, percent)
    ids = classes.select("class", "node")
    # a doc_id that repeats with several texts ties its classes together
    several = known.groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("doc_id")
    ties = known.join(several, "doc_id").join(ids, "class").select(*_ordered("doc_id", "node")).where("a <> b").distinct()
    ties = written(ties, "ties")
    if not ties.isEmpty():
        labels = connected_components(links.unionByName(ties))
    labelled = ids.join(labels, "node", "left").select("class", F.coalesce("component", "node").alias("component_id"))
    out = all_rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")).join(labelled, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
