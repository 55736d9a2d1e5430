"""Data-set shaping: ragged union, replication, counting, exact and approximate scale-down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def union_ragged(dfs: Sequence[DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """Union by column name; columns missing from a frame are NULL.
    An empty list gives an empty frame (needs ``spark``)."""
    dfs = list(dfs)
    if not dfs:
        if spark is None:
            raise ValueError("union_ragged of no frames needs a session")
        return spark.createDataFrame([], T.StructType([]))
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def replicate(df: DataFrame, copies: int, copy_col: str | None = None) -> DataFrame:
    """Bag union of ``copies`` copies of df (copies=3 is the original plus two).

    One scan: every row is exploded into ``copies`` rows instead of scanning
    the source once per copy. ``copy_col`` keeps the copy number (1-based).
    """
    if copies < 1:
        raise ValueError("copies must be >= 1")
    if copies == 1:
        return df
    name = copy_col or "__copy"
    out = df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return out if copy_col else out.drop(name)


def count_rows(df: DataFrame, name: str = "num_rows") -> DataFrame:
    """One-row frame with the row count (partial counts per task, one final sum)."""
    return df.agg(F.count(F.lit(1)).alias(name))


def _sort_key(key: Sequence[str]):
    return F.struct(*[F.col(c) for c in key])


def _key_literal(df: DataFrame, key: Sequence[str], value) -> Column:
    return F.struct(*[F.lit(value[i]).cast(df.schema[c].dataType).alias(c) for i, c in enumerate(key)])


#: Rows whose keys one task may rank, sampled keys of a sketch, and sub-ranges that one pass counts.
TASK_KEYS, SKETCH_KEYS, SUB_RANGES = 1_000_000, 100_000, 255


def nth_key(df: DataFrame, key: Sequence[str], n: int, total: int, task_keys: int = TASK_KEYS, sketch_keys: int = SKETCH_KEYS) -> tuple:
    """(key, rows with it, how many of them belong to the first ``n``) of the ``n``-th of ``total`` rows in key order.

    No sort or shuffle of all keys. A row sample of about ``sketch_keys`` keys is a quantile sketch: its points around
    the wanted quantile (5 standard errors to either side) bracket the key. One pass then counts the rows below the
    bracket, in each of its sub-ranges and on each of its points, a row of counts per task. So the rows that can hold
    the key shrink to a sub-range, about 1/16,000 of them, or to a point, which ends it (many ties). Once at most
    ``task_keys`` rows are left, their keys are counted and ranked. A poor sample costs a further pass, never the result.
    """
    k = _sort_key(key)
    inside, rank, size, seed = df.select(k.alias("__k")), n, total, 0
    while size > task_keys:
        seed += 1
        points = sorted_keys(inside.sample(min(1.0, sketch_keys / size), seed))
        at, spread_of = rank / size * len(points), 5 * max(1.0, len(points) * rank / size * (1 - rank / size)) ** 0.5
        near = points[max(0, int(at - spread_of)):int(at + spread_of) + 1]
        step = max(1, -(-len(near) // SUB_RANGES))
        edges = list(dict.fromkeys(near[::step]))
        literal = [_key_literal(df, key, e) for e in edges]
        if not edges:
            continue
        # 2 * i: strictly between edge i - 1 and edge i; 2 * i + 1: on edge i
        below = F.size(F.filter(F.array(*literal), lambda e: e < F.col("__k")))
        part = (F.when(F.col("__k") < literal[0], 0).when(F.col("__k") > literal[-1], 2 * len(edges))
                .otherwise(2 * below + F.exists(F.array(*literal), lambda e: e == F.col("__k")).cast("int")))
        counts = {r[0]: r[1] for r in inside.groupBy(part.alias("p")).agg(F.count("*")).collect()}
        for p in sorted(counts):
            if counts[p] >= rank:
                break
            rank -= counts[p]
        i = p // 2
        if p % 2:
            return edges[i], counts[p], rank
        if i > 0:
            inside = inside.where(F.col("__k") > literal[i - 1])
        if i < len(edges):
            inside = inside.where(F.col("__k") < literal[i])
        size = counts[p]
    # at most ``task_keys`` rows: ranked by a running count over their distinct keys
    counted = inside.groupBy("__k").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("upto", F.sum("n").over(Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)))
    row = ranked.where(F.col("upto") >= rank).orderBy("__k").first()
    return tuple(row["__k"]), row["n"], rank - (row["upto"] - row["n"])


def sorted_keys(keys: DataFrame) -> list[tuple]:
    """The keys of a bounded sample in Spark's order."""
    return [tuple(r["__k"]) for r in keys.orderBy("__k").collect()]


def take_fraction(df: DataFrame, scale: float, key: Sequence[str], task_keys: int = TASK_KEYS, sketch_keys: int = SKETCH_KEYS) -> DataFrame:
    """The first ``int(total * scale)`` rows in ``key`` order, exactly.

    Of rows that tie at the cut-off key any are taken, as many as are wanted. Instead of ``orderBy(key).limit(n)`` (which
    funnels n rows through one task) the cut-off key is found by a sketch and filtered passes (``nth_key``), and the
    result is a plain filter ``key <= cutoff`` over the source.
    """
    if not 0.0 <= scale <= 1.0:
        raise ValueError("scale must be within [0, 1]")
    key = list(key)
    total = df.count()
    n = int(total * scale)
    if n >= total:
        return df
    if n <= 0:
        return df.limit(0)
    cutoff, ties, wanted = nth_key(df, key, n, total, task_keys, sketch_keys)
    lit_key = _key_literal(df, key, cutoff)
    if wanted == ties:
        return df.filter(_sort_key(key) <= lit_key)
    return df.filter(_sort_key(key) < lit_key).unionByName(df.filter(_sort_key(key) == lit_key).limit(wanted))


#: Keys map to this many equally likely numbers: 15 hexadecimal digits.
HASH_RANGE = 1 << 60


def key_number(key: Sequence[str], seed: int = 0) -> Column:
    """A number in [0, 2**60) that follows from the key alone (MD5 of its columns as text; NULL differs from empty)."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in key]
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def sample_fraction(df: DataFrame, scale: float, key: Sequence[str], seed: int = 0) -> DataFrame:
    """About ``scale`` of the rows: those whose key's number lies below that share of its range.

    A narrow filter: nothing is counted, sorted or shuffled. Whether a row is taken follows from its key alone, so it is
    the same in a repeated task, in every partitioning and after rows are added; a larger scale takes a superset. The
    number taken has a standard error of sqrt(n * scale * (1 - scale)) over n distinct keys; rows that share a key are
    taken together.
    """
    if not 0.0 <= scale <= 1.0:
        raise ValueError("scale must be within [0, 1]")
    return df.filter(key_number(key, seed) < int(scale * HASH_RANGE))


def spread(df: DataFrame, key: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Spread a CPU-heavy row-wise plan over ``partitions`` tasks, as the caller asks.

    For an input with too few splits (one large file with a single row group): the rows are
    hash-partitioned by ``key`` (or round-robin without a key). Hash partitioning on a unique key is
    deterministic, so a re-computed partition after an executor loss holds the same rows. Without
    ``partitions`` the frame is returned unchanged; nothing is decided from the input's size.
    """
    if partitions is None:
        return df
    return df.repartition(partitions, *[F.col(c) for c in key]) if key else df.repartition(partitions)
