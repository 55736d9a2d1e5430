"""Document quality by a regularised quadratic discriminant over text statistics.

Every text becomes a short vector of transformed statistics (lengths, shares of characters, repeated words and
lines), computed in one pass over the whole text. Per class, Spark adds up counts, sums and outer products of all
labelled training rows; the class covariances are shrunk towards the pooled one, and that towards its diagonal, which
keeps them invertible with few rows of a class. Their Cholesky factors are computed once on the driver (a matrix of
the statistics' number squared, whatever the corpus) and travel to the tasks, where the score is the difference of the
two log densities (squared Mahalanobis distances and log determinants) plus the log prior, mapped to 0..1 by a
logistic curve. The curve is fitted on at most ``calibration_rows`` training rows, those with the smallest hash
of doc_id and vector; each gets its difference from a model of the other folds (crc32 mod 5), so none is judged by itself.

Held out, and never used to learn, are rows with crc32(doc_id as text) mod 5 = 0. Null and empty texts have the
statistics of an empty text and a score like any other. A row with a null doc_id is scored and not held out. A
doc_id that repeats with one label is one training row per distinct text vector; a doc_id with differing labels, or a
null label, teaches nothing. With no labelled rows all scores are 0.5; with one class only they are the smoothed share
of label 1. Ties and repeated rows score alike, an empty table gives no rows, extra columns are not read.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_BYTES, first_by_hash, written

_ALL = bytes(range(256))


def _without(keep: bytes) -> bytes:
    return bytes(c for c in _ALL if c not in keep)


#: Bytes to delete so that only the named kind stays (counting by length).
_UPPER, _LOWER, _DIGITS = (_without(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
_VOWELS, _STOPS, _CALLS = _without(b"aeiouAEIOU"), _without(b".,;:"), _without(b"!?")
_SYMBOLS, _BLANKS = _without(b"#*$%&|<>@^~_=+\\/{}[]"), _without(b" \t\n\x0b\x0c\r")
_CAPITAL = re.compile(rb"\b[A-Z]")
_MORE = bytes(range(0x80, 0xC0))  # continuation bytes of UTF-8
_BEYOND = bytes(range(0x80, 256))
STATISTICS = ("words", "word_length", "upper", "symbols", "calls", "digits", "stops", "distinct", "adjacent", "pairs", "lines",
              "line_words", "foreign", "top", "short", "vowels", "blanks", "capital")


def statistics(text: bytes) -> list[float]:
    """Untransformed statistics of one text: counts and shares; an empty text gives zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    count = lambda others: len(text.translate(None, others))
    chars = len(text.translate(None, _MORE))
    upper, lower = count(_UPPER), count(_LOWER)
    words = text.translate(LOWER_BYTES).split()
    n = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    letters = max(1, upper + lower)
    return [
        len(words), chars / n, upper / letters, count(_SYMBOLS) / n, count(_CALLS) / n, count(_DIGITS) / max(1, chars), count(_STOPS) / n,
        len(seen) / n, sum(map(operator.eq, words, words[1:])) / n, pairs / max(1, len(words) - 1), len(set(lines)) / max(1, len(lines)),
        len(words) / max(1, len(lines)), (chars - len(text.translate(None, _BEYOND))) / max(1, chars),
        max(seen.values(), default=0) / n, sum(map((3).__ge__, map(len, words))) / n, count(_VOWELS) / letters, count(_BLANKS) / max(1, chars),
        len(_CAPITAL.findall(text)) / n]


def transformed(x: np.ndarray) -> np.ndarray:
    """Statistics on scales nearer to a normal law: logarithms of counts, square roots of shares; the last bits cut."""
    out = x.copy()
    for name in ("words", "line_words", "word_length", "symbols", "calls"):
        k = STATISTICS.index(name)
        out[:, k] = np.log1p(x[:, k])
    for name in ("upper", "digits", "adjacent", "foreign", "top"):
        k = STATISTICS.index(name)
        out[:, k] = np.sqrt(x[:, k])
    return np.round(out, 6)


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row: the transformed statistics of its whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            x = np.array([statistics(t.as_py() or b"") for t in texts]).reshape(-1, len(STATISTICS))
            flat = pa.array(transformed(x).ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(measure, "doc_id long, x array<double>")


def fold(c: Column) -> Column:
    """crc32(doc_id as text) mod 5; 0 is held out."""
    return F.crc32(c.cast("string").cast("binary")) % 5


def training_rows(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, fold, y, x) of the labelled rows outside the held-out fold, one per doc_id and vector."""
    agreed = (labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
              .where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("hi")).where("y = hi").select("doc_id", "y"))
    rows = measured.where("doc_id is not null").where(fold(F.col("doc_id")) != 0).distinct()
    return rows.join(agreed, "doc_id").select("doc_id", fold(F.col("doc_id")).alias("fold"), "y", "x")


Sums = tuple[int, np.ndarray, np.ndarray]


def class_sums(rows: DataFrame) -> dict[tuple[int, int], Sums]:
    """Per (fold, class): count, sum and sum of outer products; added up per batch in the tasks, then in Spark."""
    p = len(STATISTICS)
    size = (p + 1) ** 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for g in np.unique(group):
                m = np.column_stack([np.ones((group == g).sum()), x[group == g]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, g), pa.int32()), pa.array(np.arange(size), pa.int32()),
                                                  pa.array((m.T @ m).ravel())], names=["g", "cell", "v"])

    grouped = rows.select((F.col("fold") * 2 + F.col("y")).cast("int").alias("g"), "x")
    sums: dict[int, np.ndarray] = {}
    for r in grouped.mapInArrow(add, "g int, cell int, v double").groupBy("g", "cell").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r.g, np.zeros(size))[r.cell] = r.v
    squares = {divmod(g, 2): v.reshape(p + 1, p + 1) for g, v in sums.items()}
    return {k: (int(round(m[0, 0])), m[0, 1:], m[1:, 1:]) for k, m in squares.items()}


def merged(sums: dict[tuple[int, int], Sums], without: int | None = None) -> dict[int, Sums]:
    """Per class, the sums of all folds but one."""
    out: dict[int, Sums] = {}
    for (f, c), (n, s, outer) in sorted(sums.items()):
        if f != without:
            m = out.get(c, (0, 0.0, 0.0))
            out[c] = (m[0] + n, m[1] + s, m[2] + outer)
    return out


@dataclass
class Discriminant:
    """Per class the mean, the inverse of the Cholesky factor, and the constant of the log density; then the curve."""
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    constants: list[float]
    slope: float = 1.0
    offset: float = 0.0

    def differences(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        logs = [k - 0.5 * (((x - m) @ i.T) ** 2).sum(axis=1) for m, i, k in zip(self.means, self.inverses, self.constants)]
        return logs[1] - logs[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * self.differences(x) + self.offset, -30, 30))), 6)


@dataclass
class Constant:
    value: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def discriminant(sums: dict[int, Sums], pooled_share: float, diagonal_share: float) -> Discriminant:
    """Shrunken covariances of both classes and their Cholesky factors; a class of few rows is shrunk more."""
    total = sum(n for n, _, _ in sums.values())
    covariance = {c: outer / n - np.outer(s / n, s / n) for c, (n, s, outer) in sums.items()}
    pooled = sum(covariance[c] * sums[c][0] for c in (0, 1)) / total
    out = Discriminant([], [], [])
    for c in (0, 1):
        few = len(pooled) / (len(pooled) + sums[c][0])
        to_pooled, to_diagonal = max(pooled_share, few), max(diagonal_share, few)
        shrunk = (1 - to_pooled) * covariance[c] + to_pooled * pooled
        shrunk = (1 - to_diagonal) * shrunk + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
        factor = np.linalg.cholesky((shrunk + shrunk.T) / 2)
        out.means.append(sums[c][1] / sums[c][0])
        out.inverses.append(np.linalg.inv(factor))
        out.constants.append(float(np.log(sums[c][0] / total) - np.log(np.diag(factor)).sum()))
    return out


def curve(d: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve of label 1 over the differences, by Newton steps with a small penalty.

    The targets are smoothed by the class counts, so separable classes give a finite slope.
    """
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1.0, float(np.median(np.abs(d))))
    m = np.column_stack([d / scale, np.ones(len(d))])
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        grad = m.T @ (t - q) - 1e-3 * w
        hess = (m * (q * (1 - q))[:, None]).T @ m + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0] / scale), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def train(rows: DataFrame, pooled_share: float = 0.5, diagonal_share: float = 0.2, calibration_rows: int = 20_000) -> Discriminant | Constant:
    """The model of ``training_rows``: covariances of all their folds, and a curve over differences that each fold gets from the others."""
    sums = class_sums(rows)
    both = merged(sums)
    if len(both) < 2:
        n, ones = sum(s[0] for s in both.values()), both.get(1, (0,))[0]
        return Constant((ones + 1) / (n + 2))
    model = discriminant(both, pooled_share, diagonal_share)
    seen = first_by_hash(rows, ["doc_id", "x"], calibration_rows).collect()
    d, y = [], []
    for f in sorted({r.fold for r in seen}):
        others = merged(sums, f)
        if len(others) == 2:
            part = [r for r in seen if r.fold == f]
            d.append(discriminant(others, pooled_share, diagonal_share).differences(np.array([r.x for r in part])))
            y += [r.y for r in part]
    if 0 < sum(y) < len(y):
        model.slope, model.offset = curve(np.concatenate(d), np.array(y))
    return model


def scored(measured: DataFrame, model: Discriminant | Constant, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = measured.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(x))], names=["doc_id", "score"])

    out = measured.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with held_out, score and predicted, learnt from ``labels`` (doc_id, quality)."""
    measured = written(with_statistics(docs), "statistics")
    rows = written(training_rows(measured, labels), "training")
    return scored(measured, train(rows), threshold)
