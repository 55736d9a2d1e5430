"""Substring deduplication of words by recompression.

Rounds rename the sequence: first runs of two equal words, then pairs of a left and a right symbol (a bit
of each name decides which it is). Names are hashes of what they stand for, so all tasks give equal
substrings the same names, but for a few symbols at their ends. After ``r`` pair rounds a symbol spans at
most 2 ** (r + 1) words and depends on as many beyond its ends, so every window holds symbols that all its
occurrences share. The window's smallest such name is its anchor: shared names reveal repeated windows,
their surroundings and, at the edges of repeats, the windows' own digits verify them (see ``repeats``).

Every word covered by a window of ``width`` words that also starts anywhere else, in the same document or
another, is removed, at all its places. Words are runs of anything but ASCII white space, unchanged; kept
words are joined by one space. Null texts have no words; shorter documents stay whole. Rows that repeat
doc_id and text are one document and get the same result. Matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import mix, word_hashes
from tessera.llm.repeats import FULL, NO_ID, Scheme, cover_mask, with_cover


def _merged(names: np.ndarray, starts: np.ndarray, pair: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after those at ``pair`` (a mask) take up their right neighbours."""
    out = names.copy()
    at = np.flatnonzero(pair)
    out[at] = mix(mix(names[at] + np.uint64(tag)) * np.uint64(3) + names[at + 1])
    keep = np.ones(len(names), bool)
    keep[at + 1] = False
    return out[keep], starts[keep]


def recompress(names: np.ndarray, firsts: np.ndarray, pair_rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, starts) of the symbols after a round of runs and ``pair_rounds`` rounds of pairs."""
    n = len(names)
    ends = np.zeros(n + 1, bool)
    ends[firsts] = True  # a text begins here
    starts = np.arange(n)

    def beside(mask: np.ndarray) -> np.ndarray:
        """``mask`` over symbols and their right neighbours, both in the same text."""
        return np.append(mask & ~ends[starts[1:]], False)

    if n:
        same = beside(names[1:] == names[:-1])
        alone = same & ~np.concatenate([[False], same[:-1]]) & ~np.append(same[1:], False)
        names, starts = _merged(names, starts, alone, 1)
        for r in range(pair_rounds):
            left = (mix(names + np.uint64(17 + r)) & np.uint64(1)).astype(bool)
            names, starts = _merged(names, starts, beside(left[:-1] & ~left[1:]), 2 + r)
    return names, starts


def word_scheme(width: int = 35, pair_rounds: int = 1, digits: int = 2) -> Scheme:
    reach = 2 ** (pair_rounds + 1)  # words that a symbol spans, and words beyond its ends that it depends on
    first, last = reach, width - 2 * reach
    if last - first + 1 < reach:
        raise ValueError(f"windows of {width} words need fewer than {pair_rounds} pair rounds")

    def ranks(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        names, starts = recompress(values, firsts, pair_rounds)
        out = np.full(len(values), FULL)
        out[starts] = np.minimum(names, FULL - np.uint64(1))
        return out

    return Scheme(width, first, last, tuple(-(-width * (k + 1) // digits) for k in range(digits)), word_hashes, ranks, all_places=True)


def drop_repeated_words(docs: DataFrame, width: int = 35, pair_rounds: int = 1, digits: int = 2, chunk_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept string) of (doc_id, text)."""
    scheme = word_scheme(width, pair_rounds, digits)
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, around, window in zip(b.column(0).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(),
                                                 b.column(3).to_pylist(), b.column(4).to_pylist()):
                words = text.split()
                mask = cover_mask(scheme, len(words), around, window) if around or window else np.zeros(len(words), bool)
                kept = [w for w, m in zip(words, mask) if not m] if mask.any() else words
                out.append((doc, len(words), int(mask.sum()), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, schema.types)], schema=schema)

    cutting = with_cover(docs, scheme, chunk_bytes).mapInArrow(cut, "doc long, n_words long, n_removed long, kept string")
    return cutting.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept")
