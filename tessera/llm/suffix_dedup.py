"""Suffix-array deduplication of bytes by a depth-limited, most-significant-digit radix sort.

Suffixes are ordered only through their first ``width`` bytes: digits of ``width / digits`` bytes refine
groups of equal prefixes, groups of one are dropped, and after the last digit the groups are the repeated
windows. Sorting every suffix would move a hundred times the corpus, so suffixes enter only near anchors
(the smallest ``core``-byte hash of each window) whose core occurs more than once in different
surroundings; windows whose surroundings repeat as a whole are settled by those (see ``repeats``).

Every byte covered by a window that also starts earlier (smaller doc_id, or same document and earlier
start) is removed. Null texts are empty; documents shorter than the window stay whole. Rows that repeat
doc_id and text are one document and get the same result; of different texts under one doc_id, that with
the smaller hash comes first; a null doc_id comes before all others. Matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import BYTE_VALUES, mix
from tessera.llm.repeats import NO_ID, Scheme, cover_mask, rolled, with_cover


def _bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUES[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum([0, *map(len, texts)])


def byte_scheme(width: int = 100, core: int = 32, digits: int = 2) -> Scheme:
    def ranks(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return mix(rolled(values, core))

    prefixes = tuple(-(-width * (k + 1) // digits) for k in range(digits))
    return Scheme(width, 0, width - core, prefixes, _bytes, ranks, all_places=False)


def drop_repeated_bytes(docs: DataFrame, width: int = 100, core: int = 32, digits: int = 2, chunk_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of (doc_id, text)."""
    scheme = byte_scheme(width, core, digits)
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, around, window in zip(b.column(0).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(),
                                                 b.column(3).to_pylist(), b.column(4).to_pylist()):
                mask = cover_mask(scheme, len(text), around, window) if around or window else np.zeros(len(text), bool)
                spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                out.append((doc, len(text), int(mask.sum()), spans, np.frombuffer(text, np.uint8)[~mask].tobytes() if spans else text))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, schema.types)], schema=schema)

    cutting = with_cover(docs, scheme, chunk_bytes).mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cutting.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
