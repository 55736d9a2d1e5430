"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt at random (by a hash) into groups of about ``group_docs``; every group
is packed on its own, so no task ever sees more than a group. A document is cut into pieces
of ``length`` tokens; full pieces fill a sequence each, the remainders of a group are placed
longest first into the leftmost sequence with room, found by walking down a tree whose inner
nodes hold the largest free room below them.

A null text is empty: its document is one piece, the end token. Repeated rows are packed
once each (their hash also takes the task and counts the repeats in it, so copies spread over the groups).
Ties in length are broken by document id, start and hash. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Beyond these characters the two libraries could rest on different Unicode tables.
BEYOND = re.compile("[^\x00-ɏ]")
_ENCODERS: dict[str, object] = {}


class Encoder:
    """Token ids of the vocabulary file ``path`` (a tokenizers JSON), without special tokens around them.

    The same ranks and pattern run in tiktoken, which is about three times as fast; a text
    with characters beyond Latin, or with an added token like <|endoftext|> spelled out (which is
    that token to the library), goes to the tokenizers library itself, as does one that tiktoken cannot match.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.slow.get_added_tokens_decoder().values()]
        self.beyond = re.compile("|".join([BEYOND.pattern, *added]))
        ranks_path = re.sub(r"\.json$", ".tiktoken", path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.beyond.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its pattern matcher runs out of stack, as on very long runs of blanks
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("slot", pa.int64()), ("ids", pa.binary())])


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of (doc_id, text): start, length, doc_tokens, ``ids`` (little-endian uint32) and ``slot``,
    a hash that deals documents out at random."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, tail = encoder(tokenizer_path), Counter(), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = (encode(text).astype("<u4").tobytes() if text else b"") + tail
                n, crc = len(data) // 4, zlib.crc32(data)
                seen[doc, crc] += 1
                slot = zlib.crc32(f"{doc} {task} {seen[doc, crc]}".encode(), crc)
                for start in range(0, n, length):
                    part = data[4 * start:4 * (start + length)]
                    out.append((doc, start, len(part) // 4, n, slot, part))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, PIECES.types)], schema=PIECES)

    return (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        pieces, "doc_id long, start long, length long, doc_tokens long, slot long, ids binary"))


def first_fit_decreasing(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each of ``sizes``, which must be in falling order."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    free = [room] * (2 * leaves)  # free[1] is the root, free[leaves + b] bin b
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(room - free[node])
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins, offsets


def pack_pieces(pieces: DataFrame, n_docs: int, length: int = 2048, group_docs: int = 4096) -> DataFrame:
    """``pieces`` (at least doc_id, start, length, slot) with sequence_id and offset; other columns pass through."""
    groups = max(1, -(-n_docs // group_docs))
    keep = [c for c in pieces.columns if c != "slot"]

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("slot", "ascending")])
        group = group.take(order)
        bins, offsets = first_fit_decreasing(group.column("length").to_pylist(), length)
        first = key[0].as_py() << 32
        return (group.select(keep).append_column("sequence_id", pa.array([first + b for b in bins], pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in keep) + ", sequence_id long, offset long"
    return (pieces.withColumn("__group", F.col("slot") % groups)
            .groupBy("__group").applyInArrow(pack, schema))


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, group_docs: int = 4096) -> DataFrame:
    """Pieces with their token ids, packed."""
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, length, end_id), docs.count(), length, group_docs)
