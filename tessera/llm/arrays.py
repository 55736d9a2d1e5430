"""Vectorised hashing of the words and bytes of a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.default_rng(20_240_229)
#: Random 64-bit values of the byte values, and an odd base.
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), BASE, np.uint64), dtype=np.uint64)])


def chunks(texts: list, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes, one text at least."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= most:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of all texts, and each text's first word (one more at the end)."""
    joined = b"\n".join(texts) + b"\n"
    a = np.frombuffer(joined, np.uint8)
    space = IS_SPACE[a]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) if texts else np.zeros(0, np.int64)
    firsts = np.concatenate([[0], np.searchsorted(starts, ends)])
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    begin = np.zeros(len(a), np.int64)
    begin[starts] = starts
    place = np.arange(len(a)) - np.maximum.accumulate(begin)
    place[space] = 0
    values = BYTE_VALUES[a] * powers(int(place.max()) + 1)[place]
    values[space] = 0
    return mix(np.add.reduceat(values, starts)), firsts
