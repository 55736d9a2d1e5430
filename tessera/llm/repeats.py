"""Windows of fixed width that occur more than once, over a whole corpus, without a row per position.

Shared by the byte and the word operator. A sequence is an array of 64-bit symbols (bytes or words).

1. Every window picks one anchor inside it, by its content alone, so equal windows pick the same place.
   All windows that can pick an anchor at p lie in [p - last, p - first + width), its surroundings; all of
   them contain [p - first, p - last + width), its core. An anchor carries a hash of each.
2. Anchors are grouped by core, then by surroundings. Equal surroundings mean that every window through
   the anchor is repeated, so all such places but the first are settled at once. Before the shuffle a task
   keeps one anchor per surroundings it has seen: a passage that a third of all documents share sends one
   row per task, and its other places are settled where they were read.
3. Where one core has several surroundings (the edges of a repeat), one place of each goes on, if it shares
   the left or the right half of its surroundings, too: the windows on that side that pick it meet in most-significant-digit passes, which refine groups of equal prefixes and drop groups
   of one; after the last digit a group holds the equal windows.
4. Places are gathered by shards of documents, and become a mask of each document.

A document is (doc_id, tie), tie being a hash of its text: rows that repeat both are one document. The
order is by doc_id (null first), tie, position. Arrays travel as binary columns, one row per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import BASE, chunks, mix
from tessera.llm.common import written

NO_ID = -(2**63)
FULL = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Scheme:
    """How sequences are made and where anchors lie."""

    width: int
    first: int
    last: int
    #: prefix lengths of a window, the last being the window: where a radix pass ends
    digits: tuple[int, ...]
    #: texts -> (symbols of all texts, first symbol of each text and the end)
    sequence: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    #: (symbols, firsts) -> rank of every position as an anchor, FULL where there is none
    ranks: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: whether the first place of a repeated window is covered too
    all_places: bool

    @property
    def core(self) -> int:
        return self.width - self.last + self.first

    @property
    def half(self) -> int:
        """Windows that begin at least so far before their anchor hold its left side, the others its right side."""
        return (self.first + self.last) // 2


def rolled(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` symbols, by doubling."""
    power, span, out, done, base = int(BASE), 1, None, 0, values
    todo = length
    while todo:
        if todo & 1:
            part = base[done:]
            if out is None:
                out = part
            else:
                n = min(len(out), len(part))
                out = out[:n] * np.uint64(power) + part[:n]
            done += span
        todo >>= 1
        if todo:
            base = base[:max(len(base) - span, 0)] * np.uint64(power) + base[span:]
            power = power * power % 2**64
            span *= 2
    return out[:max(len(values) - length + 1, 0)]


def slide(values: np.ndarray, length: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over every run of ``length`` values."""
    span = 1
    while 2 * span <= length:
        values = op(values[:-span], values[span:])
        span *= 2
    return op(values[:len(values) - (length - span)], values[length - span:]) if length > span else values


def window_starts(n: int, firsts: np.ndarray, width: int) -> np.ndarray:
    """Mask of the positions where a whole window of one document begins."""
    ok = np.zeros(n, np.int8)
    lengths = np.diff(firsts)
    long = lengths >= width
    np.add.at(ok, firsts[:-1][long], 1)
    stop = firsts[1:][long] - width + 1
    np.add.at(ok, stop[stop < n], -1)
    return np.cumsum(ok, dtype=np.int8).astype(bool)


def picks(scheme: Scheme, values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of every position, smallest rank in [start + first, start + last] of every window; 0 where no whole window starts)."""
    n, w = len(values), scheme.width
    if n < w:
        return np.full(n, FULL), np.zeros(0, np.uint64)
    ranks = scheme.ranks(values, firsts)
    ranks = np.concatenate([ranks, np.full(n - len(ranks), FULL)])
    least = least_in(scheme, ranks, scheme.first, scheme.last)
    return ranks, np.where(window_starts(n, firsts, w)[:len(least)], least, np.uint64(0))


def least_in(scheme: Scheme, ranks: np.ndarray, first: int, last: int) -> np.ndarray:
    """Smallest rank in [start + first, start + last] of every window."""
    return slide(ranks, last - first + 1, np.minimum)[first:first + len(ranks) - scheme.width + 1]


def anchor_places(scheme: Scheme, values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions that some whole window picks."""
    ranks, least = picks(scheme, values, firsts)
    n = len(ranks)
    padded = np.concatenate([np.zeros(scheme.last, np.uint64), least, np.zeros(n + scheme.last, np.uint64)])
    most = slide(padded, scheme.last - scheme.first + 1, np.maximum)[:n]
    return np.flatnonzero((most > 0) & (ranks == most) & (ranks != FULL))


def windows_at(scheme: Scheme, values: np.ndarray, firsts: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Starts of the windows that pick one of the anchors ``left`` and hold its left side, or one of ``right`` and its right side."""
    ranks, least = picks(scheme, values, firsts)
    if not len(least):
        return np.zeros(0, np.int64)
    wanted = np.zeros(len(least), bool)
    for anchors, lo, hi in ((left, scheme.half, scheme.last), (right, scheme.first, scheme.half)):
        own = np.full(len(ranks), FULL)
        own[anchors] = ranks[anchors]
        wanted |= least_in(scheme, own, lo, hi) == least
    return np.flatnonzero((least > 0) & wanted)


def anchors_of(scheme: Scheme, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, place in the text, core hash, surroundings hash, note of both sides) of every anchor."""
    values, firsts = scheme.sequence(texts)
    places = anchor_places(scheme, values, firsts)
    if not len(places):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.uint64, np.uint64, np.uint32))
    which = np.searchsorted(firsts, places, "right") - 1
    cores = rolled(values, scheme.core)
    lo = np.maximum(firsts[which], places - scheme.last)
    hi = np.minimum(firsts[which + 1], places - scheme.first + scheme.width)
    around = mix((places - lo).astype(np.uint64) * np.uint64(1 << 32) + (hi - places).astype(np.uint64))
    for at in range(0, scheme.width + scheme.last - scheme.first, scheme.core):
        around = mix(around * BASE + cores[np.clip(places - scheme.last + at, lo, hi - scheme.core)])
    note = np.zeros(len(places), np.uint32)
    # a side is 15 bits of a hash, never 0; 0 stands for a side that the document cuts off: no window holds it
    for shift, a, b in ((1, -scheme.half, scheme.width - scheme.last), (16, -scheme.first, scheme.width - scheme.half)):
        whole = (places + a >= lo) & (places + b <= hi)
        side = mix(rolled(values, b - a)[places[whole] + a]) >> np.uint64(49)
        note[whole] |= np.maximum(side, np.uint64(1)).astype(np.uint32) << np.uint32(shift)
    return which, (places - firsts[which]).astype(np.int32), mix(cores[places - scheme.first]), around, note


def shared_side(group: np.ndarray, note: np.ndarray, shift: int) -> np.ndarray:
    """Mask of the rows whose side (of ``note``, at ``shift``) another row of the same group has."""
    side = (note >> np.uint32(shift)) & np.uint32(0x7FFF)
    order = np.lexsort((side, group))
    cuts = np.flatnonzero(_edges(group[order], side[order]))
    size = np.diff(np.append(cuts, len(order)))
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(size > 1, size)
    return out & (side > 0)


def digits_of(scheme: Scheme, values: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Hashes of the windows' prefixes: 32 bits where a pass ends, 64 bits of the whole window."""
    hashes = [mix(rolled(values, n)[starts] + np.uint64(n)) for n in scheme.digits]
    return [h >> np.uint64(32) for h in hashes[:-1]] + hashes[-1:]


# -- grouping ---------------------------------------------------------------------------

def _edges(*columns: np.ndarray) -> np.ndarray:
    """Mask of the rows that differ from the row before them."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def equal_groups(digits: list[np.ndarray], always: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes: (rows, their group) of all groups of two or more equal digit strings, or with ``always``."""
    rows, group = np.arange(len(always)), np.zeros(len(always), np.int64)
    for d in digits:
        order = np.lexsort((d[rows], group))
        rows, group = rows[order], group[order]
        group = np.cumsum(_edges(group, d[rows])) - 1
        size = np.bincount(group)
        keep = (size[group] > 1) | always[rows]
        rows, group = rows[keep], group[keep]
    return rows, group


@dataclass
class Places:
    """Columns of places: digits (one array per digit), document, tie, position and note.

    Bit 0 of the note: the group was seen more than once; the other bits: an anchor's sides.
    """

    digits: list[np.ndarray]
    doc: np.ndarray
    tie: np.ndarray
    at: np.ndarray
    note: np.ndarray

    def take(self, rows: np.ndarray) -> Places:
        return Places([d[rows] for d in self.digits], self.doc[rows], self.tie[rows], self.at[rows], self.note[rows])

    @staticmethod
    def join(parts: list[Places], n_digits: int) -> Places:
        cat = lambda f, t: np.concatenate([np.zeros(0, t), *(f(p) for p in parts)])
        return Places([cat(lambda p, k=k: p.digits[k], np.uint64) for k in range(n_digits)], cat(lambda p: p.doc, np.int64),
                      cat(lambda p: p.tie, np.int64), cat(lambda p: p.at, np.int32), cat(lambda p: p.note, np.uint32))

    def binaries(self, types: list[type]) -> dict[str, bytes]:
        """In document order: each document once with its number of places, positions as steps."""
        p = self.take(np.lexsort((self.at, self.tie, self.doc)))
        new = np.flatnonzero(_edges(p.doc, p.tie))
        steps = np.diff(p.at, prepend=np.int32(0))
        steps[new] = p.at[new]
        return {"digits": b"".join(d.astype(t).tobytes() for d, t in zip(p.digits, types)), "doc": p.doc[new].tobytes(), "tie": p.tie[new].tobytes(),
                "counts": np.diff(np.append(new, len(p.doc))).astype(np.int32).tobytes(), "steps": steps.tobytes(), "note": p.note.tobytes()}

    @staticmethod
    def of(row: dict, types: list[type]) -> Places:
        counts, steps = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["steps"], np.int32)
        total = np.cumsum(steps, dtype=np.int64)
        first = np.cumsum(counts) - counts
        at = (total - np.repeat(total[first] - steps[first], counts)).astype(np.int32)
        digits, done = [], 0
        for t in types:
            size = np.dtype(t).itemsize * len(steps)
            digits.append(np.frombuffer(row["digits"][done:done + size], t).astype(np.uint64))
            done += size
        return Places(digits, np.repeat(np.frombuffer(row["doc"], np.int64), counts), np.repeat(np.frombuffer(row["tie"], np.int64), counts),
                      at, np.frombuffer(row["note"], np.uint32))


def settle(p: Places, all_places: bool) -> tuple[Places, Places]:
    """(covered, firsts) of the groups of equal digits; a place that repeats is one place.

    ``firsts`` holds the first place of every group, bit 0 of its note set if the group has more.
    """
    p = p.take(np.lexsort((p.at, p.tie, p.doc, *p.digits[::-1])))
    once = np.flatnonzero(_edges(*p.digits, p.doc, p.tie, p.at))
    if len(once) < len(p.doc):
        note = np.bitwise_or.reduceat(p.note, once)
        p = p.take(once)
        p.note = note
    new = _edges(*p.digits)
    at = np.flatnonzero(new)
    if not len(at):
        return p, p
    size = np.diff(np.append(at, len(new)))
    many = (size > 1) | (np.bitwise_or.reduceat(p.note & np.uint32(1), at) > 0)
    firsts = p.take(at)
    firsts.note = firsts.note | many.astype(np.uint32)
    covered = np.repeat(many, size) if all_places else ~new
    return p.take(np.flatnonzero(covered)), firsts


SENT = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("digits", "doc", "tie", "counts", "steps", "note"))])
SENT_SQL = "bucket long, digits binary, doc binary, tie binary, counts binary, steps binary, note binary"
FOUND = pa.schema([("shard", pa.int64()), ("kind", pa.string()), *((c, pa.binary()) for c in ("doc", "tie", "counts", "steps", "note"))])
FOUND_SQL = "shard long, kind string, doc binary, tie binary, counts binary, steps binary, note binary"
GATHERED = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), *((c, pa.binary()) for c in ("around", "window", "left", "right"))])
GATHERED_SQL = "doc long, tie long, around binary, window binary, left binary, right binary"
#: Digits of an anchor: its core and its surroundings.
ANCHOR_TYPES = [np.uint64, np.uint64]


def _send(p: Places, types: list[type], all_places: bool, buckets: int, dealt: Callable[[Places], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Collapse a task's places: one row per bucket with the first place of each group, and one with the covered places."""
    covered, firsts = settle(p, all_places)
    out = []
    if len(covered.doc):
        bare = Places([], covered.doc, covered.tie, covered.at, np.zeros(len(covered.doc), np.uint32))
        out.append({"bucket": -1 - int(abs(int(covered.tie[0])) % buckets), **bare.binaries([])})
    which = (dealt(firsts) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(_edges(which[order]))
    for a, b in zip(cuts, [*cuts[1:], len(which)]):
        out.append({"bucket": int(which[order[a]]), **firsts.take(order[a:b]).binaries(types)})
    if out:
        yield pa.RecordBatch.from_pylist(out, SENT)


def _by_shard(kind: str, p: Places, shards: int) -> list[dict]:
    """Rows of places, one per shard of documents."""
    shard = (mix(p.tie.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(_edges(shard[order]))
    return [{"shard": int(shard[order[a]]), "kind": kind, **Places([], p.doc, p.tie, p.at, np.zeros(len(p.doc), np.uint32)).take(order[a:b]).binaries([])}
            for a, b in zip(cuts, [*cuts[1:], len(order)])]


def _grouped(sent: DataFrame, types: list[type], all_places: bool, kind: str, shards: int) -> DataFrame:
    """Settle every bucket. Covered places are reported under ``kind``; of anchors, the edges under ``left`` and ``right``."""

    def reduce(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return pa.Table.from_pylist([x for r in rows.to_pylist() for x in _by_shard(kind, Places.of(r | {"digits": b""}, []), shards)], FOUND)
        p = Places.join([Places.of(r, types) for r in rows.to_pylist()], len(types))
        passes = p.digits[:1] if kind == "around" else p.digits
        kept, _ = equal_groups(passes, (p.note & np.uint32(1)) > 0)
        covered, firsts = settle(p.take(np.sort(kept)), all_places)
        out = _by_shard(kind, covered, shards)
        if kind == "around":
            group = np.cumsum(_edges(firsts.digits[0]))
            for side, shift in (("left", 1), ("right", 16)):
                out += _by_shard(side, firsts.take(np.flatnonzero(shared_side(group, firsts.note, shift))), shards)
        return pa.Table.from_pylist(out, FOUND)

    return sent.groupBy("bucket").applyInArrow(reduce, FOUND_SQL)


def _gathered(found: DataFrame) -> DataFrame:
    """One row per document with its places of each kind, as little-endian 32-bit positions (null: none)."""

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        by_doc: dict[tuple[int, int], dict[str, list[bytes]]] = {}
        for r in rows.to_pylist():
            p = Places.of(r | {"digits": b""}, [])
            cuts = np.flatnonzero(_edges(p.doc, p.tie))
            for a, b in zip(cuts, [*cuts[1:], len(p.doc)]):
                by_doc.setdefault((int(p.doc[a]), int(p.tie[a])), {}).setdefault(r["kind"], []).append(p.at[a:b].tobytes())
        return pa.Table.from_pylist([{"doc": d, "tie": t} | {k: b"".join(x) for k, x in kinds.items()} for (d, t), kinds in by_doc.items()], GATHERED)

    return found.groupBy("shard").applyInArrow(gather, GATHERED_SQL)


# -- the job ---------------------------------------------------------------------------

def _collected(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows (doc, tie, text, ...) in document order, about ``most`` bytes of text at a time, each document once."""
    held, size = [], 0
    def ready():
        held.sort(key=lambda r: r[:2])
        return [r for k, r in enumerate(held) if not k or r[:2] != held[k - 1][:2]]

    for b in batches:
        columns = [b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), *(c.to_pylist() for c in b.columns[3:])]
        for row in zip(*columns):
            held.append((row[0], row[1], row[2] or b"", *row[3:]))
            size += len(held[-1][2])
            if size >= most:
                yield ready()
                held.clear()
                size = 0
    if held:
        yield ready()


def covered_places(docs: DataFrame, scheme: Scheme, chunk_bytes: int = 32 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """(doc, tie, around, window) of ``docs`` (doc, tie, text): anchors whose surroundings are covered, and starts of covered windows."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _collected(batches, chunk_bytes):
            parts = []
            for lo, hi in chunks([r[2] for r in rows]):
                which, at, core, around, note = anchors_of(scheme, [r[2] for r in rows[lo:hi]])
                doc, tie = (np.array([r[k] for r in rows[lo:hi]], np.int64)[which] for k in (0, 1))
                parts.append(Places([core, around], doc, tie, at, note))
            yield from _send(Places.join(parts, 2), ANCHOR_TYPES, scheme.all_places, buckets, lambda p: p.digits[0])

    settled = written(_grouped(docs.mapInArrow(anchors, SENT_SQL), ANCHOR_TYPES, scheme.all_places, "around", buckets), "anchors")
    edges = _gathered(settled.where("kind <> 'around'")).select("doc", "tie", "left", "right")
    types = [np.uint32] * (len(scheme.digits) - 1) + [np.uint64]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _collected(batches, chunk_bytes):
            parts = []
            for lo, hi in chunks([r[2] for r in rows]):
                values, firsts = scheme.sequence([r[2] for r in rows[lo:hi]])
                sides = [np.concatenate([np.frombuffer(r[c] or b"", np.int32) + firsts[k] for k, r in enumerate(rows[lo:hi])]) for c in (3, 4)]
                starts = windows_at(scheme, values, firsts, *sides)
                if len(starts):
                    which = np.searchsorted(firsts, starts, "right") - 1
                    doc, tie = (np.array([r[k] for r in rows[lo:hi]], np.int64)[which] for k in (0, 1))
                    parts.append(Places(digits_of(scheme, values, starts), doc, tie, (starts - firsts[which]).astype(np.int32), np.zeros(len(starts), np.uint32)))
            # dealt by the whole window, so that a frequent first digit does not fill one bucket
            yield from _send(Places.join(parts, len(types)), types, scheme.all_places, buckets, lambda p: p.digits[-1])

    at_edges = docs.join(edges, ["doc", "tie"]).select("doc", "tie", "text", "left", "right")
    exact = _grouped(at_edges.mapInArrow(windows, SENT_SQL), types, scheme.all_places, "window", buckets)
    return _gathered(settled.where("kind = 'around'").unionByName(exact)).select("doc", "tie", "around", "window")


def cover_mask(scheme: Scheme, n: int, around: bytes | None, window: bytes | None) -> np.ndarray:
    """Mask of the covered symbols of a sequence of ``n``."""
    steps = np.zeros(n + 1, np.int64)
    p, w = (np.frombuffer(x or b"", np.int32).astype(np.int64) for x in (around, window))
    for lo, hi in ((p - scheme.last, p - scheme.first + scheme.width), (w, w + scheme.width)):
        np.add.at(steps, np.clip(lo, 0, n), 1)
        np.add.at(steps, np.clip(hi, 0, n), -1)
    return np.cumsum(steps[:-1]) > 0


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, tie, text) of (doc_id, text)."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc", F.xxhash64("text").alias("tie"), "text")


def with_cover(docs: DataFrame, scheme: Scheme, chunk_bytes: int = 32 << 20) -> DataFrame:
    """``keyed(docs)`` with the binary columns ``around`` and ``window`` (null where nothing is covered)."""
    rows = keyed(docs)
    return rows.join(covered_places(rows, scheme, chunk_bytes), ["doc", "tie"], "left").select("doc", "tie", "text", "around", "window")
