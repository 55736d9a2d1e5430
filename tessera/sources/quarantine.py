"""Read many result files; leave out, whole and by name, those that cannot be read.

Every file is read by one task, which either hands on all its rows or one report row: a broken archive, bytes that are
no UTF-8, a header other than expected, a record with too few or too many fields, a value of another type. A defect
never ends the job and never leaves half a file; a file of no bytes at all gives neither rows nor a report. The bytes of a file are unpacked and checked as a stream, once to check
and once more to hand the rows on, so a task holds a file's packed bytes and one batch of rows, not its text.
"""

from __future__ import annotations

import bz2
import csv
import io
import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.session import written

CHUNK = 1 << 20
BATCH = 5000
_WHOLE = re.compile(r"[+-]?[0-9]+")
_REAL = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|NaN|[+-]?Infinity")
_BOUNDS = {"int": 2**31, "bigint": 2**63}


def fits(value: str, kind: str) -> bool:
    """Whether a field is a value of the type; an empty field is NULL and fits."""
    if value == "" or kind == "string":
        return True
    if kind in _BOUNDS:
        return bool(_WHOLE.fullmatch(value)) and len(value) < 25 and -_BOUNDS[kind] <= int(value) < _BOUNDS[kind]
    if kind in ("double", "float"):
        return bool(_REAL.fullmatch(value))
    if kind == "boolean":
        return value.lower() in ("true", "false")
    raise ValueError(f"type {kind} is not supported here")


def _unpacked(content: bytes, path: str) -> Iterator[bytes]:
    """The bytes of a file, unpacked by its suffix; an archive that ends early raises."""
    if path.endswith(".gz"):
        rest: bytes | memoryview = memoryview(content)
        while len(rest):
            member, at = zlib.decompressobj(31), 0
            while not member.eof:
                if at >= len(rest):
                    raise EOFError("archive ends early")
                yield member.decompress(rest[at:at + CHUNK])
                at += CHUNK
            rest = rest[min(at, len(rest)) - len(member.unused_data):]
    elif path.endswith(".bz2"):
        archive = bz2.BZ2Decompressor()
        for at in range(0, len(content), CHUNK):
            yield archive.decompress(content[at:at + CHUNK])
        if not archive.eof:
            raise EOFError("archive ends early")
    else:
        for at in range(0, len(content), CHUNK):
            yield content[at:at + CHUNK]


class _Stream(io.RawIOBase):
    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.left = parts, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.left:
            part = next(self.parts, None)
            if part is None:
                return 0
            self.left = part
        n = min(len(buffer), len(self.left))
        buffer[:n], self.left = self.left[:n], self.left[n:]
        return n


def _records(content: bytes, path: str) -> Iterator[list[str]]:
    text = io.TextIOWrapper(io.BufferedReader(_Stream(_unpacked(content, path)), CHUNK), encoding="utf-8", errors="strict", newline="")
    csv.field_size_limit(2**31 - 1)
    return (r for r in csv.reader(text, strict=True) if r)


def defect(content: bytes, path: str, names: Sequence[str], kinds: Sequence[str]) -> str | None:
    """Why a file cannot be read with this header and these types; None if it can."""
    try:
        rows = _records(content, path)
        header = next(rows, None)
        if header is None:
            return "empty file"
        if header != list(names):
            return "unexpected header"
        for row in rows:
            if len(row) != len(kinds):
                return "wrong number of fields"
            if not all(map(fits, row, kinds)):
                return "value of another type"
    except (EOFError, zlib.error, OSError):
        return "broken archive"
    except UnicodeDecodeError:
        return "not UTF-8"
    except csv.Error:
        return "malformed record"
    return None


def read_or_report(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, glob: str = "*.csv*") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of RFC-4180 files with a header, searched below ``paths`` and through folders.

    ``rows`` has the columns of ``schema`` (string, int, bigint, float, double, boolean), ``source_file`` and ``log_dir``;
    ``rejected`` one row (source_file, log_dir, reason) per file left out. Files are read once: both come from one table
    written to the shared folder.
    """
    from tessera.sources.csv import parent_dir

    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, kinds = fields.names, [f.dataType.simpleString() for f in fields.fields]
    for k in kinds:
        fits("0", k)  # an unsupported type is refused before any file is read
    out = pa.schema([("source_file", pa.string()), ("reason", pa.string()), ("row", pa.list_(pa.string()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                name, data = path.as_py(), content.as_py()
                reason = defect(data, name, names, kinds)
                if reason:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([reason]), pa.array([None], out.field("row").type)], schema=out)
                    continue
                rows = _records(data, name)
                next(rows)
                more = True
                while more:
                    part = [[x or None for x in r] for _, r in zip(range(BATCH), rows)]
                    more = len(part) == BATCH
                    if part:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.nulls(len(part), pa.string()), pa.array(part, out.field("row").type)], schema=out)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
             .load(paths if isinstance(paths, str) else list(paths)).select("path", "content"))
    found = written(files.mapInArrow(read, "source_file string, reason string, row array<string>"), "read-or-report")
    rows = found.where("reason is null").select(*[F.get("row", F.lit(k)).cast(f.dataType).alias(f.name) for k, f in enumerate(fields.fields)],
                                                 "source_file", parent_dir(F.col("source_file")).alias("log_dir"))
    return rows, found.where("reason is not null").select("source_file", parent_dir(F.col("source_file")).alias("log_dir"), "reason")
