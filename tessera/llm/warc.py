"""WARC records in ZIP packages: writer, and a reader that never extracts.

A package holds the stored (uncompressed) members ``archive/data.warc.gz``, one gzip
member per record, and ``indexes/index.cdxj``, one JSON line per record with its place.
The reader parses the end of the file, the (ZIP64) central directory and the index by
range reads, and fetches only the byte ranges of the records.

Files are written straight to a shared folder under a name of their own per attempt; the
manifest names those of the attempts that succeeded, so a lost executor or a speculative
task leaves at most a file that nobody refers to.

A null html is an empty payload, a null url an empty target. Of equal payloads of at least
``min_bytes`` the rows with the largest page_id are responses (all rows that repeat that
page_id too), the others revisit it; a null page_id is smaller than any other. A payload is
held whole in memory, once; a package closes when it reaches ``package_bytes``.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MANIFEST = "path string, records long, bytes long"
RECORD = ("page_id long, record_type string, refers_to long, target_uri string, "
          "payload_length long, header_digest string, payload binary")
CHUNK = "path string, lo long, hi long, starts array<long>, lengths array<long>"
# fixed values of the ZIP format
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = (b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# -- writing ---------------------------------------------------------------------------

def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def with_roles(pages: DataFrame, min_bytes: int = 1000, hot_share: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, top, revisit): ``top`` is the page that a revisit refers to.

    Payloads are equal if their SHA-256 and size are. Groups of at least one row in ``hot_share`` number ``hot_share`` at
    most and are broadcast; the payloads of the others travel once, rows that can have no equal by a key of their own.
    """
    rows = (pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
            .withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
            .withColumn("same", F.when(F.col("size") >= min_bytes, F.sha2("payload", 256))))
    groups = written(rows.where("same is not null").groupBy("same", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
                     .where("n > 1"), "warc-groups")
    is_hot = F.col("n") * hot_share >= pages.count()
    hot = groups.where(is_hot).select("same", "size", F.col("top").alias("hot_top"), F.lit(True).alias("hot"))
    rest = groups.where(~is_hot).select(F.col("same").alias("meet"), "size", F.col("top").alias("own_top"))
    alone = F.col("same").isNull() | F.col("hot").isNotNull()
    return (rows.join(F.broadcast(hot), ["same", "size"], "left")
            .withColumn("meet", F.when(alone, F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("same")))
            .join(rest, ["meet", "size"], "left").withColumn("top", F.coalesce("hot_top", "own_top"))
            .withColumn("revisit", F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))))


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, top: int | None) -> bytes:
    """One gzip member; ``top`` is set for a revisit. The HTTP header keeps the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if top is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if top is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
            *([f"WARC-Refers-To: <urn:page:{top}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
              if top is not None else []),
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def package(records: list[bytes]) -> bytes:
    out, lines, at = io.BytesIO(), [], 0
    for r in records:
        lines.append(json.dumps({"offset": at, "length": len(r)}))
        at += len(r)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(DATA, "w", force_zip64=True) as f:
            for r in records:
                f.write(r)
        z.writestr(INDEX, "".join(x + "\n" for x in lines))
    return out.getvalue()


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 1000, package_bytes: int = 32 << 20) -> DataFrame:
    """Write every page and return the manifest (path, records, bytes), itself written to the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            name, data = f"{uuid.uuid4().hex}.wacz", package(held)
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            row = {"path": f"{folder}/{name}", "records": len(held), "bytes": len(data)}
            held.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        size = 0
        for b in batches:
            for row in b.to_pylist():
                held.append(warc_record(row["page_id"], row["url"], row["payload"], row["digest"],
                                        row["top"] if row["revisit"] else None))
                size += len(held[-1])
                if size >= package_bytes:
                    yield close()
                    size = 0
        if held:
            yield close()

    rows = with_roles(pages, min_bytes).select("page_id", "url", "payload", "digest", "top", "revisit")
    return written(rows.mapInArrow(write, MANIFEST), "warc-manifest")


# -- reading ---------------------------------------------------------------------------

def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (absolute start, length) of the stored members, from the central directory."""
    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    k = tail.rfind(EOCD)
    if k < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[k + 10:k + 20])
    if count == FULL16 or FULL32 in (length, start):
        if tail_at + k < 20 or (loc := at(tail_at + k - 20, 20))[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = at(struct.unpack("<Q", loc[8:16])[0], 56)
        if end64[:4] != EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", end64[32:56])
    directory, p, found = at(start, length), 0, {}
    for _ in range(count):
        if directory[p:p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", directory[p + 10:p + 12])
        packed, plain, n_name, n_extra, n_note = struct.unpack("<IIHHH", directory[p + 20:p + 34])
        where, = struct.unpack("<I", directory[p + 42:p + 46])
        name = directory[p + 46:p + 46 + n_name].decode()
        extra = directory[p + 46 + n_name:p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:  # ZIP64: only the fields that are full above, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4:4 + n // 8 * 8]))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                where = next(wide) if where == FULL32 else where
            extra = extra[4 + n:]
        if method == 0:
            local = at(where, 30)
            if local[:4] != LOCAL:
                raise ValueError("broken local header")
            found[name] = (where + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
        p += 46 + n_name + n_extra + n_note
    return found


def parse_record(member: bytes) -> dict:
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    full = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    revisit = fields["WARC-Type"] == "revisit"
    return {"page_id": page(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")),
            "target_uri": fields["WARC-Target-URI"], "payload_length": full,
            "header_digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), "payload": None if revisit else payload}


RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()),
                          ("payload_length", pa.int64()), ("header_digest", pa.string()), ("payload", pa.binary())])
CHUNK_ARROW = pa.schema([("path", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()),
                         ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


def record_ranges(manifest: DataFrame, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Byte ranges of whole records, about ``chunk_bytes`` each, from every package's directory and index."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    found = members(f, f.size())
                    f.seek(found[INDEX][0])
                    lines = f.read(found[INDEX][1]).splitlines()
                base, chunk = found[DATA][0], []
                for k, x in enumerate(map(json.loads, lines)):
                    chunk.append((base + x["offset"], x["length"]))
                    lo, hi = chunk[0][0], sum(chunk[-1])
                    if hi - lo >= chunk_bytes or k == len(lines) - 1:
                        yield pa.RecordBatch.from_pylist([{"path": path, "lo": lo, "hi": hi, "starts": [s for s, _ in chunk],
                                                           "lengths": [n for _, n in chunk]}], CHUNK_ARROW)
                        chunk = []

    return manifest.select("path").mapInArrow(locate, CHUNK)


def read_packages(manifest: DataFrame, chunk_bytes: int = 4 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """Every record of the packages in ``manifest``.

    The ranges are dealt out again before they are read, to as many tasks as the manifest's bytes ask for (a task reads
    about ``task_bytes``, one range at a time), and to every core where there are ranges enough.
    """
    size = manifest.agg(F.sum("bytes")).first()[0] or 0
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-size // task_bytes), min(cores, -(-size // chunk_bytes)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.to_pylist():
                fs, name = filesystem(c["path"])
                with fs.open_input_file(name) as f:
                    f.seek(c["lo"])
                    data = f.read(c["hi"] - c["lo"])
                yield pa.RecordBatch.from_pylist(
                    [parse_record(data[s - c["lo"]:s - c["lo"] + n]) for s, n in zip(c["starts"], c["lengths"])], RECORD_ARROW)

    return record_ranges(manifest, chunk_bytes).repartition(tasks, "path", "lo").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 1000, package_bytes: int = 32 << 20, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Write ``pages`` as packages into the shared folder and read every record back."""
    return read_packages(write_packages(pages, shared_path(pages.sparkSession, "warc"), min_bytes, package_bytes), chunk_bytes)
