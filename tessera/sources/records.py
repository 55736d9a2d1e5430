"""RFC-4180 CSV read in parallel: record boundaries from quote parity over file blocks.

A line break ends a record exactly where an even number of quotes lies before it in its file (doubled quotes count
twice, so they change nothing). The files are split into blocks like any text:

1. one aggregate adds up the quotes of every block, and a running sum over the blocks of a file says which blocks
   begin inside a quoted field. One row per block of a file with several blocks is all that is gathered; the driver
   passes it on to the tasks (a path a file, 9 bytes a block);
2. every task joins the lines of its blocks to records, beginning with that state. A record that crosses the edge of
   a block leaves its parts, at most two a block; only these are shuffled and joined in file order;
3. the records are parsed in the JVM.

The text is read twice, and the lines are joined a second time for the parts at the edges where a file has several
blocks. So a file with quoted line breaks takes as many tasks as it has blocks. Quotes must be those of RFC-4180: around a
field, and doubled inside.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

#: Kinds of rows that a task emits: whole records, the end of one begun before the block, a block without any record's
#: begin or end, and the begin of one that ends later.
RECORD, END, MIDDLE, BEGIN = 0, 1, 2, 3


def csv_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value, file, block): physical lines in file order within each block; a carriage return stays."""
    return (spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))


def block_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a quoted field is open where the block begins, for files with several blocks."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    of_file = Window.partitionBy("file")
    before = F.sum("quotes").over(of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return (blocks.select("file", "block", F.coalesce(before % 2 == 1, F.lit(False)).alias("inside"), F.max("block").over(of_file).alias("last"))
            .where("last > 0").select("file", "block", "inside"))


def _block_records(values: pa.Array, inside: bool) -> tuple[list[tuple[int, str]], bool]:
    """((kind, text) of one block's lines, whether a field is open at its end)."""
    quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
    open_after = (np.cumsum(quotes) + inside) % 2 == 1
    text = values.to_pylist()
    out: list[tuple[int, str]] = []
    first = 0
    for last in np.flatnonzero(~open_after).tolist():
        kind = END if inside and first == 0 else RECORD
        out.append((kind, text[first] if first == last else "\n".join(text[first:last + 1])))
        first = last + 1
    if first < len(text):
        out.append((MIDDLE if inside and first == 0 else BEGIN, "\n".join(text[first:])))
    return out, bool(open_after[-1])


def csv_records(spark: SparkSession, paths: str | Sequence[str], header: bool = True) -> DataFrame:
    """(file, record): the records of RFC-4180 files, quoted line breaks included; empty records are left out.

    With ``header`` each file's first record is left out.
    """
    lines = csv_lines(spark, paths)
    states: dict[str, tuple[list[int], list[bool]]] = {}
    for r in block_states(lines).orderBy("file", "block").toLocalIterator():
        starts, inside = states.setdefault(r.file, ([], []))
        starts.append(r.block)
        inside.append(r.inside)
    sent = spark.sparkContext.broadcast(states)
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("text", pa.string()), ("head", pa.bool_())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, seen, held = None, False, False, []  # the open block, its state, whether a record ended in it, lines of an open record

        def rows(kinds: list[tuple[int, str]], file: str, block: int) -> pa.RecordBatch:
            nonlocal seen
            head = []
            for kind, text in kinds:
                head.append(header and block == 0 and not seen)
                seen = seen or bool(text.strip("\r"))
            return pa.RecordBatch.from_arrays([pa.array([file] * len(kinds), pa.string()), pa.array([block] * len(kinds), pa.int64()),
                                               pa.array([k for k, _ in kinds], pa.int32()), pa.array([t for _, t in kinds], pa.string()),
                                               pa.array(head, pa.bool_())], schema=schema)

        carried = None  # kind of the record that ``held`` begins
        for b in batches:
            files, blocks = b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            names = files.to_pylist()
            edges = [0, *(k for k in range(1, b.num_rows) if blocks[k] != blocks[k - 1] or names[k] != names[k - 1]), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                place = names[lo], int(blocks[lo])
                if place != at:
                    if held:
                        yield rows([(carried, "\n".join(held))], *at)
                    at, held, seen = place, [], False
                    starts, states_of = sent.value.get(place[0], ([], []))
                    k = bisect_right(starts, place[1]) - 1
                    inside = k >= 0 and starts[k] == place[1] and states_of[k]
                    carried = MIDDLE if inside else BEGIN
                found, open_after = _block_records(b.column(0).slice(lo, hi - lo), inside)
                # the batch may cut a record of the block: its first part waits for the rest
                if held:
                    kind, text = found[0]
                    if kind == MIDDLE:
                        held.append(text)
                        found = []
                    else:
                        found[0] = (END if carried == MIDDLE else RECORD, "\n".join([*held, text]))
                        held, carried = [], BEGIN
                if found and found[-1][0] in (BEGIN, MIDDLE):
                    kind, text = found.pop()
                    carried = kind
                    held = [text]
                inside = open_after
                if found:
                    yield rows(found, *place)
        if held:
            yield rows([(carried, "\n".join(held))], *at)

    parts = lines.mapInArrow(join, "file string, block long, kind int, text string, head boolean")
    record = F.regexp_replace("text", r"\r\z", "").alias("record")
    if not states:  # no file has a second block, so no record crosses an edge
        return parts.where(~F.col("head")).select("file", record).where("record <> ''")
    whole = parts.where(F.col("kind") == RECORD)
    # parts of records that cross blocks, two a block at most: a begin opens a record, what follows belongs to it
    in_file = Window.partitionBy("file").orderBy("block", "kind")
    edge = (parts.where(F.col("kind") != RECORD)
            .withColumn("n", F.sum((F.col("kind") == BEGIN).cast("long")).over(in_file.rowsBetween(Window.unboundedPreceding, 0))))
    crossing = (edge.groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("p"), F.max("head").alias("head"))
                .select("file", F.array_join(F.col("p.text"), "\n").alias("text"), "head"))
    records = whole.select("file", "text", "head").unionByName(crossing).where(~F.col("head"))
    return records.select("file", record).where("record <> ''")


def read_records(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, header: bool = True) -> DataFrame:
    """RFC-4180 files parsed by position with ``schema``; NULL where a field is missing or empty."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv("record", ddl, {"escape": '"', "multiLine": "true"})
    return csv_records(spark, paths, header).select(parsed.alias("r")).select("r.*")
