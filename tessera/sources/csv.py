"""CSV sources and sinks: article tables, run-record files, summary export."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessera.operators.scaling import scaling_type_from_name
from tessera.session import written
from tessera.sources.records import read_records


def read_articles(spark: SparkSession, path: str | Sequence[str],
                  schema: T.StructType | str | None = None, strict: bool = False) -> DataFrame:
    """CSV with a header row.

    Default (``strict=False``) uses Spark's default CSV options, as a plain
    ``spark.read.csv(header=True)`` does: a quoted newline ends the record
    and doubled quotes stay raw. ``strict=True`` reads RFC-4180 CSV
    (multi-line quoted fields, ``""`` as the quote escape) with as many tasks
    as the files have blocks (``sources.records``).
    Without a schema the types are inferred: one extra pass over the files, which
    for strict reading takes one task a file.
    """
    reader = spark.read.option("header", True)
    if strict:
        if schema is None:
            schema = reader.option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path).schema
        return read_records(spark, path, schema)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """RFC-4180 CSV with header (quotes doubled), written by the executors.
    Leading/trailing blanks of values are kept (Spark trims them by default).
    As in any CSV read with Spark's default ``nullValue`` (""), an empty
    string reads back as NULL."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


# --- run-record files ---------------------------------------------------------

# --- fixed values -----------------------------------------------------------
# Types of the known run-record columns; every other column is DOUBLE.
RUN_COLUMN_TYPES = {
    "run_id": T.LongType(), "num_workers": T.IntegerType(), "mem_per_worker": T.IntegerType(),
    "cores_per_worker": T.IntegerType(), "num_rows": T.LongType(), "num_stages": T.IntegerType(),
    "num_tasks": T.LongType(), "remark": T.StringType(), "name": T.StringType(),
    "scaling_type": T.StringType(), "log_dir": T.StringType(),
}
# Leading columns of a run record, in writer order.
RUN_CONFIG_COLUMNS = ["num_workers", "mem_per_worker", "cores_per_worker", "dataset_scale",
                      "num_rows", "num_stages", "num_tasks", "remark"]
# ---------------------------------------------------------------------------


def run_names(header: str) -> list[str]:
    """Column names of a run-record file from its header line."""
    return [h.strip().strip('"') for h in header.split(",")]


def _union_names(headers: Iterable[str]) -> list[str]:
    """Names of all layouts, as a union by name orders them."""
    return list(dict.fromkeys(n for h in headers for n in run_names(h)))


# Path pieces by plain string search: an unanchored regex such as
# ``([^/]+)/[^/]*$`` retries from every position and backtracks (measured
# ~10 us per row), ``substring_index`` is a single scan.
def base_name(path: Column) -> Column:
    """Last path component."""
    return F.substring_index(path, "/", -1)


def parent_name(path: Column) -> Column:
    """Name of the folder holding the file."""
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def parent_dir(path: Column) -> Column:
    """Full folder path of the file (everything before the last '/')."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)


def read_runs(spark: SparkSession, paths: str | Sequence[str], classify_by: str = "file") -> DataFrame:
    """Read run-record CSV files whose column sets differ (ragged) into one frame, in two text scans.

    A single CSV read would apply the first file's header to every file. Here
    the first scan takes each file's header, its first non-empty
    line whatever its first field: the line of the file's first block with the
    smallest row position. The distinct headers (one per stage count) make a
    dictionary: for every column of the result its position in that layout.
    The second scan parses every data line once into positional fields, and each
    column picks its field by the position its file's header gives; columns that
    a layout lacks are NULL. Neither the scans nor the plan grow with the number
    of layouts. Records are single-line CSV (quoted commas are fine).

    Adds ``source_file``, ``log_dir`` (parent folder) and ``scaling_type``
    from the base name (``classify_by="file"``) or the parent folder name
    (``"dir"``): 'SS*' strong, 'WS*' weak, 'W-*' sweep.
    """
    path_list = [paths] if isinstance(paths, str) else list(paths)
    lines = (spark.read.text(path_list)
             .select("value", F.col("_metadata.file_path").alias("source_file"),
                     F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
             .filter(F.length("value") > 0))
    # one row per file, kept in the shared folder, so the dictionary and the join below share one scan
    heads = written(lines.filter("__block = 0").groupBy("source_file")
                    .agg(F.min_by("value", "__row").alias("header"), F.min("__row").alias("__head")), "run-headers")
    layouts = sorted(r["header"] for r in heads.select("header").distinct().collect())
    if not layouts:
        return spark.createDataFrame([], T.StructType([]))
    names = _union_names(layouts)
    width = max(len(run_names(h)) for h in layouts)
    places = [(h, [run_names(h).index(n) if n in run_names(h) else -1 for n in names]) for h in layouts]
    positions = spark.createDataFrame(places, "header string, __at array<int>")
    files = heads.join(positions, "header").select("source_file", "__head", "__at")
    body = lines.join(files, "source_file").filter((F.col("__block") > 0) | (F.col("__row") > F.col("__head")))
    fields = F.from_csv("value", ", ".join(f"f{k} string" for k in range(width)), {"escape": '"'})
    parsed = body.select("source_file", "__at", fields.alias("__f")).select(
        "source_file", "__at", F.array(*[F.col(f"__f.f{k}") for k in range(width)]).alias("__v"))
    name = base_name(F.col("source_file")) if classify_by == "file" else parent_name(F.col("source_file"))
    return parsed.select(
        *[F.get("__v", F.get("__at", F.lit(k))).try_cast(RUN_COLUMN_TYPES.get(n, T.DoubleType())).alias(n) for k, n in enumerate(names)],
        "source_file", parent_dir(F.col("source_file")).alias("log_dir"), scaling_type_from_name(name).alias("scaling_type"))


def with_source(df: DataFrame, out: str = "log_dir") -> DataFrame:
    """Provenance of file-sourced rows: the folder each row's file lives in."""
    return df.withColumn(out, parent_dir(F.col("_metadata.file_path")))


def read_with_source(spark: SparkSession, paths: str | Sequence[str],
                     schema: T.StructType | str, fmt: str = "csv",
                     options: dict[str, str] | None = None) -> DataFrame:
    """Read files with provenance; an unreadable file fails the job, so no row is lost
    without notice. Whoever wants Spark's ``ignoreCorruptFiles`` (which keeps the rows
    read before a defect) passes it in ``options``."""
    reader = spark.read.format(fmt).schema(schema)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return with_source(reader.load(paths if isinstance(paths, str) else list(paths)))


def read_intact_files(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str,
                      options: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): the CSV rows, with ``source_file`` and ``log_dir``, of the files whose records all
    fit the schema, and one row per other file (source_file, n_bad, record: its smallest bad record).

    A file is kept or left out whole. Too few or too many fields and values of another type make a record
    bad; a file that cannot be read at all (a broken archive, say) still fails the job. The report is
    checkpointed at once (one row per rejected file), so the files are parsed twice in all.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = "__bad_record"
    reader = (spark.read.schema(T.StructType([*fields.fields, T.StructField(bad, T.StringType())]))
              .options(**{**(options or {}), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "columnPruning": "false"}))
    raw = reader.csv(paths if isinstance(paths, str) else list(paths))
    raw = raw.withColumns({"source_file": F.col("_metadata.file_path"), "log_dir": parent_dir(F.col("_metadata.file_path"))})
    # Spark refuses a read of the bad-record column alone, so a data column goes along with it
    first = F.min(F.struct(bad, fields.names[0]))
    rejected = (raw.filter(F.col(bad).isNotNull()).groupBy("source_file")
                .agg(F.count("*").alias("n_bad"), first[bad].alias("record")).checkpoint())
    return raw.drop(bad).join(rejected.select("source_file"), "source_file", "left_anti"), rejected


def run_record_columns(df: DataFrame) -> list[str]:
    """Writer field order: config columns, other columns, stage columns (stage-major), E2E columns."""
    from tessera.operators.stages import STAGE_METRICS

    present = set(df.columns)
    stages = sorted({int(c[5:c.index("_")]) for c in df.columns
                     if c.startswith("stage") and "_" in c and c[5:c.index("_")].isdigit()})
    config = [c for c in RUN_CONFIG_COLUMNS if c in present]
    cols = [f"stage{i}_{m}" for i in stages for m in STAGE_METRICS if f"stage{i}_{m}" in present]
    cols += [c for c in ("E2E_time", "E2E_throughput") if c in present]
    return config + [c for c in df.columns if c not in config and c not in cols] + cols


def write_runs(df: DataFrame, path: str, order: Iterable[str] | None = None) -> None:
    """Run records as CSV with header, fixed field order, overwrite."""
    write_csv(df.select(*(list(order) if order else run_record_columns(df))), path)


def export_summary(df: DataFrame, path: str, by: Sequence[str] = ("scaling_type", "total_cores"),
                   tie: Sequence[str] = ()) -> None:
    """Processed summary as CSV, globally sorted (part files in sort order)."""
    write_csv(df.orderBy(*[F.col(c) for c in list(by) + list(tie)]), path)
