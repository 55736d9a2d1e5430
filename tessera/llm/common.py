"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words (fixed by the operators' contracts).
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z only.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a local session (tests) gets a scratch folder; on any
    other master that is an error, since executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_by_hash(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` distinct rows with the smallest hash of the columns ``by`` (equal hashes in order of ``by``).

    Rows are first cut at a hash below which about 2 * k distinct ones lie, so the tasks send a few rows in all instead
    of k each; copies are merged before that.
    """
    h = F.xxhash64(*by)
    n = rows.agg(F.approx_count_distinct(h)).first()[0] or 0
    if n > 2 * k:
        rows = rows.where(F.shiftrightunsigned(h, 34) < 2 * k * (1 << 30) // n)
    return rows.distinct().orderBy(F.shiftrightunsigned(h, 34), h, *by).limit(k)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def spark_words(c: Column) -> Column:
    """Words (runs of anything but ASCII white space) of a non-null string column."""
    return F.array_remove(F.split(c, SPACE), "")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application (as ``--py-files`` would)."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tessera-py-")) / "tessera.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(spark.sparkContext.applicationId)
