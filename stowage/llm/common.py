"""What the operators of this subpackage share: tables, and results kept in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: With this setting the shuffle files of a write go when the write is through.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
COLLECT_EVERY = 4  # written tables
_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; executors need a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stowage-"))
    return sc.getCheckpointDir()


def database(spark: SparkSession) -> str:
    """A database whose tables lie in the shared folder, so that dropping a table deletes its files."""
    folder = shared_dir(spark)
    name = f"stowage_{hashlib.md5(folder.encode()).hexdigest()[:12]}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{folder}/tables'")
    return name


def cut(
    df: DataFrame, name: str, buckets: tuple[int, str] | None = None, folders: str | None = None
) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again. buckets: into how many, by which column.
    folders: a column of few values; a filter on it reads its folder only.

    This cuts the lineage, so a lost executor never repeats more than one step, and gives adaptive execution
    plain tables to join, whose skewed partitions it can split. The shuffle files of the write are let go. drop()
    deletes the table.
    """
    spark = df.sparkSession
    full = f"{database(spark)}.{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd")
    if buckets:
        writer = writer.bucketBy(*buckets)
    if folders:
        writer = writer.partitionBy(folders)
    before = spark.conf.get(LET_GO, "false")
    spark.conf.set(LET_GO, "true")
    try:
        writer.saveAsTable(full)
    finally:
        spark.conf.set(LET_GO, before)
    out = spark.table(full)
    out.cut_table = full
    _give_back(spark)
    return out


_WRITTEN = 0


def _give_back(spark: SparkSession) -> None:
    """Let go of the plans of steps that are through, which Python's references keep alive in the driver, and of memory that Arrow
    and the allocator hold back; now and then of the driver's own garbage, so that its heap needn't grow to its limit."""
    global _WRITTEN
    _WRITTEN += 1
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)
    if _WRITTEN % COLLECT_EVERY == 0:
        spark._jvm.System.gc()


def drop(*frames: DataFrame | None) -> None:
    """Delete the tables of frames that cut() made, once nothing reads them any more."""
    for df in frames:
        full = getattr(df, "__dict__", {}).get("cut_table")
        if full:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {full}")


def crc32_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_bytes(column: str) -> Column:
    """A text column as UTF-8 bytes, null as empty: Arrow then hands the bytes over without decoding."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")
