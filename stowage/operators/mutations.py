"""Changes of tables as functions from the present snapshot to the next, and the sink that publishes it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import paths, scalars


def rewrite_prefix(files: DataFrame, location: int, before: str, after: str) -> DataFrame:
    """Paths of a moved library, by whole components."""
    hit = (F.col("storage_location_id") == location) & paths.under(F.col("path"), F.lit(before))
    return files.withColumn(
        "path", F.when(hit, paths.swap_prefix(F.col("path"), F.lit(before), F.lit(after))).otherwise(F.col("path"))
    )


def untrack(
    locations: DataFrame, files: DataFrame, location: int, tracked: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(locations, files): untracking marks all files missing; tracking again only clears the flag."""
    flagged = locations.withColumn(
        "untracked", F.when(F.col("id") == location, F.lit(not tracked)).otherwise(F.col("untracked"))
    )
    if tracked:
        return flagged, files
    return flagged, files.withColumn(
        "is_missing", F.col("is_missing") | F.coalesce(F.col("storage_location_id") == location, F.lit(False))
    )


def cascade_delete(
    location: int, locations: DataFrame, files: DataFrame, records: DataFrame, links: DataFrame
) -> dict[str, DataFrame]:
    """All tables without a library, its files, their records and the records' links; references to a deleted archive
    become null.
    """
    kept_files = files.filter(~F.coalesce(F.col("storage_location_id") == location, F.lit(False)))
    gone = files.filter(F.col("storage_location_id") == location).select(F.col("id").alias("media_file_id"))
    kept_records = records.join(gone, "media_file_id", "left_anti").filter(
        ~F.coalesce(F.col("destination_id") == location, F.lit(False))
    )
    kept_links = links.join(kept_records.select(F.col("id").alias("backup_record_id")), "backup_record_id", "left_semi")
    kept = locations.filter(F.col("id") != location).withColumn(
        "archive_location_id", F.when(F.col("archive_location_id") != location, F.col("archive_location_id"))
    )
    return {
        "storage_locations": kept,
        "media_files": kept_files,
        "backup_records": kept_records,
        "backup_record_archives": kept_links,
    }


def clear_failed(runs: DataFrame, kind: str | None = None, run: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs that stay, counts of those cleared by kind)."""
    hit = F.col("status") == "failed"
    if kind:
        hit &= F.col("kind") == kind
    if run is not None:
        hit &= F.col("id") == run
    return runs.filter(~hit), runs.filter(hit).groupBy("kind").agg(F.count(F.lit(1)).alias("cleared"))


def rotate_key(keys: DataFrame, password: str, salt: str, now: int) -> DataFrame:
    """Retires the current key and adds the new one; the same password and salt as the current key change nothing."""
    same = keys.filter((F.col("retired_at").isNull()) & (F.col("password") == password) & (F.col("kdf_salt") == salt))
    if not same.isEmpty():
        return keys
    new = keys.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id")).select(
        "id",
        F.lit(password).alias("password"),
        F.lit(salt).alias("kdf_salt"),
        F.lit(now).cast("long").alias("created_at"),
        F.lit(None).cast("long").alias("retired_at"),
    )
    retired = keys.select(
        "id",
        "password",
        "kdf_salt",
        F.col("created_at").cast("long").alias("created_at"),
        F.coalesce("retired_at", F.lit(now)).cast("long").alias("retired_at"),
    )
    return retired.unionByName(new)


def backfill(records: DataFrame, keys: DataFrame, content_id: Column, present: DataFrame) -> DataFrame:
    """record_id, key_version_id, content_id that records lack under the current key version; running it again adds
    nothing.

    content_id: a column of a record's sha256 and the key version's columns (scalars.hmac_with_pads for keyed ids).
    present: record_id, key_version_id.
    """
    current = keys.filter("retired_at is null").withColumnRenamed("id", "key_version_id")  # one row
    pairs = records.filter("sha256 is not null").select(
        F.col("id").alias("record_id"), "sha256"
    ).crossJoin(F.broadcast(current))
    missing = pairs.join(present, ["record_id", "key_version_id"], "left_anti")
    return missing.select("record_id", "key_version_id", content_id.alias("content_id"))


def backfill_keyed(records: DataFrame, keys: DataFrame, present: DataFrame, label: str = "content-id:") -> DataFrame:
    """backfill with the keyed ids themselves: HMAC-SHA-256 of the label and the hash under the current version's master_key (bytes).

    The pads are taken once, for the one current key, before records meet it.
    """
    inner, outer = scalars.hmac_pads(F.col("master_key"))
    current = keys.filter("retired_at is null").select("id", "retired_at", inner.alias("inner"), outer.alias("outer"))
    made = scalars.hmac_with_pads(F.col("inner"), F.col("outer"), F.concat(F.lit(label), "sha256"))
    return backfill(records, current, made, present)


def evolve_schema(table: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the columns that are missing, with their defaults; what exists stays as it is."""
    have = {c.lower() for c in table.columns}
    return table.withColumns(
        {name: F.lit(default).cast(kind) for name, (kind, default) in columns.items() if name.lower() not in have}
    )


def rename_values(table: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    return table.replace(names, subset=[column])


def publish(spark: SparkSession, snapshot: DataFrame, root: str, name: str, version: int) -> str:
    """Writes a snapshot as a new version folder, then a marker of it; a reader sees the version before or the whole new one,
    and a failed write nothing.

    A marker is written under another name and renamed to the version's own, so there is always one to read and none is ever
    half there. Versions count up; there is one writer for each table.
    """
    path = f"{root}/{name}/v={version}"
    snapshot.write.mode("errorifexists").parquet(path)
    store, folder = _hadoop(spark, f"{root}/{name}/_versions")
    jvm = spark._jvm.org.apache.hadoop.fs
    own, final = jvm.Path(folder, f".{uuid.uuid4().hex}"), jvm.Path(folder, f"{version:020d}")
    store.create(own, True).close()
    if not store.rename(own, final):
        store.delete(own, False)
        raise FileExistsError(f"version {version} of {name} is published already")
    return path


def _hadoop(spark: SparkSession, folder: str):
    """The file system of a folder, by whatever store its path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def current_version(spark: SparkSession, root: str, name: str) -> int:
    """The greatest version that has a marker."""
    store, folder = _hadoop(spark, f"{root}/{name}/_versions")
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    return max(int(n) for n in names if n.isdigit())


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/v={current_version(spark, root, name)}")
