"""Mutation queries: the next snapshot of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators import mutations
from stowage.plans.registry import query, sha256_pad
from stowage.sources.views import Tables


@query(
    "SELECT id, CASE WHEN storage_location_id = 102 AND starts_with(path, '/mnt/src1/en/') THEN '/vol/english' || substr(path, 13) ELSE path END AS path FROM media_files"
)
def rewrite_prefix(t: Tables) -> DataFrame:
    return mutations.rewrite_prefix(t.media_files, 102, "/mnt/src1/en", "/vol/english").select("id", "path")


@query("SELECT id, is_missing OR storage_location_id = 104 AS is_missing FROM media_files")
def untrack(t: Tables) -> DataFrame:
    return mutations.untrack(t.storage_locations, t.media_files, 104)[1].select("id", "is_missing")


@query("""
    WITH r AS (SELECT id FROM backup_records WHERE media_file_id NOT IN (SELECT id FROM media_files WHERE storage_location_id = 105))
    SELECT 'files' AS kind, count(*)::BIGINT AS n FROM media_files WHERE storage_location_id <> 105 UNION ALL SELECT 'records', count(*) FROM r UNION ALL SELECT 'links', count(*) FROM backup_record_archives WHERE backup_record_id IN (SELECT id FROM r)
    UNION ALL SELECT 'locations', count(*) FROM storage_locations WHERE id <> 105
""")
def cascade_delete(t: Tables) -> DataFrame:
    kept = mutations.cascade_delete(105, t.storage_locations, t.media_files, t.backup_records, t.backup_record_archives)
    counts = [kept[name].agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, name in (("files", "media_files"), ("records", "backup_records"), ("links", "backup_record_archives"), ("locations", "storage_locations"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT kind, count(*)::BIGINT AS cleared FROM backup_runs WHERE status = 'failed' GROUP BY kind")
def clear_failed(t: Tables) -> DataFrame:
    return mutations.clear_failed(t.backup_runs)[1]


@query(
    "SELECT id, password, CAST(coalesce(retired_at, 1650000000) AS BIGINT) AS retired_at FROM backup_key_versions UNION ALL SELECT (SELECT max(id) + 1 FROM backup_key_versions), 'new secret', NULL"
)
def rotate_key(t: Tables) -> DataFrame:
    return mutations.rotate_key(
        t.backup_key_versions, "new secret", "salt", 1_650_000_000
    ).select("id", "password", "retired_at")


_NEW = "new secret:salt"
_PADS = [sha256_pad(_NEW, pad) for pad in (0x36, 0x5C)]


@query(
    f"SELECT r.id AS record_id, (SELECT max(id) + 1 FROM backup_key_versions) AS key_version_id, sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode('content-id:' || r.sha256)))) AS content_id FROM backup_records r WHERE r.sha256 IS NOT NULL AND r.id % 3 <> 0"
)
def rotate_backfill(t: Tables) -> DataFrame:
    """After a rotation every record gets its keyed content id under the new key, from its hash alone; every third has it already."""
    rotated = mutations.rotate_key(t.backup_key_versions.drop("master_key"), "new secret", "salt", 1_650_000_000)
    keyed = rotated.withColumn("master_key", F.unhex(F.sha2(F.concat_ws(":", "password", "kdf_salt"), 256)))
    newest = rotated.agg(F.max("id").alias("key_version_id"))
    present = t.backup_records.filter("id % 3 = 0").select(F.col("id").alias("record_id")).crossJoin(F.broadcast(newest))
    return mutations.backfill_keyed(t.backup_records, keyed, present)


@query("SELECT id, status, 0 AS retries, CAST(NULL AS VARCHAR) AS note FROM backup_runs")
def evolve_schema(t: Tables) -> DataFrame:
    return mutations.evolve_schema(
        t.backup_runs.select("id", "status"),
        {"retries": ("int", 0), "note": ("string", None), "Status": ("string", "x")},
    )


@query(
    "SELECT id, CASE media_type WHEN 'movies' THEN 'video' WHEN 'documents' THEN 'text' ELSE media_type END AS media_type FROM media_files"
)
def rename_types(t: Tables) -> DataFrame:
    return mutations.rename_values(
        t.media_files.select("id", "media_type"), "media_type", {"movies": "video", "documents": "text"}
    )
