"""Report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.operators import reports
from stowage.plans.registry import query
from stowage.sources.views import Tables

UUID = paths.UUID


@query("SELECT count(*)::BIGINT AS files, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM media_files")
def storage_totals(t: Tables) -> DataFrame:
    return reports.storage_totals(t.media_files)


@query(
    "SELECT media_type, count(*)::BIGINT AS files, sum(size_bytes)::BIGINT AS bytes FROM media_files GROUP BY media_type"
)
def storage_by_type(t: Tables) -> DataFrame:
    return reports.storage_by_type(t.media_files)


@query(
    "SELECT count(*) FILTER (status = 'queued')::BIGINT AS queued, count(*) FILTER (status = 'running')::BIGINT AS running, count(*) FILTER (status = 'failed')::BIGINT AS failed FROM backup_runs WHERE kind IN ('backup', 'restore')"
)
def activity_summary(t: Tables) -> DataFrame:
    return reports.activity_summary(t.backup_runs)


@query(
    "SELECT id, CASE WHEN is_backup_target THEN 'archive' WHEN untracked THEN 'untracked library' ELSE 'library' END AS class FROM storage_locations"
)
def location_classes(t: Tables) -> DataFrame:
    return reports.location_classes(t.storage_locations)


@query("""
    SELECT l.id AS library_id, l.name, count(m.id)::BIGINT AS files, count(DISTINCT m.id) FILTER (EXISTS (SELECT 1 FROM backup_records r WHERE r.media_file_id = m.id AND r.status = 'done' AND r.destination_id = l.archive_location_id))::BIGINT AS covered
    FROM storage_locations l LEFT JOIN media_files m ON m.storage_location_id = l.id WHERE NOT l.is_backup_target GROUP BY l.id, l.name
""")
def library_coverage(t: Tables) -> DataFrame:
    return reports.library_coverage(t.media_files, t.backup_records, t.storage_locations)


@query(
    f"SELECT coalesce(storage_class, 'UNKNOWN') AS tier, count(*)::BIGINT AS archives, sum(size)::BIGINT AS bytes FROM object_listing WHERE regexp_matches(key, '{UUID}\\.tar$') GROUP BY 1"
)
def inventory_tiers(t: Tables) -> DataFrame:
    return reports.inventory_tiers(t.object_listing)


@query(
    "SELECT k.id, row_number() OVER (ORDER BY k.created_at, k.id)::INTEGER AS version, k.retired_at IS NULL AS current, (SELECT count(*) FROM backup_archives a WHERE a.key_version_id = k.id)::BIGINT AS archives FROM backup_key_versions k"
)
def key_history(t: Tables) -> DataFrame:
    return reports.key_history(t.backup_key_versions, t.backup_archives)


@query("""
    SELECT r.id, r.media_file_id, r.destination_id, coalesce(bool_or(a.encrypted), false) AS encrypted
    FROM backup_records r LEFT JOIN backup_record_archives l ON l.backup_record_id = r.id LEFT JOIN backup_archives a ON a.id = l.backup_archive_id GROUP BY r.id, r.media_file_id, r.destination_id
""")
def file_locations(t: Tables) -> DataFrame:
    return reports.file_locations(t.backup_records, t.backup_record_archives, t.backup_archives)


@query("""
    SELECT id, json_extract_string(s, '$.reason') AS reason, count(*)::BIGINT AS files FROM (SELECT id, unnest(from_json(skipped_json, '["json"]')) AS s FROM backup_runs) GROUP BY 1, 2
""")
def skip_counts(t: Tables) -> DataFrame:
    return reports.skip_counts(t.backup_runs)


@query(
    "SELECT DISTINCT 'genre' AS facet, genre AS value FROM media_files WHERE coalesce(genre, '') <> '' UNION ALL SELECT DISTINCT 'media_type', media_type FROM media_files WHERE coalesce(media_type, '') <> ''"
)
def facets(t: Tables) -> DataFrame:
    return reports.facets(t.media_files)


@query(
    "SELECT count(*)::BIGINT AS files, max(scanned_at) AS last_scan, count(*) FILTER (watched)::BIGINT AS watched FROM media_files"
)
def catalog_scalars(t: Tables) -> DataFrame:
    return reports.catalog_scalars(t.media_files)


@query("""
    SELECT l.id, l.name, coalesce((SELECT string_agg(c.name, ',' ORDER BY c.name) FROM storage_locations c WHERE c.archive_location_id = l.id), '') AS libraries,
           (SELECT count(*) FROM backup_archives a WHERE a.storage_location_id = l.id)::BIGINT AS archives FROM storage_locations l WHERE l.is_backup_target
""")
def archive_rows(t: Tables) -> DataFrame:
    return reports.archive_rows(t.storage_locations, t.backup_archives)


@query(
    "SELECT id, CASE WHEN files_failed = 0 THEN 'done' WHEN files_done > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM backup_runs"
)
def run_outcome(t: Tables) -> DataFrame:
    return reports.run_outcome(t.backup_runs)


@query(
    "SELECT m.id, m.path, m.filename, m.genre, m.media_type, m.size_bytes FROM media_files m JOIN storage_locations l ON l.id = m.storage_location_id WHERE m.media_type = 'documents' AND m.genre = 'en' AND l.name = 'src5' AND m.filename ILIKE '%DOC-%5%'"
)
def catalog_search(t: Tables) -> DataFrame:
    return reports.catalog_search(
        t.media_files, t.storage_locations, "documents", "en", "src5", "DOC-%5"
    ).select("id", "path", "filename", "genre", "media_type", "size_bytes")


@query("SELECT id, genre, filename FROM media_files ORDER BY genre NULLS LAST, filename, id LIMIT 20 OFFSET 40")
def catalog_page(t: Tables) -> DataFrame:
    return reports.page_of(t.media_files.select("id", "genre", "filename"), 3)


@query("""
    WITH o AS (SELECT id, genre, filename, row_number() OVER (ORDER BY genre NULLS LAST, filename, id) - 1 AS n, count(*) OVER () AS total FROM media_files)
    SELECT id, genre, filename FROM o WHERE n // 20 = ((total + 19) // 20 + 1) // 2 - 1
""")
def catalog_page_middle(t: Tables) -> DataFrame:
    return reports.page_of(t.media_files.select("id", "genre", "filename"), None)


@query("""
    WITH r AS (SELECT substr(path, 6) AS rel FROM media_files)
    SELECT CASE WHEN len(string_split(rel, '/')) > 2 THEN 'folder' ELSE 'file' END AS kind, string_split(rel, '/')[2] AS name, count(*)::BIGINT AS files FROM r WHERE starts_with(rel, 'src0/') GROUP BY 1, 2
""")
def folder_view(t: Tables) -> DataFrame:
    return reports.folder_view(
        t.media_files.select(paths.relative(F.col("path"), F.lit("/mnt")).alias("rel_path")), "src0"
    )


@query("""
    WITH c AS (SELECT m.storage_location_id, m.filename, row_number() OVER (PARTITION BY m.storage_location_id ORDER BY m.filename) AS r, count(*) OVER (PARTITION BY m.storage_location_id) AS n
               FROM media_files m JOIN listing s ON s.path = m.path WHERE s.size <> m.size_bytes)
    SELECT storage_location_id, n::BIGINT AS n, string_agg(filename, ', ' ORDER BY r) FILTER (r <= 5) || CASE WHEN n > 5 THEN ' and ' || (n - 5) || ' more' ELSE '' END AS message FROM c GROUP BY storage_location_id, n
""")
def scan_message(t: Tables) -> DataFrame:
    changed = t.media_files.join(t.listing.select("path", "size"), "path").filter("size <> size_bytes")
    return reports.scan_message(changed.select("storage_location_id", "filename"))


@query(
    "SELECT r.id, l.name AS library, r.status, r.started_us FROM backup_runs r JOIN storage_locations l ON l.id = r.source_location_id WHERE r.kind = 'backup' ORDER BY r.started_us DESC, r.id DESC LIMIT 25"
)
def recent_runs(t: Tables) -> DataFrame:
    return reports.recent_runs(t.backup_runs, t.storage_locations, "backup")


@query("SELECT kind || '-' || id AS key, status, source_location_id FROM backup_runs")
def run_board(t: Tables) -> DataFrame:
    return reports.run_board(t.backup_runs)


NOW_US = 1_706_570_000_000_000


@query(f"""
    WITH x AS (SELECT *, status = 'running' AS live, ({NOW_US} - phase_started_us) / 1e6 AS elapsed, CASE WHEN status = 'running' THEN greatest(0.0, ({NOW_US} - coalesce(heartbeat_us, started_us)) / 1e6) END AS age FROM backup_runs),
         y AS (SELECT *, CASE WHEN live AND phase_done > 0 AND elapsed >= 3 THEN phase_done / elapsed END AS rt FROM x)
    SELECT id, kind || '-' || id AS key, CASE WHEN live THEN CASE phase WHEN 'hashing' THEN 'Hashing files' WHEN 'uploading' THEN 'Uploading' WHEN 'restoring' THEN 'Restoring files' WHEN 'packing' THEN 'Packing archives' ELSE phase END END AS label,
           CASE WHEN live AND phase IN ('uploading', 'restoring', 'syncing') THEN 'bytes' ELSE 'files' END AS unit,
           round(CASE WHEN live AND phase_total > 0 THEN least(100.0::DOUBLE, phase_done::DOUBLE / phase_total * 100) END, 3) AS percent, round(rt::DOUBLE, 3) AS rate,
           round(CASE WHEN phase_total > phase_done THEN (phase_total - phase_done) / rt::DOUBLE END, 3) AS eta_seconds, round(age::DOUBLE, 3) AS heartbeat_age, coalesce(age > 120, false) AS stalled FROM y
""")
def run_progress(t: Tables) -> DataFrame:
    return reports.run_progress(t.backup_runs, F.lit(NOW_US))


@query(f"""
    SELECT id, {NOW_US} - coalesce(heartbeat_us, started_us) AS silent_us FROM backup_runs WHERE status = 'running' AND {NOW_US} - coalesce(heartbeat_us, started_us) > 120000000
""")
def stalled_runs(t: Tables) -> DataFrame:
    silent = F.lit(NOW_US) - F.coalesce("heartbeat_us", "started_us")
    return t.backup_runs.filter(
        (F.col("status") == "running") & (silent > 120_000_000)
    ).select("id", silent.alias("silent_us"))


@query(
    "SELECT m.id AS media_file_id, l.name AS library, a.name AS archive FROM media_files m LEFT JOIN storage_locations l ON l.id = m.storage_location_id LEFT JOIN storage_locations a ON a.id = l.archive_location_id"
)
def file_archive(t: Tables) -> DataFrame:
    return reports.file_archive(t.media_files, t.storage_locations)


_ELIGIBLE = "EXISTS (SELECT 1 FROM backup_records r WHERE r.media_file_id = m.id AND r.destination_id = l.archive_location_id AND r.status = 'done')"


@query(
    f"SELECT m.id AS media_file_id, {_ELIGIBLE} AS eligible FROM media_files m JOIN storage_locations l ON l.id = m.storage_location_id"
)
def eligible_split(t: Tables) -> DataFrame:
    return reports.eligible_split(t.media_files, t.backup_records, t.storage_locations)


@query(f"""
    WITH e AS (SELECT m.id, l.id AS library_id, l.archive_location_id AS archive_id, {_ELIGIBLE} AS eligible FROM media_files m JOIN storage_locations l ON l.id = m.storage_location_id)
    SELECT library_id, archive_id, count(*) FILTER (eligible)::BIGINT AS files, count(*) FILTER (NOT eligible)::BIGINT AS skipped, coalesce(min(id) FILTER (eligible), -1) AS first_file FROM e GROUP BY 1, 2
""")
def runs_to_start(t: Tables) -> DataFrame:
    eligible = reports.eligible_split(t.media_files, t.backup_records, t.storage_locations)
    return reports.runs_to_start(t.media_files, eligible, t.storage_locations)
