"""Backup planning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import paths, scalars
from stowage.operators import backup, ordered
from stowage.plans.registry import query
from stowage.sources.views import Tables

DESTINATION = 1
_PRESENT = """
    pr AS (SELECT r.id, coalesce(bool_and(o.key IS NOT NULL) FILTER (l.backup_record_id IS NOT NULL), true) AS present FROM backup_records r LEFT JOIN backup_record_archives l ON l.backup_record_id = r.id LEFT JOIN backup_archives a ON a.id = l.backup_archive_id
           LEFT JOIN (SELECT DISTINCT key FROM object_listing) o ON o.key = a.path GROUP BY r.id)
"""
_EXCLUDED = r"""
    ex AS (SELECT m.id, (m.storage_location_id - 100) % 4 IN (0, 1) AND CASE WHEN (m.storage_location_id - 100) % 4 = 0 THEN regexp_full_match(substr(m.path, length(m.source) + 7), '(?s)(.*\.tmp|.*/fr/.*)')
           ELSE regexp_full_match(substr(m.path, length(m.source) + 7), '(?s)de/doc-.[05]\..*') END AS excluded FROM media_files m)
"""
_REASONS = f"""
    {_PRESENT}, {_EXCLUDED}, af AS (SELECT path, size + CASE WHEN length(path) % 11 = 0 THEN 1 ELSE 0 END AS size, mtime_ns FROM listing),
    rs AS (SELECT m.id, m.path, m.storage_location_id, CASE WHEN ex.excluded THEN 'excluded' WHEN m.is_missing THEN 'already_missing' WHEN s.path IS NULL THEN 'missing' WHEN coalesce(r.mtime_ns = s.mtime_ns AND s.size = m.size_bytes AND pr.present, false) THEN 'unchanged'
                  WHEN s.size <> af.size THEN 'changed_during_read' ELSE 'candidate' END AS reason
           FROM media_files m JOIN ex ON ex.id = m.id LEFT JOIN listing s ON s.path = m.path LEFT JOIN af ON af.path = m.path LEFT JOIN (SELECT * FROM backup_records WHERE destination_id = {DESTINATION}) r ON r.media_file_id = m.id LEFT JOIN pr ON pr.id = r.id)
"""


def _after(t: Tables) -> DataFrame:
    return t.listing.withColumn("size", F.col("size") + F.when(F.length("path") % 11 == 0, 1).otherwise(0))


def _reasons(t: Tables) -> DataFrame:
    present = backup.archives_present(t.backup_records, t.backup_record_archives, t.backup_archives, t.object_listing)
    return backup.skip_reasons(
        t.media_files, t.storage_locations, t.listing, _after(t), t.backup_records, present, DESTINATION
    )


@query(f"WITH {_PRESENT} SELECT id, present FROM pr")
def archives_present(t: Tables) -> DataFrame:
    return backup.archives_present(t.backup_records, t.backup_record_archives, t.backup_archives, t.object_listing)


@query(f"WITH {_REASONS} SELECT id, path, reason FROM rs")
def skip_reason(t: Tables) -> DataFrame:
    return _reasons(t)


@query(f"WITH {_REASONS} SELECT id FROM rs WHERE reason = 'unchanged'")
def unchanged(t: Tables) -> DataFrame:
    return _reasons(t).filter("reason = 'unchanged'").select("id")


@query("SELECT path FROM listing WHERE length(path) % 11 = 0")
def changed_during_read(t: Tables) -> DataFrame:
    later = _after(t).select("path", F.col("size").alias("later_size"), F.col("mtime_ns").alias("later_ns"))
    return t.listing.join(later, "path").filter("size <> later_size or mtime_ns <> later_ns").select("path")


@query(
    f"WITH {_REASONS} SELECT storage_location_id, CASE WHEN bool_or(reason NOT IN ('candidate', 'excluded', 'unchanged', 'already_backed_up', 'already_missing')) THEN 'partial' ELSE 'done' END AS status FROM rs GROUP BY 1"
)
def run_status(t: Tables) -> DataFrame:
    return backup.run_status(
        _reasons(t).join(t.media_files.select("id", "storage_location_id"), "id"), "storage_location_id"
    )


PAGE = 500


@query(f"""
    WITH {_REASONS}, ns AS (SELECT *, (row_number() OVER (PARTITION BY storage_location_id ORDER BY path) - 1) // {PAGE} AS page FROM rs WHERE reason <> 'candidate')
    SELECT storage_location_id, page, '[' || string_agg('{{"path":"' || path || '","reason":"' || reason || '"}}', ',' ORDER BY path) || ']' AS results FROM ns GROUP BY 1, 2
""")
def run_results_json(t: Tables) -> DataFrame:
    reasons = _reasons(t).filter("reason <> 'candidate'").join(t.media_files.select("id", "storage_location_id"), "id")
    return backup.results_json(reasons, "storage_location_id", PAGE)


@query(f"""
    WITH c AS (SELECT id, sha256 FROM media_files), s AS (SELECT sha256, min(id) AS rid FROM backup_records WHERE destination_id = {DESTINATION} AND status = 'done' AND sha256 IS NOT NULL GROUP BY 1),
         u AS (SELECT l.backup_record_id AS rid FROM backup_record_archives l JOIN backup_archives a ON a.id = l.backup_archive_id LEFT JOIN (SELECT DISTINCT key FROM object_listing) o ON o.key = a.path
               GROUP BY 1 HAVING bool_and(a.archive_id IS NOT NULL AND a.indexed_at IS NOT NULL AND o.key IS NOT NULL AND a.id % 1000 >= 0 AND NOT (a.encrypted AND a.id % 10 <> 0)))
    SELECT c.id, coalesce(u.rid, -1) AS record_id FROM c LEFT JOIN s USING (sha256) LEFT JOIN u ON u.rid = s.rid
""")
def adopt_existing(t: Tables) -> DataFrame:
    candidates = t.media_files.select("id", F.col("sha256").alias("match_key"))
    records = t.backup_records.select("id", F.col("sha256").alias("match_key"), "destination_id", "status")
    archives = t.backup_archives.withColumn("encrypted", F.col("encrypted") & (F.col("id") % 10 != 0))
    adopted = backup.adopt_existing(
        candidates, records, t.backup_record_archives, archives, t.object_listing, DESTINATION, False, None
    )
    return adopted.select("id", F.coalesce("record_id", F.lit(-1)).alias("record_id"))


def _adoptable(t: Tables) -> DataFrame:
    """Records with their content ids under the second key version."""
    return t.backup_records.select(
        "id", F.sha2(F.concat(F.lit("2:"), "sha256"), 256).alias("match_key"), "destination_id", "status"
    )


@query(f"""
    WITH c AS (SELECT id, $SHA('2:' || sha256) AS cid FROM media_files), s AS (SELECT $SHA('2:' || sha256) AS cid, min(id) AS rid FROM backup_records WHERE destination_id = {DESTINATION} AND status = 'done' AND sha256 IS NOT NULL GROUP BY 1),
         u AS (SELECT l.backup_record_id AS rid FROM backup_record_archives l JOIN backup_archives a ON a.id = l.backup_archive_id LEFT JOIN (SELECT DISTINCT key FROM object_listing) o ON o.key = a.path
               GROUP BY 1 HAVING bool_and(a.archive_id IS NOT NULL AND a.indexed_at IS NOT NULL AND o.key IS NOT NULL AND (a.encrypted OR a.id % 3 = 1) AND a.id % 5 <> 3))
    SELECT c.id, coalesce(u.rid, -1) AS record_id FROM c LEFT JOIN s USING (cid) LEFT JOIN u ON u.rid = s.rid
""")
def adopt_encrypted(t: Tables) -> DataFrame:
    """Adoption by content id: only archives that are encrypted under the run's own key version are copied."""
    candidates = t.media_files.select("id", F.sha2(F.concat(F.lit("2:"), "sha256"), 256).alias("match_key"))
    own = F.when(F.col("id") % 5 != 3, 2).otherwise(1)
    archives = t.backup_archives.withColumn(
        "encrypted", F.col("encrypted") | (F.col("id") % 3 == 1)
    ).withColumn("key_version_id", own)
    adopted = backup.adopt_existing(
        candidates, _adoptable(t), t.backup_record_archives, archives, t.object_listing, DESTINATION, True, 2
    )
    return adopted.select("id", F.coalesce("record_id", F.lit(-1)).alias("record_id"))


@query(
    "SELECT sha256, min(path) AS rel_path, arg_min(size_bytes, path) AS size_bytes, count(*)::BIGINT AS copies FROM media_files GROUP BY sha256"
)
def dedup_groups(t: Tables) -> DataFrame:
    return backup.dedup_groups(t.media_files.select("sha256", F.col("path").alias("rel_path"), "size_bytes"))


@query(
    "WITH n AS (SELECT sha256, path, (row_number() OVER (PARTITION BY sha256 ORDER BY path) - 1) // 2 AS page FROM media_files) SELECT sha256, page, string_agg(path, '|' ORDER BY path) AS paths FROM n GROUP BY 1, 2"
)
def content_paths(t: Tables) -> DataFrame:
    pages = backup.content_paths(t.media_files.select("sha256", F.col("path").alias("rel_path")), page=2)
    return pages.select("sha256", "page", F.array_join("paths", "|").alias("paths"))


MIN, CLUMP, MAX = 3_000, 65_536, scalars.MIB + 12_000


def _contents(t: Tables) -> DataFrame:
    groups = backup.dedup_groups(t.media_files.select("sha256", F.col("path").alias("rel_path"), "size_bytes"))
    return groups.withColumn("library", F.split("rel_path", "/")[2])


@query(f"""
    WITH c AS (SELECT sha256, min(path) AS rel_path, arg_min(size_bytes, path) AS size FROM media_files GROUP BY 1),
         k AS (SELECT *, string_split(rel_path, '/')[3] AS library, 512 + ((size + 511) // 512) * 512 + 1024 AS cost FROM c WHERE size < {MIN}),
         n AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY rel_path) AS i FROM k),
         f AS (SELECT library, i, 0::BIGINT AS bin, cost AS filled FROM n WHERE i = 1 UNION ALL
               SELECT n.library, n.i, CASE WHEN f.filled + n.cost > {min(CLUMP, MAX - scalars.MIB)} THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.filled + n.cost > {min(CLUMP, MAX - scalars.MIB)} THEN n.cost ELSE f.filled + n.cost END FROM f JOIN n ON n.library = f.library AND n.i = f.i + 1)
    SELECT n.library, n.sha256, n.rel_path, 'clump' AS kind, 'clump-' || f.bin AS archive FROM n JOIN f ON f.library = n.library AND f.i = n.i
    UNION ALL SELECT string_split(rel_path, '/')[3], sha256, rel_path, CASE WHEN size <= {MAX - scalars.MIB} THEN 'single' ELSE 'part' END, CASE WHEN size <= {MAX - scalars.MIB} THEN 'single-' ELSE 'part-' END || substr(sha256, 1, 12) FROM c WHERE size >= {MIN}
""")
def clump_plan(t: Tables) -> DataFrame:
    return backup.clump_plan(_contents(t), MIN, CLUMP, MAX).select("library", "sha256", "rel_path", "kind", "archive")


@query("""
    WITH n AS (SELECT id, storage_location_id AS l, size_bytes AS cost, row_number() OVER (PARTITION BY storage_location_id ORDER BY id) AS i FROM media_files),
         f AS (SELECT l, i, 0::BIGINT AS bin, cost AS filled FROM n WHERE i = 1 UNION ALL
               SELECT n.l, n.i, CASE WHEN f.filled > 0 AND f.filled + n.cost > 20000 THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.filled > 0 AND f.filled + n.cost > 20000 THEN n.cost ELSE f.filled + n.cost END FROM f JOIN n ON n.l = f.l AND n.i = f.i + 1)
    SELECT n.id, n.l AS storage_location_id, f.bin FROM n JOIN f ON f.l = n.l AND f.i = n.i
""")
def byte_batches(t: Tables) -> DataFrame:
    return ordered.next_fit(
        t.media_files.select("id", "storage_location_id", "size_bytes"),
        "storage_location_id",
        ["id"],
        "size_bytes",
        20_000,
    ).select("id", "storage_location_id", "bin")


@query(f"""
    WITH c AS (SELECT id, size_bytes AS s, (size_bytes + {MAX - scalars.MIB - 1}) // {MAX - scalars.MIB} AS k FROM media_files WHERE size_bytes > {MAX - scalars.MIB}),
         p AS (SELECT id, s, k, (s + k - 1) // k AS q, unnest(generate_series(1, k)) AS part FROM c)
    SELECT id, part::INTEGER AS part, (CASE WHEN part < k THEN q ELSE s - q * (k - 1) END)::BIGINT AS length, (q * (part - 1))::BIGINT AS start FROM p
""")
def split_plan(t: Tables) -> DataFrame:
    return backup.split_plan(t.media_files, MAX)


_MEMBERS = f"""
    m AS (SELECT 900000 + id % 40 AS archive_id, id AS media_file_id, {DESTINATION} AS destination_id, sha256, 0 AS part_index, id * 1024 AS o, size_bytes AS n FROM media_files WHERE NOT is_missing
          UNION ALL SELECT 900000 + id % 40, id, {DESTINATION + 1}, sha256, 0, id * 1024, size_bytes FROM media_files WHERE watched),
    fr AS (SELECT m.media_file_id, m.destination_id, row_number() OVER (ORDER BY m.media_file_id, m.destination_id) AS k FROM m ANTI JOIN backup_records r ON r.media_file_id = m.media_file_id AND r.destination_id = m.destination_id),
    nr AS (SELECT r.id, r.media_file_id, r.destination_id, coalesce(m.sha256, r.sha256) AS sha256, CASE WHEN m.sha256 IS NOT NULL THEN 'done' ELSE r.status END AS status FROM backup_records r LEFT JOIN m ON m.media_file_id = r.media_file_id AND m.destination_id = r.destination_id
           UNION ALL SELECT (SELECT max(id) FROM backup_records) + k, fr.media_file_id, fr.destination_id, m.sha256, 'done' FROM fr JOIN m ON m.media_file_id = fr.media_file_id AND m.destination_id = fr.destination_id)
"""


def _recorded(t: Tables) -> tuple[DataFrame, DataFrame]:
    """What a run that stored all files that are there at one archive, and the watched ones at another too, makes of
    the ledger.
    """
    number = lambda x: F.lit(x).cast("long")
    at = F.when(
        F.col("watched"), F.array(number(DESTINATION), number(DESTINATION + 1))
    ).otherwise(F.array(number(DESTINATION)))
    each = t.media_files.withColumn("destination_id", F.explode(at)).filter(
        ~F.col("is_missing") | (F.col("destination_id") != DESTINATION)
    )
    archive = (F.col("id") % 40 + 900_000).alias("archive_id")
    members = each.select(
        archive,
        F.col("id").alias("media_file_id"),
        "destination_id",
        "sha256",
        number(0).alias("part_index"),
        (F.col("id") * 1024).alias("offset"),
        F.col("size_bytes").alias("length"),
    )
    return backup.record_archives(members, t.backup_records, t.backup_record_archives)


@query(f"""
    WITH {_MEMBERS}, x AS (SELECT nr.id, m.media_file_id, m.archive_id, m.part_index, m.o, m.n FROM m JOIN nr ON nr.media_file_id = m.media_file_id AND nr.destination_id = m.destination_id)
    SELECT id AS backup_record_id, archive_id AS backup_archive_id, part_index::BIGINT AS part_index, o AS "offset", n AS length FROM x
    UNION ALL SELECT backup_record_id, backup_archive_id, part_index, archive_offset, archive_length FROM backup_record_archives WHERE backup_record_id NOT IN (SELECT id FROM x)
""")
def record_archives(t: Tables) -> DataFrame:
    return _recorded(t)[1]


@query(f"WITH {_MEMBERS} SELECT id, media_file_id, destination_id, sha256, status FROM nr")
def archive_records(t: Tables) -> DataFrame:
    return _recorded(t)[0]


@query("""
    WITH e AS (SELECT archive_id, object, archive_type, encrypted, sha256, min(entry_size) AS size, min(entry_offset) AS o, $LIST('"' || local_path || '"') AS p FROM index_entries GROUP BY 1, 2, 3, 4, 5),
         k AS (SELECT *, CASE WHEN encrypted THEN $SHA('id:' || sha256) ELSE sha256 END AS name FROM e)
    SELECT archive_id, '{"v":1,"archive_id":"' || archive_id || '","object":"' || object || '","type":"' || archive_type || '","created_at":"2023-11-14T22:13:20Z","size":' || sum(size) || ',"files":{' ||
           string_agg('"' || name || '":{"size":' || size || ',"mtime":"2023-11-14T22:13:20Z","member":"' || name || '.file","offset":' || o || CASE WHEN encrypted THEN ',"paths_enc":"' || md5(p) || '"' ELSE ',"paths":[' || p || ']' END ||
                      CASE WHEN archive_type = 'part' THEN ',"part":1,"parts":2' ELSE '' END || CASE WHEN encrypted THEN ',"sha256_enc":"' || md5(sha256) || '"' ELSE '' END || '}', ',' ORDER BY name) || '}' ||
           CASE WHEN encrypted THEN ',"key_scheme":"content_id_v1","key_check":"' || substr(md5(archive_id), 1, 16) || '","encrypted":true' ELSE '' END || '}' AS body
    FROM k GROUP BY archive_id, object, archive_type, encrypted
""")
def build_index(t: Tables) -> DataFrame:
    """Plain and keyed archives. A digest stands for the sealed hash and paths, since SQL engines can't seal (see
    discover_sealed).
    """
    # dealt out once: groups of an archive and sums over it find their rows where they are
    one = t.index_entries.repartition("archive_id").groupBy("archive_id", "object", F.col("archive_type").alias("type"), "encrypted", "sha256")
    members = one.agg(
        F.min("entry_size").alias("size"),
        F.min("entry_offset").alias("offset"),
        F.array_sort(F.collect_list("local_path")).alias("paths"),
    )
    keyed, is_part = F.col("encrypted"), F.col("type") == "part"
    listed = F.array_join(F.transform("paths", lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ",")
    sealed = members.withColumns({
        "content_id": F.when(
            keyed, F.sha2(F.concat(F.lit("id:"), "sha256"), 256)
        ), "sha256_enc": F.when(keyed, F.md5("sha256")), "paths_enc": F.when(keyed, F.md5(listed)),
        "created_at": F.lit("2023-11-14T22:13:20Z"), "mtime": F.lit(
            "2023-11-14T22:13:20Z"
        ), "compression": F.lit(None).cast("string"), "part": F.when(is_part, 1), "parts": F.when(is_part, 2),
        "key_check": F.substring(F.md5("archive_id"), 1, 16),
    })
    size = F.sum("size").over(Window.partitionBy("archive_id"))
    named = sealed.withColumn("archive_size", size).withColumn(
        "member", F.concat(F.coalesce("content_id", "sha256"), F.lit(".file"))
    ).withColumn("paths", F.when(~keyed, F.col("paths")))
    return backup.build_index(named)


@query("SELECT id, coalesce(encrypted, true) AS encrypted FROM storage_locations WHERE NOT is_backup_target")
def effective_encryption(t: Tables) -> DataFrame:
    return backup.effective_encryption(t.storage_locations.filter("not is_backup_target"), True)


@query(
    "SELECT l.id, string_split(a.path, '/')[1] AS bucket, 'base/' || CASE WHEN l.archive_subpath IS NULL THEN '' ELSE l.archive_subpath || '/' END AS prefix FROM storage_locations l JOIN storage_locations a ON a.id = l.archive_location_id WHERE NOT l.is_backup_target"
)
def target_prefix(t: Tables) -> DataFrame:
    return backup.target_prefix(t.storage_locations)


@query("""
    SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'bucket' WHEN 2 THEN 'parent' END AS problem FROM part
""")
def path_errors(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 6 == 0, "  ").when(
        F.col("p_partkey") % 6 == 1, F.concat(F.lit("Bad_"), "p_brand")
    ).when(F.col("p_partkey") % 6 == 2, F.concat(F.lit("good-bucket/a/../"), "p_name")).otherwise(F.concat(F.lit("good-bucket/"), "p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), paths.path_error(name).alias("problem"))


@query("""
    SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'gs' WHEN 1 THEN 'gs' WHEN 2 THEN 's3' WHEN 3 THEN 's3' WHEN 4 THEN '' WHEN 5 THEN 'gs' WHEN 6 THEN 's3' ELSE 'gs' END AS scheme,
           CASE p_partkey % 8 WHEN 0 THEN 'bucket-' || p_size WHEN 1 THEN 'legacy_' || p_size WHEN 2 THEN 'bucket.' || p_size WHEN 3 THEN 'bad_' || p_size WHEN 4 THEN '' WHEN 5 THEN '-bad' WHEN 6 THEN 'bucket' ELSE 'bucket' END AS bucket,
           CASE p_partkey % 8 WHEN 0 THEN 'a/b' || p_size || '/' WHEN 1 THEN '' WHEN 2 THEN 'x/y/' WHEN 3 THEN '' WHEN 4 THEN 'mnt/x/' WHEN 5 THEN '' WHEN 6 THEN '-' ELSE 'f ' || p_size || '/g/' END AS prefix,
           CASE p_partkey % 8 WHEN 3 THEN 'bucket' WHEN 4 THEN 'scheme' WHEN 5 THEN 'bucket' WHEN 6 THEN 'scheme' END AS problem,
           CASE p_partkey % 8 WHEN 0 THEN 'gs://bucket-' || p_size || '/a/b' || p_size WHEN 1 THEN 'gs://legacy_' || p_size WHEN 7 THEN 'gs://bucket/f ' || p_size || '/g' END AS canonical
    FROM part
""")
def bucket_schemes(t: Tables) -> DataFrame:
    """Paths with schemes of both kinds, blanks, backslashes, empty and dotted components, and names that are
    refused.
    """
    size, case = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    made = [
        F.concat(
            F.lit("  GS://bucket-"), size, F.lit("//a/./b"), size, F.lit("/ ")
        ), F.concat(F.lit("gcs://legacy_"), size), F.concat(F.lit("s3://bucket."), size, F.lit("/x\\y")),
        F.concat(F.lit("s3://bad_"), size), F.lit("/mnt/x"), F.lit("gs://-bad"), F.lit("S3://bucket/../up"), F.concat(
            F.lit("gs://bucket/ f "), size, F.lit(" /g//")
        ),
    ]
    path = F.lit(None).cast("string")
    for k, x in enumerate(made):
        path = F.when(case == k, x).otherwise(path)
    named, kind = t.part.withColumn("path", path), F.when(case.isin(2, 3), "s3").otherwise("gs")
    wanted = F.when(
        kind == "s3", paths.path_error(F.col("path"), "s3")
    ).otherwise(paths.path_error(F.col("path"), "gs"))
    parts = named.select(
        F.col("p_partkey").alias("id"),
        case.alias("case"),
        paths.scheme(F.col("path")).alias("scheme"),
        paths.bucket(F.col("path")).alias("bucket"),
        paths.bucket_prefix(F.col("path")).alias("p"),
        wanted.alias("problem"),
    )
    whole = F.when(
        F.col("problem").isNull() & (F.col("scheme") == "gs"),
        paths.format_bucket_path("gs", F.col("bucket"), F.col("p")),
    )
    return parts.select(
        "id", "scheme", "bucket", F.coalesce("p", F.lit("-")).alias("prefix"), "problem", whole.alias("canonical")
    )
