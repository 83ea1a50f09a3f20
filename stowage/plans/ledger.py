"""Ledger queries: parts, ranges, inventory, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths, scalars
from stowage.operators import discovery, ledger
from stowage.plans.registry import query
from stowage.session import settle
from stowage.sources.views import Tables

U = paths.UUID
_TRUST = "tr AS (SELECT * FROM backup_archives WHERE archive_id IS NOT NULL AND indexed_at IS NOT NULL)"


@query(
    "SELECT key, size, coalesce(storage_class, '-') AS storage_class FROM object_listing WHERE starts_with(key, 'vault/O/')"
)
def listing_prefix(t: Tables) -> DataFrame:
    return t.object_listing.filter(F.startswith("key", F.lit("vault/O/"))).select(
        "key", "size", F.coalesce("storage_class", F.lit("-")).alias("storage_class")
    )


@query(
    "SELECT DISTINCT string_split(substr(key, 7), '/')[1] AS folder FROM object_listing WHERE starts_with(key, 'vault/') AND contains(substr(key, 7), '/')"
)
def listing_subfolders(t: Tables) -> DataFrame:
    rest = F.substring("key", F.lit(7), F.length("key"))
    return t.object_listing.filter(F.startswith("key", F.lit("vault/"))).filter(F.contains(rest, F.lit("/"))).select(
        F.split(rest, "/")[0].alias("folder")
    ).distinct()


@query(f"""
    WITH {_TRUST} SELECT r.id, r.media_file_id, string_agg(l.part_index || ':' || tr.path || ':' || l.archive_offset || ':' || l.archive_length, '|' ORDER BY l.part_index) AS parts, sum(l.archive_length)::BIGINT AS stored_bytes
    FROM backup_records r JOIN backup_record_archives l ON l.backup_record_id = r.id JOIN tr ON tr.id = l.backup_archive_id GROUP BY r.id, r.media_file_id
""")
def ledger_parts(t: Tables) -> DataFrame:
    parts = ledger.ledger_parts(t.backup_records, t.backup_record_archives, t.backup_archives)
    text = F.array_join(
        F.transform(
            "parts",
            lambda p: F.concat_ws(
                ":",
                p["part_index"].cast("string"),
                p["path"],
                p["archive_offset"].cast("string"),
                p["archive_length"].cast("string"),
            ),
        ),
        "|",
    )
    return parts.select("id", "media_file_id", text.alias("parts"), "stored_bytes")


@query("""
    WITH p AS (SELECT *, coalesce(sum(archive_length) OVER (PARTITION BY backup_record_id ORDER BY part_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM backup_record_archives)
    SELECT backup_record_id, backup_archive_id, (archive_offset + greatest(20000, f) - f)::BIGINT AS "offset", (least(70000, f + archive_length) - greatest(20000, f))::BIGINT AS length FROM p WHERE greatest(20000, f) < least(70000, f + archive_length)
""")
def stored_pieces(t: Tables) -> DataFrame:
    return ledger.stored_pieces(t.backup_record_archives, F.lit(20_000), F.lit(50_000))


SAMPLE, BUDGET, GAP = 64 * 1024, 256 * 1024, 16 * 1024
_PIECES = f"""
    {_TRUST}, j AS (SELECT l.*, tr.encrypted, coalesce(sum(archive_length) OVER w, 0) AS f FROM backup_record_archives l JOIN tr ON tr.id = l.backup_archive_id WINDOW w AS (PARTITION BY backup_record_id ORDER BY part_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT backup_record_id, sum(archive_length) AS total, arg_min(encrypted, part_index) AS enc FROM j GROUP BY 1),
    r AS (SELECT backup_record_id, 0 AS a, total AS n FROM s WHERE (enc AND total <= {BUDGET + 36}) OR (NOT enc AND total <= {2 * SAMPLE}) UNION ALL SELECT backup_record_id, 0, {SAMPLE} FROM s WHERE NOT enc AND total > {2 * SAMPLE} UNION ALL SELECT backup_record_id, total - {SAMPLE}, {SAMPLE} FROM s WHERE NOT enc AND total > {2 * SAMPLE}),
    p AS (SELECT backup_record_id, backup_archive_id, (archive_offset + greatest(a, f) - f)::BIGINT AS o, (least(a + n, f + archive_length) - greatest(a, f))::BIGINT AS len FROM j JOIN r USING (backup_record_id) WHERE greatest(a, f) < least(a + n, f + archive_length))
"""


def _wanted(t: Tables) -> DataFrame:
    return ledger.wanted_pieces(t.backup_records, t.backup_record_archives, t.backup_archives, SAMPLE, BUDGET)


@query(f'WITH {_PIECES} SELECT backup_record_id, backup_archive_id, o AS "offset", len AS length FROM p')
def wanted_ranges(t: Tables) -> DataFrame:
    return _wanted(t).drop("at")


_MERGED = f"""
    {_PIECES}, e AS (SELECT backup_archive_id, o, o + len AS e, max(o + len) OVER (PARTITION BY backup_archive_id ORDER BY o, o + len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR o - reach > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY backup_archive_id ORDER BY o, e ROWS UNBOUNDED PRECEDING) AS run FROM e)
"""


@query(
    f'WITH {_MERGED} SELECT backup_archive_id, min(o) AS "offset", max(e) - min(o) AS length FROM g GROUP BY backup_archive_id, run'
)
def merge_ranges(t: Tables) -> DataFrame:
    return ledger.merge_ranges(_wanted(t), GAP)


_FOUND = f"""
    f AS (SELECT key, CASE WHEN regexp_matches(key, '^((?:.*/)?)archives/({U})\\.tar$') THEN regexp_extract(key, '^((?:.*/)?)archives/', 1) ELSE regexp_extract(key, '^((?:.*/)?)({U})\\.tar$', 1) END AS folder, regexp_extract(key, '({U})\\.tar$', 1) AS ident, size FROM object_listing WHERE regexp_matches(key, '^(?:.*/)?{U}\\.tar$')),
    x AS (SELECT key, CASE WHEN regexp_matches(key, '^((?:.*/)?)index/({U})\\.json$') THEN regexp_extract(key, '^((?:.*/)?)index/', 1) ELSE regexp_extract(key, '^((?:.*/)?)({U})\\.json$', 1) END AS folder, regexp_extract(key, '({U})\\.json$', 1) AS ident FROM object_listing WHERE regexp_matches(key, '^(?:.*/)?{U}\\.json$'))
"""


@query(f"""
    WITH {_FOUND}
    SELECT key, 'untracked' AS finding FROM f WHERE key NOT IN (SELECT path FROM backup_archives) UNION ALL SELECT DISTINCT path, 'missing' FROM backup_archives WHERE path NOT IN (SELECT key FROM f)
    UNION ALL SELECT f.key, 'no_index' FROM f ANTI JOIN x ON x.folder = f.folder AND x.ident = f.ident UNION ALL SELECT x.key, 'orphan_index' FROM x ANTI JOIN f ON x.folder = f.folder AND x.ident = f.ident
""")
def inventory_reconcile(t: Tables) -> DataFrame:
    return ledger.inventory(t.object_listing, t.backup_archives)


@query(
    f"WITH {_FOUND} SELECT f.key AS archive_key, x.key AS index_key FROM f JOIN x ON x.folder = f.folder AND x.ident = f.ident"
)
def inventory_pairs(t: Tables) -> DataFrame:
    archives = t.backup_archives.select(F.col("path").alias("archive_key"))
    listed = t.object_listing.select("key").distinct()
    tracked = t.object_listing.filter(
        paths.archive_parts(F.col("key"))[1].isNotNull()
    ).select(F.col("key").alias("archive_key")).unionByName(archives).distinct()
    pairs = tracked.join(
        listed.withColumnRenamed("key", "archive_key"), "archive_key", "left_semi"
    ).withColumn("index_key", paths.index_key(F.col("archive_key")))
    return pairs.join(listed.withColumnRenamed("key", "index_key"), "index_key", "left_semi")


@query(
    f"WITH {_FOUND} SELECT count(*)::BIGINT AS found_count, sum(size)::BIGINT AS found_size, count(*) FILTER (NOT EXISTS (SELECT 1 FROM x WHERE x.folder = f.folder AND x.ident = f.ident))::BIGINT AS no_index_count FROM f"
)
def discover_report(t: Tables) -> DataFrame:
    return ledger.discover_report(t.object_listing)


@query(
    "SELECT regexp_extract(path, '^(.*/)[^/]*$', 1) AS prefix, count(*)::BIGINT AS archives FROM backup_archives GROUP BY 1"
)
def prefix_counts(t: Tables) -> DataFrame:
    return ledger.prefix_counts(t.backup_archives)


@query(
    "SELECT a.id, coalesce(k.id, (SELECT max(id) FROM backup_key_versions WHERE retired_at IS NULL)) AS key_id FROM backup_archives a LEFT JOIN backup_key_versions k ON k.id = a.key_version_id"
)
def archive_key(t: Tables) -> DataFrame:
    return ledger.archive_key(t.backup_archives, t.backup_key_versions)


_ENTRIES = """
    ie AS (SELECT json_extract_string(body, '$.archive_id') AS archive_id, json_extract(body, '$.files') AS files FROM index_documents WHERE json_valid(body)),
    ee AS (SELECT archive_id, k AS entry_key, json_extract(files, '$."' || k || '"') AS e FROM (SELECT archive_id, files, unnest(json_keys(files)) AS k FROM ie WHERE archive_id IS NOT NULL))
"""


def _entries(t: Tables) -> DataFrame:
    e = discovery.entries(discovery.parse_index(t.index_documents))
    return e.select(
        "archive_id",
        F.col("key").alias("entry_key"),
        F.col("entry.offset").alias("entry_offset"),
        F.col("entry.compression").alias("entry_compression"),
    )


def _content_id(sha256: str = "sha256"):
    return F.sha2(F.concat(F.lit("id:"), sha256), 256)


@query(f"""
    WITH {_TRUST}, {_ENTRIES} SELECT l.backup_record_id, l.part_index, tr.archive_id, coalesce(json_extract(ee.e, '$.offset')::BIGINT, -1) AS entry_offset
    FROM backup_record_archives l JOIN tr ON tr.id = l.backup_archive_id JOIN backup_records r ON r.id = l.backup_record_id LEFT JOIN ee ON ee.archive_id = tr.archive_id AND ee.entry_key = CASE WHEN tr.encrypted THEN $SHA('id:' || r.sha256) ELSE r.sha256 END
""")
def index_entry_lookup(t: Tables) -> DataFrame:
    found = ledger.index_entry_lookup(
        t.backup_records, t.backup_record_archives, t.backup_archives, _entries(t), _content_id()
    )
    return found.select(
        "backup_record_id", "part_index", "archive_id", F.coalesce("entry_offset", F.lit(-1)).alias("entry_offset")
    )


_VERDICTS = f"""
    {_TRUST}, {_ENTRIES},
    q AS (SELECT l.backup_record_id, l.part_index, CASE WHEN o.key IS NULL THEN '1missing' WHEN o.size <> tr.size_bytes OR (tr.crc32c IS NOT NULL AND tr.crc32c IS DISTINCT FROM o.crc32c) THEN '1mismatch'
                      WHEN i.archive_id IS NULL THEN '2missing' WHEN ee.e IS NULL OR (tr.archive_type <> 'part' AND json_extract(ee.e, '$.offset')::BIGINT <> l.archive_offset) OR json_extract_string(ee.e, '$.compression') IS DISTINCT FROM r.compression THEN '2mismatch' END AS bad
          FROM backup_record_archives l JOIN tr ON tr.id = l.backup_archive_id JOIN backup_records r ON r.id = l.backup_record_id LEFT JOIN object_listing o ON o.key = tr.path LEFT JOIN (SELECT DISTINCT archive_id FROM ie) i ON i.archive_id = tr.archive_id
               LEFT JOIN ee ON ee.archive_id = tr.archive_id AND ee.entry_key = CASE WHEN tr.encrypted THEN $SHA('id:' || r.sha256) ELSE r.sha256 END),
    v AS (SELECT backup_record_id, arg_min(substr(bad, 2), substr(bad, 1, 1) || lpad(part_index::VARCHAR, 9, '0')) AS verdict FROM q GROUP BY 1),
    u AS (SELECT r.id, coalesce(v.verdict, CASE WHEN r.media_file_id % 8 = 3 THEN 'changed' ELSE 'match' END) AS verdict FROM backup_records r JOIN v ON v.backup_record_id = r.id)
"""


def _verdicts(t: Tables) -> DataFrame:
    """The index documents are parsed once and kept as narrow rows, with one of null key for each document, so that an
    index without the entry differs from none.
    """
    parsed = discovery.parse_index(t.index_documents).filter("archive_id is not null")
    entry = F.explode(
        F.concat(
            F.map_entries(
                F.when(
                    F.col("bad"), F.create_map().cast("map<string," + discovery.ENTRY + ">")
                ).otherwise(F.col("files"))
            ),
            F.array(F.lit(None).cast("struct<key:string,value:" + discovery.ENTRY + ">")),
        )
    )
    rows = parsed.select("archive_id", entry.alias("e")).select(
        "archive_id",
        F.col("e.key").alias("entry_key"),
        F.col("e.value.offset").alias("entry_offset"),
        F.col("e.value.compression").alias("entry_compression"),
    )
    local = t.media_files.select(F.col("id").alias("media_file_id"), (F.col("id") % 8 != 3).alias("same"))
    return ledger.verify_shallow(
        t.backup_records,
        t.backup_record_archives,
        t.backup_archives,
        t.object_listing,
        settle(rows, "index-entries"),
        _content_id(),
        local,
    )


@query(f"WITH {_VERDICTS} SELECT id, verdict FROM u")
def verify_shallow(t: Tables) -> DataFrame:
    return _verdicts(t)


@query(f"WITH {_VERDICTS} SELECT verdict, count(*)::BIGINT AS records FROM u GROUP BY 1")
def verify_counts(t: Tables) -> DataFrame:
    return _verdicts(t).groupBy("verdict").agg(F.count(F.lit(1)).alias("records"))


@query(
    f"WITH {_VERDICTS} SELECT r.id, coalesce(u.verdict, r.verify_status) AS verify_status, u.verdict IS NOT NULL AS verified FROM backup_records r LEFT JOIN u ON u.id = r.id"
)
def verify_apply(t: Tables) -> DataFrame:
    return ledger.verify_apply(t.backup_records, _verdicts(t))


@query(f"""
    WITH {_TRUST}, fi AS (SELECT backup_record_id, arg_min(l.backup_archive_id, part_index) AS aid, arg_min(archive_offset, part_index) AS off FROM backup_record_archives l JOIN tr ON tr.id = l.backup_archive_id GROUP BY 1),
         b AS (SELECT media_file_id, min(r.id) AS rid FROM backup_records r JOIN fi ON fi.backup_record_id = r.id WHERE status = 'done' GROUP BY 1),
         z AS (SELECT m.id, b.rid, r.mtime_ns AS st, fi.aid, fi.off, (SELECT max(s.mtime_ns) FROM listing s WHERE s.path = m.path) AS loc FROM media_files m LEFT JOIN b ON b.media_file_id = m.id LEFT JOIN backup_records r ON r.id = b.rid LEFT JOIN fi ON fi.backup_record_id = b.rid)
    SELECT id, CASE WHEN rid IS NULL THEN 'failed' WHEN coalesce(loc >= st, false) THEN 'skipped' ELSE 'restore' END AS action, coalesce(rid, -1) AS record_id, coalesce(aid, -1) AS archive_id, coalesce(off, -1) AS archive_offset FROM z
""")
def restore_plan(t: Tables) -> DataFrame:
    return ledger.restore_plan(
        t.media_files.select("id", "path"), t.backup_records, t.backup_record_archives, t.backup_archives, t.listing
    )


@query(f"""
    WITH {_TRUST}, fi AS (SELECT DISTINCT backup_record_id FROM backup_record_archives l JOIN tr ON tr.id = l.backup_archive_id), b AS (SELECT media_file_id, arg_min(mtime_ns, r.id) FILTER (mtime_ns IS NOT NULL OR true) AS x, min(r.id) AS rid FROM backup_records r JOIN fi ON fi.backup_record_id = r.id WHERE status = 'done' GROUP BY 1),
         z AS (SELECT m.id, m.path, b.rid, r.mtime_ns AS st, (SELECT max(s.mtime_ns) FROM listing s WHERE s.path = m.path) AS loc FROM media_files m LEFT JOIN b ON b.media_file_id = m.id LEFT JOIN backup_records r ON r.id = b.rid)
    SELECT path, CASE WHEN rid IS NULL THEN 'failed' WHEN coalesce(loc >= st, false) THEN 'skipped' ELSE 'restored' END AS status, CASE WHEN rid IS NULL THEN 'no completed backup' WHEN coalesce(loc >= st, false) THEN 'local file is newer' ELSE '' END AS detail FROM z
""")
def restore_results(t: Tables) -> DataFrame:
    files = t.media_files.select("id", "path")
    plan = ledger.restore_plan(files, t.backup_records, t.backup_record_archives, t.backup_archives, t.listing)
    status = F.when(F.col("action") == "restore", "restored").otherwise(F.col("action"))
    detail = F.when(F.col("action") == "failed", "no completed backup").when(
        F.col("action") == "skipped", "local file is newer"
    ).otherwise("")
    return files.join(plan, "id").select("path", status.alias("status"), detail.alias("detail"))


@query("""
    SELECT path, CASE WHEN o.key IS NULL THEN 'absent' WHEN o.size <> a.size_bytes THEN 'size' ELSE 'checksum' END AS problem FROM backup_archives a LEFT JOIN object_listing o ON o.key = a.path
    WHERE o.key IS NULL OR o.size <> a.size_bytes OR (a.crc32c IS NOT NULL AND a.crc32c IS DISTINCT FROM o.crc32c)
""")
def upload_confirm(t: Tables) -> DataFrame:
    return ledger.upload_confirm(t.backup_archives, t.object_listing)


@query(
    "SELECT m.id, m.size_bytes, least(m.size_bytes, 65536) AS first_length, CASE WHEN m.size_bytes <= 131072 THEN 1 ELSE 2 END AS ranges FROM media_files m"
)
def sample_ranges(t: Tables) -> DataFrame:
    want = scalars.wanted_ranges(F.col("size_bytes"), F.lit(False), SAMPLE, BUDGET)
    first = F.when(F.size(want) == 1, F.least("size_bytes", F.lit(65536))).otherwise(want[0]["length"])
    return t.media_files.select("id", "size_bytes", first.alias("first_length"), F.size(want).alias("ranges"))
