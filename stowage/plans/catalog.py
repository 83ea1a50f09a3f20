"""Catalog queries: scans, merges, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.operators import catalog, patterns
from stowage.plans.registry import query
from stowage.sources.views import Tables

_TYPES = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in names)}) THEN '{kind}'" for kind, names in catalog.EXTENSIONS.items()) + " END"
_GATED = f"""
    n AS (SELECT s.path, s.size, s.storage_location_id, string_split(s.path, '/')[-1] AS filename, lower(regexp_extract(string_split(s.path, '/')[-1], '^.+\\.([^./]*)$', 1)) AS ext FROM listing s),
    g AS (SELECT n.*, l.path AS root, l.media_type AS lt, {_TYPES} AS owner FROM n JOIN storage_locations l ON l.id = n.storage_location_id),
    k AS (SELECT *, CASE WHEN lt = 'files' THEN coalesce(owner, 'files') ELSE lt END AS media_type FROM g WHERE ext NOT IN ('nfo', 'mbcopy', 'tmp') AND (lt = 'files' OR owner = lt))
"""


def _gated(t: Tables) -> DataFrame:
    return catalog.gate_and_tag(t.listing, t.storage_locations)


@query("SELECT path, size, mtime_ns FROM listing")
def scan_listing(t: Tables) -> DataFrame:
    """A listing that the caller supplies; sources.listing makes one of a folder."""
    return t.listing.select("path", "size", "mtime_ns")


@query(
    "SELECT l.id, count(s.path)::BIGINT AS files, coalesce(sum(s.size), 0)::BIGINT AS bytes FROM storage_locations l LEFT JOIN listing s ON s.storage_location_id = l.id WHERE NOT l.is_backup_target AND NOT l.untracked GROUP BY l.id"
)
def scan_totals(t: Tables) -> DataFrame:
    wanted = t.storage_locations.filter("not is_backup_target and not untracked").select("id")
    return wanted.join(t.listing, F.col("id") == F.col("storage_location_id"), "left").groupBy("id").agg(
        F.count("path").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )


@query(f"WITH {_GATED} SELECT path, filename, ext AS extension FROM k")
def ext_gate(t: Tables) -> DataFrame:
    return _gated(t).select("path", "filename", "extension")


@query(f"WITH {_GATED} SELECT media_type, count(*)::BIGINT AS files FROM k GROUP BY 1")
def media_type_tag(t: Tables) -> DataFrame:
    return _gated(t).groupBy("media_type").agg(F.count(F.lit(1)).alias("files"))


@query(
    f"WITH {_GATED} SELECT path, CASE WHEN len(string_split(substr(path, length(root) + 2), '/')) > 1 THEN string_split(substr(path, length(root) + 2), '/')[1] END AS genre FROM k"
)
def folder_category(t: Tables) -> DataFrame:
    return _gated(t).select("path", "genre")


@query(
    "SELECT m.id, CASE WHEN starts_with(m.path, '/mnt/src1/') THEN substr(m.path, 11) ELSE m.filename END AS rel_path FROM media_files m"
)
def rel_path(t: Tables) -> DataFrame:
    return t.media_files.select("id", paths.relative(F.col("path"), F.lit("/mnt/src1")).alias("rel_path"))


_DIFF = """
    d AS (SELECT coalesce(s.path, f.path) AS path, f.id, f.fingerprint,
                 CASE WHEN f.id IS NULL THEN 'added' WHEN s.path IS NULL THEN 'unseen' WHEN s.size <> f.size_bytes OR s.mtime_ns <> f.mtime_ns THEN 'changed' ELSE 'updated' END AS change
          FROM listing s FULL JOIN media_files f ON s.path = f.path)
"""


@query(
    f"WITH {_DIFF} SELECT path, id, change, change IN ('added', 'changed') OR (change = 'updated' AND fingerprint IS NULL) AS refingerprint FROM d"
)
def scan_diff(t: Tables) -> DataFrame:
    return catalog.scan_diff(t.listing, t.media_files)


@query(
    f"WITH {_GATED} SELECT m.id, m.path FROM media_files m WHERE NOT m.is_missing AND m.path NOT IN (SELECT path FROM k) AND m.path NOT IN (SELECT path FROM listing)"
)
def missing_files(t: Tables) -> DataFrame:
    return catalog.missing_files(t.media_files, _gated(t), t.listing).select("id", "path")


@query("""
    SELECT f.id, f.path, coalesce(s.size, f.size_bytes) AS size_bytes, coalesce(s.mtime_ns, f.mtime_ns) AS mtime_ns, s.path IS NULL AS is_missing FROM media_files f LEFT JOIN listing s ON s.path = f.path
    UNION ALL
    SELECT (SELECT max(id) FROM media_files) + row_number() OVER (ORDER BY s.path), s.path, s.size, s.mtime_ns, false FROM listing s WHERE s.path NOT IN (SELECT path FROM media_files)
""")
def catalog_upsert(t: Tables) -> DataFrame:
    return catalog.catalog_upsert(t.listing, t.media_files)


@query("""
    WITH a AS (SELECT id, path, filename, fingerprint, storage_location_id FROM media_files UNION ALL SELECT id + 10000000, replace(path, '/mnt/', '/old/'), filename, fingerprint, storage_location_id FROM media_files WHERE id % 6 = 0),
         b AS (SELECT media_file_id AS id FROM backup_records WHERE id % 3 <> 0 UNION ALL SELECT media_file_id + 10000000 FROM backup_records WHERE id % 2 = 0),
         k AS (SELECT a.*, starts_with(a.path, l.path || '/') AS inside FROM a JOIN storage_locations l ON l.id = a.storage_location_id WHERE fingerprint IS NOT NULL),
         v AS (SELECT storage_location_id, filename, fingerprint, min(id) AS live_id FROM k WHERE inside GROUP BY ALL HAVING count(*) = 1),
         o AS (SELECT storage_location_id, filename, fingerprint, min(id) AS stale_id FROM k WHERE NOT inside GROUP BY ALL)
    SELECT stale_id, live_id, CASE WHEN stale_id IN (SELECT id FROM b) AND live_id IN (SELECT id FROM b) THEN 'keep both' WHEN stale_id IN (SELECT id FROM b) OR live_id NOT IN (SELECT id FROM b) THEN 'repoint' ELSE 'drop_stale' END AS action
    FROM o JOIN v USING (storage_location_id, filename, fingerprint)
""")
def merge_stale(t: Tables) -> DataFrame:
    columns = ["id", "path", "filename", "fingerprint", "storage_location_id"]
    files = t.media_files.select(*columns)
    moved = files.filter("id % 6 = 0").withColumn("id", F.col("id") + 10_000_000).withColumn(
        "path", F.replace("path", F.lit("/mnt/"), F.lit("/old/"))
    )
    records = t.backup_records.filter("id % 3 <> 0").select("media_file_id").union(
        t.backup_records.filter("id % 2 = 0").select(F.col("media_file_id") + 10_000_000)
    )
    return catalog.merge_stale(files.unionByName(moved), records, t.storage_locations)


@query(
    "SELECT id FROM media_files WHERE storage_location_id = 103 AND id IN (SELECT p_partkey FROM part WHERE p_size > 25)"
)
def select_ids(t: Tables) -> DataFrame:
    return catalog.select_ids(
        t.media_files, t.part.filter("p_size > 25").select(F.col("p_partkey").alias("id")), 103
    ).select("id")


_FOLDERS = "w AS (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN '/mnt/' || source ELSE '/mnt/' || source || '/' || genre END AS folder FROM media_files WHERE id % 71 = 0)"


def _folders(t: Tables) -> DataFrame:
    folder = F.when(
        F.col("id") % 2 == 0, F.concat(F.lit("/mnt/"), "source")
    ).otherwise(F.concat(F.lit("/mnt/"), "source", F.lit("/"), "genre"))
    return t.media_files.filter("id % 71 = 0").select(folder.alias("folder")).distinct()


@query(f"WITH {_FOLDERS} SELECT DISTINCT m.id FROM media_files m JOIN w ON starts_with(m.path, w.folder || '/')")
def folder_expand(t: Tables) -> DataFrame:
    return catalog.folder_expand(t.media_files.select("id", "path"), _folders(t))


@query(
    f"WITH {_FOLDERS} SELECT id FROM media_files WHERE id % 5 = 0 UNION SELECT m.id FROM media_files m JOIN w ON starts_with(m.path, w.folder || '/')"
)
def bulk_select(t: Tables) -> DataFrame:
    return catalog.bulk_select(
        t.media_files.select("id", "path"),
        t.documents.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("id")),
        _folders(t),
    )


_ITEMS = """
    i AS (SELECT user_id, unnest(from_json(json_extract(body, '$.Items'), '["json"]')) AS j FROM watch_pages),
    w AS (SELECT user_id, json_extract_string(j, '$.Id') AS Id, json_extract_string(j, '$.Path') AS Path, json_extract(j, '$.UserData.Played')::BOOLEAN AS Played, json_extract(j, '$.UserData.PlayCount')::BIGINT AS PlayCount, json_extract_string(j, '$.UserData.LastPlayedDate') AS LastPlayedDate FROM i)
"""


@query(f"WITH {_ITEMS} SELECT user_id, Id, Path, Played, PlayCount, LastPlayedDate FROM w")
def watch_items(t: Tables) -> DataFrame:
    return catalog.watch_items(t.watch_pages)


@query(f"""
    WITH {_ITEMS}, s AS (SELECT '/mnt' || substr(Path, 7) AS path, w.* FROM w WHERE starts_with(Path, '/media')), b AS (SELECT *, row_number() OVER (PARTITION BY s.path ORDER BY length(Id) DESC, Id DESC) AS r FROM s)
    SELECT m.id, Played AS watched, PlayCount AS play_count, LastPlayedDate AS last_played FROM b JOIN media_files m ON m.path = b.path WHERE r = 1
""")
def watch_sync(t: Tables) -> DataFrame:
    return catalog.watch_sync(catalog.watch_items(t.watch_pages), t.media_files, "/media", "/mnt")


PREFIXES = [("/mnt/src1/en", "English one"), ("/mnt/src1", "One and teens"), ("/mnt/src", "Rest")]


@query(
    "SELECT id, CASE " + " ".join(f"WHEN starts_with(path, '{p}') THEN '{n}'" for p, n in PREFIXES) + " END AS library FROM media_files"
)
def watch_library(t: Tables) -> DataFrame:
    rows = [(n, p, name) for n, (p, name) in enumerate(PREFIXES)]
    return catalog.watch_library(t.media_files, t.spark.createDataFrame(rows, "n int, prefix string, name string"))


@query("""
    WITH p AS (SELECT o_orderkey AS n, '/mnt/src' || o_orderkey % 23 || CASE o_orderkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '/' || substr('endefres', 1 + 2 * (o_orderkey % 4)::INTEGER, 2) ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '/doc-' || o_orderkey % 10 ELSE '' END AS prefix FROM orders)
    SELECT m.id, arg_min(p.n, p.n) AS library FROM media_files m LEFT JOIN p ON starts_with(m.path, p.prefix) GROUP BY m.id
""")
def watch_library_rows(t: Tables) -> DataFrame:
    """The same with a prefix for each order; its number is the library's name."""
    key = F.col("o_orderkey")
    lang = F.concat(F.lit("/"), F.substring(F.lit("endefres"), (1 + 2 * (key % 4)).cast("int"), F.lit(2)))
    prefix = F.concat(
        F.lit("/mnt/src"), (key % 23).cast("string"), F.when(key % 3 == 0, "/").when(key % 3 == 1, lang).otherwise(""),
        F.when(key % 5 == 0, F.concat(F.lit("/doc-"), (key % 10).cast("string"))).otherwise(""),
    )
    return catalog.watch_library(t.media_files, t.orders.select(key.alias("n"), prefix.alias("prefix"), key.alias("name")))


@query(r"""
    WITH p AS (SELECT p_partkey AS n, p_partkey % 7 AS list, CASE p_partkey % 4 WHEN 0 THEN '*/doc-' || p_partkey % 97 || '.*' WHEN 1 THEN '*[!3]' || p_partkey % 89 || '?m*' WHEN 2 THEN 'src?/' || substr('endefres', 1 + 2 * (p_partkey % 4)::INTEGER, 2) || '/*' || p_partkey % 83 || '.tx[st]' ELSE '*' || substr('mp3pdfjpg', 1 + 3 * (p_partkey % 3)::INTEGER, 3) || p_partkey % 5 END AS pat FROM part),
         r AS (SELECT n, list, pat, '(?s)' || replace(replace(replace(replace(pat, '.', '\.'), '[!3]', '[^3]'), '*', '.*'), '?', '.') AS regex FROM p),
         m AS (SELECT id, id % 7 AS list, substr(path, 6) AS path FROM media_files)
    SELECT m.id, min(r.n) AS n, arg_min(r.pat, r.n) AS pattern FROM m JOIN r ON r.list = m.list AND regexp_full_match(m.path, r.regex) GROUP BY m.id
""")
def glob_rows(t: Tables) -> DataFrame:
    """Patterns as rows, one for each part, in seven lists; the first that matches a file's path below the root."""
    n = F.col("p_partkey")
    number = lambda k: (n % k).cast("string")
    glob = (
        F.when(n % 4 == 0, F.concat(F.lit("*/doc-"), number(97), F.lit(".*")))
        .when(n % 4 == 1, F.concat(F.lit("*[!3]"), number(89), F.lit("?m*")))
        .when(n % 4 == 2, F.concat(F.lit("src?/"), F.substring(F.lit("endefres"), (1 + 2 * (n % 4)).cast("int"), F.lit(2)), F.lit("/*"), number(83), F.lit(".tx[st]")))
        .otherwise(F.concat(F.lit("*"), F.substring(F.lit("mp3pdfjpg"), (1 + 3 * (n % 3)).cast("int"), F.lit(3)), number(5)))
    )
    files = t.media_files.select("id", (F.col("id") % 7).alias("list"), F.substring("path", 6, 1 << 20).alias("path"))
    return patterns.first_glob(files, t.part.select(n.alias("n"), (n % 7).alias("list"), glob.alias("pattern")))


_NFO = """
    SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN '<movie><title>' || p_name WHEN 1 THEN '<show><title>' || p_name || '</title></show>'
           ELSE '<movie><title>' || p_name || '</title><plot>' || p_type || '</plot><year>' || CASE p_partkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '1999.0' ELSE CAST(1950 + p_size AS VARCHAR) END || '</year><imdbid>tt' || CAST(p_partkey AS VARCHAR) || '</imdbid><rating>' || CAST(p_size AS VARCHAR) || '.5</rating></movie>' END AS xml
    FROM part
"""


@query(f"""
    WITH x AS ({_NFO}), v AS (SELECT *, id % 7 NOT IN (0, 1) AS good FROM x)
    SELECT id, CASE WHEN good THEN regexp_extract(xml, '<title>(.*)</title>', 1) END AS title, CASE WHEN good THEN regexp_extract(xml, '<plot>(.*)</plot>', 1) END AS overview,
           CASE WHEN good THEN TRY_CAST(TRY_CAST(regexp_extract(xml, '<year>(.*)</year>', 1) AS DOUBLE) AS INTEGER) END AS year, CASE WHEN good THEN regexp_extract(xml, '<imdbid>(.*)</imdbid>', 1) END AS imdb_id,
           CASE WHEN good THEN TRY_CAST(regexp_extract(xml, '<rating>(.*)</rating>', 1) AS DOUBLE) END AS rating FROM v
""")
def nfo_enrich(t: Tables) -> DataFrame:
    p = t.part
    text = lambda c: F.col(c).cast("string")
    year = F.when(F.col("p_partkey") % 5 == 0, "n/a").when(F.col("p_partkey") % 5 == 1, "1999.0").otherwise(
        (F.col("p_size") + 1950).cast("string")
    )
    full = F.concat(
        F.lit("<movie><title>"),
        "p_name",
        F.lit("</title><plot>"),
        "p_type",
        F.lit("</plot><year>"),
        year,
        F.lit("</year><imdbid>tt"),
        text("p_partkey"),
        F.lit("</imdbid><rating>"),
        text("p_size"),
        F.lit(".5</rating></movie>"),
    )
    xml = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("<movie><title>"), "p_name")).when(
        F.col("p_partkey") % 7 == 1, F.concat(F.lit("<show><title>"), "p_name", F.lit("</title></show>"))
    ).otherwise(full)
    return catalog.nfo_fields(
        p.select(F.col("p_partkey").alias("id"), xml.alias("xml")), "xml"
    ).select("id", "title", "overview", "year", "imdb_id", "rating")


@query(r"""
    SELECT m.id, m.path, (SELECT l.exclude_globs FROM storage_locations l WHERE l.id = m.storage_location_id) IS NOT NULL AND CASE WHEN (m.storage_location_id - 100) % 4 = 0 THEN regexp_full_match(substr(m.path, length(m.source) + 7), '(?s)(.*\.tmp|.*/fr/.*)')
           ELSE regexp_full_match(substr(m.path, length(m.source) + 7), '(?s)de/doc-.[05]\..*') END AS excluded FROM media_files m
""")
def exclude_globs(t: Tables) -> DataFrame:
    files = t.media_files.select("id", "storage_location_id", "path")
    out = patterns.excluded(files, t.storage_locations).select("id", F.lit(True).alias("excluded"))
    return files.join(out, "id", "left").select("id", "path", F.coalesce("excluded", F.lit(False)).alias("excluded"))


GLOBS = {
    "unclosed": "*[0-9",
    "literal": "doc-[[]*",
    "negated": "doc-[!0-4]*",
    "bracket": "doc-[]1]*.t?t",
    "backwards": "doc-[9-0]*",
    "dash": "*[-]2*.[mj]*",
}


@query(
    r"SELECT id, filename || '[0-9' AS name, true AS unclosed, false AS literal, regexp_full_match(filename || '[0-9', 'doc-[^0-4].*') AS negated, false AS bracket, false AS backwards, regexp_full_match(filename || '[0-9', '.*[-]2.*\.[mj].*') AS dash FROM media_files"
)
def glob_cases(t: Tables) -> DataFrame:
    """Patterns with brackets that are closed, unclosed, negated, and ranges that run backwards."""
    name = F.concat("filename", F.lit("[0-9"))
    hit = lambda g: paths.matches_any(F.col("name"), F.array(paths.glob_regex(F.lit(g))))
    return t.media_files.select("id", name.alias("name")).select(
        "id", "name", *[hit(g).alias(k) for k, g in GLOBS.items()]
    )


@query(f"""
    WITH {_ITEMS}, s AS (SELECT CASE WHEN starts_with(Path, '/media') THEN '/mnt' || substr(Path, 7) END AS path FROM w)
    SELECT count(*)::BIGINT AS items, count(*) FILTER (path IN (SELECT path FROM media_files))::BIGINT AS matched, count(*) FILTER (path IS NULL OR path NOT IN (SELECT path FROM media_files))::BIGINT AS unmatched FROM s
""")
def watch_counts(t: Tables) -> DataFrame:
    return catalog.watch_counts(catalog.watch_items(t.watch_pages), t.media_files, "/media", "/mnt")
