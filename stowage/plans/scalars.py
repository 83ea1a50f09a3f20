"""Scalar function queries over columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths, scalars
from stowage.plans.registry import query
from stowage.sources.views import Tables


@query("""
    WITH x AS (SELECT id, size_bytes * (1 + id % 7) ** (id % 9) AS v FROM media_files), y AS (SELECT id, floor(v)::BIGINT AS n FROM x)
    SELECT id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1024**2 THEN format('{:.1f} KB', n / 1024.0::DOUBLE) WHEN n < 1024**3 THEN format('{:.1f} MB', n / (1024.0::DOUBLE**2)) WHEN n < 1024**4 THEN format('{:.1f} GB', n / (1024.0::DOUBLE**3)) WHEN n < 1024**5 THEN format('{:.1f} TB', n / (1024.0::DOUBLE**4)) ELSE format('{:.1f} PB', n / (1024.0::DOUBLE**5)) END AS label FROM y
""")
def format_bytes(t: Tables) -> DataFrame:
    n = F.floor(F.col("size_bytes") * F.pow(F.lit(1) + F.col("id") % 7, F.col("id") % 9)).cast("long")
    return t.media_files.select("id", scalars.format_bytes(n).alias("label"))


@query("""
    WITH x AS (SELECT o_orderkey AS id, o_totalprice AS s FROM orders)
    SELECT id, CASE WHEN s < 60 THEN format('{:.0f} sec', round_even(s, 0)) WHEN s < 3600 THEN format('{:.0f} min', round_even(s / 60, 0)) WHEN s < 172800 THEN format('{:.1f} hr', s / 3600) ELSE format('{:.1f} days', s / 86400) END AS label FROM x
""")
def format_duration(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"), scalars.format_duration(F.col("o_totalprice")).alias("label")
    )


@query(
    "SELECT id, strftime(make_timestamp((mtime_ns // 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS mtime, (mtime_ns // 1000000000) * 1000000000 AS back FROM media_files"
)
def rfc3339(t: Tables) -> DataFrame:
    text = scalars.rfc3339(F.col("mtime_ns"))
    return t.media_files.select("id", text.alias("mtime"), scalars.mtime_to_ns(text).alias("back"))


@query(
    "SELECT user_id, count(*)::BIGINT AS parsed, min(t) AS first_us FROM (SELECT user_id, epoch_us(TRY_CAST(substr(j, 1, 26) AS TIMESTAMP)) AS t FROM (SELECT user_id, json_extract_string(unnest(from_json(json_extract(body, '$.Items'), '[\"json\"]')), '$.UserData.LastPlayedDate') AS j FROM watch_pages)) WHERE t IS NOT NULL GROUP BY user_id"
)
def lenient_timestamp(t: Tables) -> DataFrame:
    from stowage.operators import catalog

    at = scalars.lenient_timestamp(F.col("LastPlayedDate"))
    return catalog.watch_items(t.watch_pages).withColumn(
        "t", F.unix_micros(at)
    ).filter("t is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("parsed"), F.min("t").alias("first_us"))


@query(
    "SELECT id, CASE WHEN size_bytes < 1000 THEN 'clump' WHEN size_bytes <= 20000 THEN 'single' ELSE 'part' END AS kind, 512 + ((size_bytes + 511) // 512) * 512 + 1024 AS cost, size_bytes + 20 + ((size_bytes + 4095) // 4096) * 16 AS sealed FROM media_files"
)
def size_rules(t: Tables) -> DataFrame:
    s = F.col("size_bytes")
    return t.media_files.select(
        "id",
        scalars.classify(s, 1000, scalars.MIB + 20_000).alias("kind"),
        scalars.member_cost(s).alias("cost"),
        scalars.sealed_size(s, 4096).alias("sealed"),
    )


@query("""
    WITH x AS (SELECT id, size_bytes + 20 + ((size_bytes + 99) // 100) * 16 AS s FROM media_files), y AS (SELECT *, greatest((s - 20 + 928 - 1) // 928, 1) AS k FROM x)
    SELECT id, k AS parts, least(948, s) AS first_part, CASE WHEN k = 1 THEN s ELSE s - 20 - (k - 1) * 928 END AS last_part FROM y
""")
def split_aligned(t: Tables) -> DataFrame:
    sealed = scalars.sealed_size(F.col("size_bytes"), 100)
    parts = scalars.split_aligned(sealed, 1000, 116, 20)
    return t.media_files.select(
        "id",
        F.size(parts).cast("long").alias("parts"),
        parts[0].alias("first_part"),
        F.element_at(parts, -1).alias("last_part"),
    )


@query(
    "WITH x AS (SELECT id, size_bytes AS s, (size_bytes + 999) // 1000 AS k FROM media_files), y AS (SELECT *, (s + k - 1) // k AS q FROM x) SELECT id, id % 4 AS part, CASE WHEN id % 4 BETWEEN 1 AND k - 1 THEN q WHEN id % 4 = k THEN s - q * (k - 1) ELSE s END AS length FROM y"
)
def part_lengths(t: Tables) -> DataFrame:
    """The stored length of one part of each file that is split at 1000 bytes; of part 0, and of parts beyond the last,
    the whole file's.
    """
    part = F.col("id") % 4
    sizes = scalars.split_sizes(F.col("size_bytes"), 1000)
    number = F.when((part >= 1) & (part <= F.size(sizes)), part).otherwise(F.size(sizes) + 1).cast("int")
    return t.media_files.select("id", part.alias("part"), scalars.part_length(sizes, number).alias("length"))


@query(
    "SELECT id, regexp_replace(replace(path, 'archives/', 'index/'), '\\.tar$', '.json') AS index_key FROM backup_archives"
)
def index_keys(t: Tables) -> DataFrame:
    return t.backup_archives.select("id", paths.index_key(F.col("path")).alias("index_key"))


@query(
    "SELECT id, 'base/' || source || CASE WHEN id % 3 = 0 THEN '' ELSE '/x' END || '/' AS prefix, split_part(path, '/', 2) AS bucket FROM media_files"
)
def bucket_paths(t: Tables) -> DataFrame:
    messy = F.concat(F.lit("/base//"), "source", F.when(F.col("id") % 3 == 0, "//").otherwise("/x/"))
    return t.media_files.select(
        "id",
        paths.normalize_prefix(messy).alias("prefix"),
        paths.bucket(F.substring("path", F.lit(2), F.length("path"))).alias("bucket"),
    )


@query("""
    WITH s AS (SELECT event_id AS id, date_trunc('second', ts) AS a, CASE WHEN event_id % 2 = 0 THEN 'daily' ELSE 'weekly' END AS f, lpad((event_id % 24)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') AS hm,
                      CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN (event_id % 7)::VARCHAR ELSE '5, 2,2' END AS days FROM events),
         d AS (SELECT s.*, (isodow(a) - 1 + o) % 7 AS wd, date_trunc('day', a) + to_days(o::INTEGER) + to_minutes((id % 24) * 60 + id % 60) AS c FROM s, generate_series(0, 7) AS g(o))
    SELECT id, epoch_us(min(c)) AS next_us FROM d WHERE c > a AND (f = 'daily' OR CASE WHEN days IS NULL THEN wd = (isodow(a) - 1) WHEN days = '5, 2,2' THEN wd IN (2, 5) ELSE wd = id % 7 END) GROUP BY id
""")
def next_occurrence(t: Tables) -> DataFrame:
    e, n = t.events, F.col("event_id")
    time = F.concat(F.lpad((n % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"))
    days = F.when(n % 3 == 1, (n % 7).cast("string")).when(n % 3 == 2, "5, 2,2")
    after = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return e.select(
        n.alias("id"),
        F.unix_micros(
            scalars.next_occurrence(after, F.when(n % 2 == 0, "daily").otherwise("weekly"), time, days)
        ).alias("next_us"),
    )


@query("SELECT id, filename, extension FROM media_files")
def name_parts(t: Tables) -> DataFrame:
    name = paths.filename(F.col("path"))
    return t.media_files.select("id", name.alias("filename"), paths.suffix(name).alias("extension"))


@query(
    "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '0,2' ELSE (p_size % 7)::VARCHAR END AS days FROM part"
)
def weekday_lists(t: Tables) -> DataFrame:
    text = F.when(
        F.col("p_partkey") % 3 == 0, F.lit(None).cast("string")
    ).when(F.col("p_partkey") % 3 == 1, "2, 0,2").otherwise((F.col("p_size") % 7).cast("string"))
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.array_join(F.transform(scalars.weekdays(text), lambda d: d.cast("string")), ",").alias("days"),
    )
