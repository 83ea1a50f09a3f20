"""Scanning libraries: gates and tags, the merge of a listing with the catalog, healing of moved files, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.operators import patterns
from stowage.session import settle

#: The extensions of each media type, and those that are never content.
EXTENSIONS = {
    "movies": ("mp4", "m4v", "mkv", "avi", "mov", "wmv"),
    "music": ("mp3", "flac", "m4a", "aac", "wav", "ogg", "wma"),
    "photos": ("jpg", "jpeg", "png", "gif", "heic", "heif", "tiff", "bmp", "raw", "cr2", "nef", "dng"),
    "documents": ("pdf", "doc", "docx", "txt", "md", "epub", "rtf", "odt", "xls", "xlsx", "ppt", "pptx"),
}
IGNORED = ("nfo", "mbcopy", "tmp")


def type_of_extension() -> Column:
    """A map of extension to the media type that owns it."""
    return F.create_map(
        *[F.lit(x) for kind, names in EXTENSIONS.items() for name in names for x in (name, kind)]
    )


def gate_and_tag(listing: DataFrame, locations: DataFrame) -> DataFrame:
    """The listed files that their library catalogs, with extension, media_type, filename and genre (the first
    folder).
    """
    known = locations.select(
        F.col("id").alias("storage_location_id"),
        F.col("path").alias("root"),
        F.when(
            F.col("media_type").isin("files", *EXTENSIONS), F.col("media_type")
        ).otherwise("movies").alias("library_type"),
    )
    named = listing.withColumn("filename", paths.filename(F.col("path"))).withColumn(
        "extension", paths.suffix(F.col("filename"))
    )
    owner = F.try_element_at(type_of_extension(), F.col("extension"))
    joined = named.join(known, "storage_location_id").withColumn("owner", owner).filter(
        ~F.col("extension").isin(*IGNORED)
    )
    kept = joined.filter((F.col("library_type") == "files") | (F.col("owner") == F.col("library_type")))
    return kept.withColumn(
        "media_type",
        F.when(F.col("library_type") == "files", F.coalesce("owner", F.lit("files"))).otherwise(F.col("library_type")),
    ).withColumn("genre", paths.folder_category(paths.relative(F.col("path"), F.col("root")))).drop("owner", "root", "library_type")


def scan_diff(listing: DataFrame, files: DataFrame) -> DataFrame:
    """path, id, change: added, updated (seen, content the same), changed (content differs) or unseen. Changed or
    without a fingerprint: it is taken anew.
    """
    l, f = listing.alias("l"), files.alias("f")
    changed = (F.col("l.size") != F.col("f.size_bytes")) | (
        F.col("f.mtime_ns").isNotNull() & (F.col("l.mtime_ns") != F.col("f.mtime_ns"))
    )
    change = F.when(F.col("f.id").isNull(), "added").when(
        F.col("l.path").isNull(), "unseen"
    ).when(changed, "changed").otherwise("updated")
    joined = l.join(f, F.col("l.path") == F.col("f.path"), "full_outer")
    return joined.select(
        F.coalesce("l.path", "f.path").alias("path"),
        F.col("f.id").alias("id"),
        change.alias("change"),
        (
            change.isin("added", "changed") | ((change == "updated") & F.col("f.fingerprint").isNull())
        ).alias("refingerprint"),
    )


def missing_files(files: DataFrame, seen: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that aren't marked missing, weren't cataloged by this scan and aren't on disk at all."""
    return files.filter(~F.col("is_missing")).join(seen.select("path"), "path", "left_anti").join(
        listing.select("path"), "path", "left_anti"
    )


def catalog_upsert(listing: DataFrame, files: DataFrame) -> DataFrame:
    """The next catalog: new rows get ids after the largest, seen rows the listing's size and time, unseen ones are
    missing.

    The new rows are numbered by sorted partitions: one count a partition comes to the driver, not a row.
    """
    l, f = listing.alias("l"), files.alias("f")
    old = f.join(l, F.col("l.path") == F.col("f.path"), "left").select(
        F.col("f.id").alias("id"),
        F.col("f.path").alias("path"),
        F.coalesce("l.size", "f.size_bytes").alias("size_bytes"),
        F.coalesce("l.mtime_ns", "f.mtime_ns").alias("mtime_ns"),
        F.col("l.path").isNull().alias("is_missing"),
    )
    new = listing.join(files.select("path"), "path", "left_anti").select(
        "path", F.col("size").alias("size_bytes"), "mtime_ns"
    )
    return old.unionByName(
        numbered_after(files, new, "path").withColumn("is_missing", F.lit(False)).select(
            "id", "path", "size_bytes", "mtime_ns", "is_missing"
        )
    )


def numbered_after(files: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """new with ids that go on after the largest of files, in the order of a column.

    Range partitions are numbered and written once; a row's id is its place in its partition after the counts of those
    before.
    """
    base = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))
    ranged = settle(new.repartitionByRange(F.col(order)).withColumn("part", F.spark_partition_id()), "ranged")
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    counts = ranged.groupBy("part").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return ranged.withColumn("place", place).join(F.broadcast(before.drop("count")), "part").crossJoin(
        F.broadcast(base)
    ).withColumn("id", F.col("base") + F.col("before") + F.col("place")).drop("part", "place", "before", "base")


def merge_stale(files: DataFrame, records: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows outside their library's root that a row below it replaces: same name and fingerprint, and exactly one such
    row.

    'repoint': the stale row takes the live row's path and the live row goes; 'drop_stale': only the live row has
    backups, so the stale row
    goes; 'keep both': both have backups. Of several stale rows with one live match the smallest id takes it.
    """
    keyed = files.filter("fingerprint is not null").join(
        locations.select(F.col("id").alias("storage_location_id"), F.col("path").alias("root")), "storage_location_id"
    ).withColumn("inside", paths.under(F.col("path"), F.col("root")))
    key = ["storage_location_id", "filename", "fingerprint"]
    live = keyed.filter("inside").groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("live_id")
    ).filter("n = 1").drop("n")
    stale = keyed.filter("not inside").groupBy(*key).agg(F.min("id").alias("stale_id"))
    backed = records.select("media_file_id").distinct()
    has = lambda name: backed.select(F.col("media_file_id").alias(f"{name}_id"), F.lit(True).alias(f"{name}_backed"))
    flagged = stale.join(live, key).join(has("stale"), "stale_id", "left").join(has("live"), "live_id", "left")
    old, new = F.coalesce("stale_backed", F.lit(False)), F.coalesce("live_backed", F.lit(False))
    return flagged.select(
        "stale_id",
        "live_id",
        F.when(old & new, "keep both").when(old | ~new, "repoint").otherwise("drop_stale").alias("action"),
    )


def select_ids(files: DataFrame, ids: DataFrame, location: int) -> DataFrame:
    return files.filter(F.col("storage_location_id") == location).join(ids, "id", "left_semi")


def folder_expand(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files below any of the folders, at any depth. Each path's own ancestors are the join keys, so it is an
    equi-join.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    )
    below = files.withColumn("folder", F.explode(ancestors)).join(folders.select("folder"), "folder", "left_semi")
    return below.select("id").distinct()


def bulk_select(files: DataFrame, ids: DataFrame, folders: DataFrame, everything: bool = False) -> DataFrame:
    if everything:
        return files.select("id")
    return files.join(ids, "id", "left_semi").select("id").union(folder_expand(files, folders)).distinct()


def watch_items(pages: DataFrame) -> DataFrame:
    kind = "struct<Items:array<struct<Id:string,Path:string,UserData:struct<Played:boolean,PlayCount:long,LastPlayedDate:string>>>>"
    return pages.select(
        "user_id", F.explode(F.from_json("body", kind)["Items"]).alias("i")
    ).select("user_id", "i.Id", "i.Path", "i.UserData.*")


def watch_sync(items: DataFrame, files: DataFrame, before: str, after: str) -> DataFrame:
    """Per file the state of its latest item (the largest Id), by path with one prefix exchanged."""
    swapped = items.withColumn(
        "path", paths.swap_prefix(F.col("Path"), F.lit(before), F.lit(after))
    ).filter("path is not null")
    best = swapped.groupBy("path").agg(
        F.max_by(F.struct("Played", "PlayCount", "LastPlayedDate"), F.struct(F.length("Id"), "Id")).alias("s")
    )
    return files.select("id", "path").join(best, "path").select(
        "id",
        F.col("s.Played").alias("watched"),
        F.col("s.PlayCount").alias("play_count"),
        F.col("s.LastPlayedDate").alias("last_played"),
    )


def watch_counts(items: DataFrame, files: DataFrame, before: str, after: str) -> DataFrame:
    """How many items there are, and how many of them have and haven't a file at their path with one prefix
    exchanged.
    """
    known = files.select("path", F.lit(True).alias("known")).distinct()
    swapped = items.select(paths.swap_prefix(F.col("Path"), F.lit(before), F.lit(after)).alias("path"))
    joined = swapped.join(known, "path", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("items"),
        F.count("known").alias("matched"),
        F.count_if(F.col("known").isNull()).alias("unmatched"),
    )


def watch_library(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The first prefix of a list (n, prefix, name) that a path starts with names its library."""
    return patterns.first_prefix(files.select("id", "path"), prefixes).withColumnRenamed("name", "library")


def nfo_fields(sidecars: DataFrame, column: str) -> DataFrame:
    """Fields of a movie's XML sidecar; all null where the root isn't <movie> or the text isn't well formed."""
    kind = "title string, plot string, year string, imdbid string, tmdbid string, rating string, runtime string"
    is_movie = F.rlike(column, F.lit(r"^\s*(<\?xml[^>]*\?>\s*)?<movie[\s>]"))
    got = sidecars.withColumn("m", F.from_xml(F.when(is_movie, F.col(column)), F.lit(kind), {"mode": "PERMISSIVE"}))
    whole = lambda c: F.col(c).try_cast("double").try_cast("int")
    return got.select(
        "id",
        F.col("m.title").alias("title"),
        F.col("m.plot").alias("overview"),
        whole("m.year").alias("year"),
        F.col("m.imdbid").alias("imdb_id"),
        F.col("m.tmdbid").alias("tmdb_id"),
        F.col("m.rating").try_cast("double").alias("rating"),
        whole("m.runtime").alias("runtime_minutes"),
    )
