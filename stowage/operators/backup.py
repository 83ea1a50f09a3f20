"""Planning a backup run: what to skip, what is stored already, how files group into archives, and the records of a
run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import paths, scalars
from stowage.operators import patterns
from stowage.operators.catalog import numbered_after
from stowage.operators.ordered import next_fit, running

#: Skip reasons that don't make a run partial.
EXPECTED = ("excluded", "unchanged", "already_backed_up", "already_missing")


def archives_present(records: DataFrame, links: DataFrame, archives: DataFrame, listing: DataFrame) -> DataFrame:
    """Whether all archives of a record are listed; a record without links counts as present."""
    listed = listing.select(F.col("key").alias("path"), F.lit(True).alias("listed")).distinct()
    held = links.join(
        archives.select(F.col("id").alias("backup_archive_id"), "path"), "backup_archive_id"
    ).join(listed, "path", "left")
    every = held.groupBy("backup_record_id").agg(F.bool_and(F.coalesce("listed", F.lit(False))).alias("present"))
    return records.join(every, F.col("id") == F.col("backup_record_id"), "left").select(
        "id", F.coalesce("present", F.lit(True)).alias("present")
    )


def is_unchanged(
    force_all: bool, disk_ns: Column, disk_size: Column, stored_ns: Column, catalog_size: Column, present: Column
) -> Column:
    if force_all:
        return F.lit(False)
    return F.coalesce((stored_ns == disk_ns) & (disk_size == catalog_size) & present, F.lit(False))


def skip_reasons(
    files: DataFrame,
    locations: DataFrame,
    before: DataFrame,
    after: DataFrame,
    records: DataFrame,
    present: DataFrame,
    destination: int,
    force_all: bool = False,
) -> DataFrame:
    """id, path, reason: the first reason that applies, or candidate. before and after: listings round the reads."""
    own = locations.select(F.col("id").alias("storage_location_id"))
    out = patterns.excluded(files, locations).select("id", F.lit(True).alias("excluded"))
    done = records.filter(F.col("destination_id") == destination).join(present, "id").select(
        F.col("media_file_id").alias("id"), F.col("mtime_ns").alias("stored_ns"), "present"
    )
    seen = before.select("path", F.col("size").alias("disk_size"), F.col("mtime_ns").alias("disk_ns"))
    later = after.select("path", F.col("size").alias("later_size"), F.col("mtime_ns").alias("later_ns"))
    joined = files.join(
        own, "storage_location_id"
    ).join(out, "id", "left").join(done, "id", "left").join(seen, "path", "left").join(later, "path", "left")
    same = is_unchanged(
        force_all, F.col("disk_ns"), F.col("disk_size"), F.col("stored_ns"), F.col("size_bytes"), F.col("present")
    )
    moved = ~F.col("disk_size").eqNullSafe(F.col("later_size")) | ~F.col("disk_ns").eqNullSafe(F.col("later_ns"))
    reason = F.when(F.col("excluded"), "excluded").when(F.col("is_missing"), "already_missing").when(
        F.col("disk_size").isNull(), "missing"
    ).when(same, "unchanged").when(moved, "changed_during_read").otherwise("candidate")
    return joined.select("id", "path", reason.alias("reason"))


def run_status(reasons: DataFrame, by: str) -> DataFrame:
    odd = F.bool_or(~F.col("reason").isin("candidate", *EXPECTED))
    return reasons.groupBy(by).agg(F.when(odd, "partial").otherwise("done").alias("status"))


def adopt_existing(
    candidates: DataFrame,
    records: DataFrame,
    links: DataFrame,
    archives: DataFrame,
    listing: DataFrame,
    destination: int,
    encrypted: bool,
    key_version: int | None,
) -> DataFrame:
    """Candidates (id, match_key) with the record whose stored copy they can take, or null.

    Of the finished records at the destination with the key the lowest id is tried. All its archives must be complete,
    listed and
    encrypted as this run would encrypt them. records: id, match_key, destination_id, status.
    """
    source = records.filter(
        (F.col("destination_id") == destination) & (F.col("status") == "done") & F.col("match_key").isNotNull()
    ).groupBy("match_key").agg(F.min("id").alias("record_id"))
    listed = listing.select(F.col("key").alias("path"), F.lit(True).alias("listed")).distinct()
    like_run = (F.col("encrypted") == encrypted) & (
        F.lit(True) if not encrypted else F.col("key_version_id") == key_version
    )
    fit = F.col("archive_id").isNotNull() & F.col("indexed_at").isNotNull() & like_run & F.col("listed").isNotNull()
    held = links.join(
        archives.withColumnRenamed("id", "backup_archive_id"), "backup_archive_id"
    ).join(listed, "path", "left")
    usable = held.groupBy(F.col("backup_record_id").alias("record_id")).agg(
        F.bool_and(F.coalesce(fit, F.lit(False))).alias("fit")
    ).filter("fit").select("record_id")
    return candidates.join(source.join(usable, "record_id"), "match_key", "left").select("id", "match_key", "record_id")


def dedup_groups(files: DataFrame) -> DataFrame:
    """One row for each content: the first path stands for it, and how many paths have it. content_paths names them."""
    first = F.min("rel_path").alias("rel_path"), F.min_by("size_bytes", "rel_path").alias("size_bytes")
    return files.groupBy("sha256").agg(*first, F.count("rel_path").alias("copies"))


def content_paths(files: DataFrame, page: int = 10_000) -> DataFrame:
    """sha256, page, paths: all paths of each content in order, `page` of them a row, so a content of any number of
    copies is never one cell.
    """
    placed = running(files.select("sha256", "rel_path").distinct(), "sha256", ["rel_path"])
    return placed.groupBy("sha256", F.floor(F.col("n") / page).alias("page")).agg(
        F.array_sort(F.collect_list("rel_path")).alias("paths")
    )


def clump_plan(contents: DataFrame, min_size: int, clump_size: int, max_size: int) -> DataFrame:
    """For each content its archive: single and part files alone, small ones in clumps by next-fit in path order."""
    kind = scalars.classify(F.col("size_bytes"), min_size, max_size)
    typed = contents.withColumn("kind", kind).withColumn("cost", scalars.member_cost(F.col("size_bytes")))
    limit = min(clump_size, scalars.payload_ceiling(max_size))
    clumps = next_fit(
        typed.filter("kind = 'clump'").select("library", "rel_path", "sha256", "size_bytes", "cost"),
        "library",
        ["rel_path"],
        "cost",
        limit,
    )
    named = clumps.select(
        "library",
        "sha256",
        "rel_path",
        "size_bytes",
        F.lit("clump").alias("kind"),
        F.concat(F.lit("clump-"), F.col("bin").cast("string")).alias("archive"),
    )
    alone = typed.filter("kind <> 'clump'").select(
        "library",
        "sha256",
        "rel_path",
        "size_bytes",
        "kind",
        F.concat("kind", F.lit("-"), F.substring("sha256", 1, 12)).alias("archive"),
    )
    return named.unionByName(alone)


def split_plan(contents: DataFrame, max_size: int) -> DataFrame:
    """The parts of files that exceed one archive: number from 1, size, and where each starts."""
    ceiling = scalars.payload_ceiling(max_size)
    parts = contents.filter(F.col("size_bytes") > ceiling).select(
        "id", F.posexplode(scalars.split_sizes(F.col("size_bytes"), ceiling)).alias("i", "length")
    )
    before = F.sum("length").over(Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("id", (F.col("i") + 1).alias("part"), "length", F.coalesce(before, F.lit(0)).alias("start"))


def record_archives(members: DataFrame, records: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next records, next links) after a run stored members (archive_id, media_file_id, destination_id, sha256,
    part_index, offset, length).

    A record of a touched file and destination is updated or added, and its old links are replaced by the new ones;
    others stay.
    New records are numbered after the largest id, in the order of file and destination.
    """
    key = ["media_file_id", "destination_id"]
    touched = members.groupBy(*key).agg(F.min("sha256").alias("new_sha"))
    old = records.select("id", *key, "sha256", "status").join(touched, key, "left")
    fresh = touched.join(records.select(*key), key, "left_anti").withColumn("order", F.struct(*key))
    status = F.when(F.col("new_sha").isNotNull(), "done").otherwise(F.col("status")).alias("status")
    kept = old.select("id", *key, F.coalesce("new_sha", "sha256").alias("sha256"), status)
    added = numbered_after(records, fresh, "order").select(
        "id", *key, F.col("new_sha").alias("sha256"), F.lit("done").alias("status")
    )
    after = kept.unionByName(added)
    ids = after.select(F.col("id").alias("backup_record_id"), *key)
    new_links = members.join(ids, key).select(
        "backup_record_id", F.col("archive_id").alias("backup_archive_id"), "part_index", "offset", "length"
    )
    stay = links.join(new_links.select("backup_record_id").distinct(), "backup_record_id", "left_anti")
    stay = stay.select(
        "backup_record_id",
        "backup_archive_id",
        "part_index",
        F.col("archive_offset").alias("offset"),
        F.col("archive_length").alias("length"),
    )
    return after, stay.unionByName(new_links)


#: A fixed value of the index format: how entries of keyed archives are named.
KEY_SCHEME = "content_id_v1"


def build_index(members: DataFrame) -> DataFrame:
    """The index document of each archive as JSON: archive_id, body.

    members: archive_id, object, type, created_at, archive_size, key_check, sha256, content_id, size, mtime, member,
    offset, paths, paths_enc,
    compression, part, parts, sha256_enc; what doesn't apply is null. Entries are named by content id where members
    have one, which all or none of
    an archive must, with the sealed hash; otherwise by hash. A name that comes twice in one archive is an error too,
    by the map's own rule.
    """
    named = members.withColumn("name", F.coalesce("content_id", "sha256"))
    fields = "size", "mtime", "member", "offset", "paths", "paths_enc", "compression", "part", "parts", "sha256_enc"
    files = F.map_from_entries(
        F.array_sort(F.collect_list(F.struct(F.col("name").alias("key"), F.struct(*fields).alias("value"))))
    )
    keyed, plain = F.count("content_id").alias("keyed"), F.count_if(F.col("content_id").isNull()).alias("plain")
    unsealed = F.count_if(F.col("content_id").isNotNull() & F.col("sha256_enc").isNull()).alias("unsealed")
    head = "archive_id", "object", "type", "created_at", F.col("archive_size").alias("size_of"), "key_check"
    doc = named.groupBy(*head).agg(
        files.alias("files"), keyed, plain, unsealed, F.bool_or(F.col("paths_enc").isNotNull()).alias("sealed")
    )
    is_keyed = F.col("keyed") > 0
    body = F.to_json(
        F.struct(
            F.lit(1).alias("v"), "archive_id", "object", "type", "created_at", F.col("size_of").alias("size"), "files",
            F.when(is_keyed, KEY_SCHEME).alias("key_scheme"), F.when(
                is_keyed, F.col("key_check")
            ).alias("key_check"), F.when(F.col("sealed"), True).alias("encrypted"),
        )
    )
    mixed = F.raise_error(F.concat(F.lit("members with and without a content id in archive "), "archive_id"))
    lost = F.raise_error(F.concat(F.lit("a content id without its sealed hash in archive "), "archive_id"))
    return doc.select(
        "archive_id",
        F.when(is_keyed & (F.col("plain") > 0), mixed).when(F.col("unsealed") > 0, lost).otherwise(body).alias("body"),
    )


def results_json(reasons: DataFrame, by: str, page: int = 10_000) -> DataFrame:
    """JSON lists of (path, reason) for each run, in path order: by, page, results; `page` entries a row, so a run of
    any size is no single cell.
    """
    placed = running(reasons, by, ["path"])
    each = F.array_sort(F.collect_list(F.struct("path", "reason")))
    return placed.groupBy(by, F.floor(F.col("n") / page).alias("page")).agg(F.to_json(each).alias("results"))


def effective_encryption(libraries: DataFrame, has_key: bool) -> DataFrame:
    return libraries.select("id", (F.lit(has_key) & F.coalesce("encrypted", F.lit(True))).alias("encrypted"))


def target_prefix(locations: DataFrame) -> DataFrame:
    """Where each library's objects go: the archive's bucket and folder, then the library's own folder. A prefix that
    would climb out is null.
    """
    archives = locations.filter("is_backup_target").select(
        F.col("id").alias("archive_location_id"), F.col("path").alias("target")
    )
    joined = locations.filter("not is_backup_target").join(archives, "archive_location_id")
    base = paths.bucket_prefix(F.col("target"))
    prefix = F.when(base.isNotNull(), paths.normalize_prefix(base, F.coalesce("archive_subpath", F.lit(""))))
    return joined.select("id", paths.bucket(F.col("target")).alias("bucket"), prefix.alias("prefix"))
