"""Reports over the catalog, the ledger and the runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.session import settle


def zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("long")


def storage_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), zero(F.sum("size_bytes")).alias("bytes"))


def storage_by_type(files: DataFrame) -> DataFrame:
    return files.groupBy("media_type").agg(F.count(F.lit(1)).alias("files"), zero(F.sum("size_bytes")).alias("bytes"))


def activity_summary(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("kind").isin("backup", "restore")).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "running", "failed")]
    )


def location_classes(locations: DataFrame) -> DataFrame:
    return locations.select(
        "id",
        F.when(F.col("is_backup_target"), "archive").when(
            F.col("untracked"), "untracked library"
        ).otherwise("library").alias("class"),
    )


def library_coverage(files: DataFrame, records: DataFrame, locations: DataFrame) -> DataFrame:
    """For each library its files, and those with a finished record at the library's own archive."""
    libraries = locations.filter(~F.col("is_backup_target")).select(
        F.col("id").alias("library_id"), "name", "archive_location_id"
    )
    done = records.filter("status = 'done'").select(
        "media_file_id", F.col("destination_id").alias("archive_location_id"), F.lit(1).alias("one")
    ).distinct()
    held = files.select(
        F.col("id").alias("media_file_id"), F.col("storage_location_id").alias("library_id")
    ).join(libraries, "library_id", "right")
    return held.join(done, ["media_file_id", "archive_location_id"], "left").groupBy("library_id", "name").agg(
        F.count("media_file_id").alias("files"), F.count("one").alias("covered")
    )


def inventory_tiers(listing: DataFrame) -> DataFrame:
    archives = listing.filter(paths.archive_parts(F.col("key"))[1].isNotNull())
    return archives.groupBy(F.coalesce("storage_class", F.lit("UNKNOWN")).alias("tier")).agg(
        F.count(F.lit(1)).alias("archives"), zero(F.sum("size")).alias("bytes")
    )


def key_history(keys: DataFrame, archives: DataFrame) -> DataFrame:
    """Key versions with their number (the oldest is 1) and how many archives each wrote."""
    number = F.row_number().over(Window.orderBy("created_at", "id"))  # one row a key version: a short list by nature
    used = archives.filter("key_version_id is not null").groupBy("key_version_id").agg(
        F.count(F.lit(1)).alias("archives")
    )
    return keys.withColumn("version", number).join(used, F.col("id") == F.col("key_version_id"), "left").select(
        "id", "version", F.col("retired_at").isNull().alias("current"), zero(F.col("archives")).alias("archives")
    )


def file_locations(records: DataFrame, links: DataFrame, archives: DataFrame) -> DataFrame:
    """For each record whether any of its archives is encrypted."""
    held = links.select(
        "backup_record_id", F.col("backup_archive_id").alias("id")
    ).join(archives.select("id", "encrypted"), "id")
    flags = held.groupBy("backup_record_id").agg(F.bool_or("encrypted").alias("encrypted"))
    return records.join(flags, F.col("id") == F.col("backup_record_id"), "left").select(
        "id", "media_file_id", "destination_id", F.coalesce("encrypted", F.lit(False)).alias("encrypted")
    )


SKIPPED = "array<struct<path:string,reason:string>>"


def skip_counts(runs: DataFrame) -> DataFrame:
    each = runs.select("id", F.explode(F.from_json("skipped_json", SKIPPED)).alias("s"))
    return each.groupBy("id", F.col("s.reason").alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def facets(files: DataFrame) -> DataFrame:
    one = lambda name: files.filter(F.coalesce(F.col(name), F.lit("")) != "").select(F.lit(name).alias("facet"), F.col(name).alias("value")).distinct()
    return one("genre").unionByName(one("media_type"))


def catalog_scalars(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.max("scanned_at").alias("last_scan"), F.count_if("watched").alias("watched")
    )


def archive_rows(locations: DataFrame, archives: DataFrame) -> DataFrame:
    """For each archive location the names of its libraries, and how many archives are recorded there."""
    targets = locations.filter("is_backup_target").select("id", "name")
    names = locations.filter("archive_location_id is not null").groupBy("archive_location_id").agg(
        F.array_sort(F.collect_list("name")).alias("libraries")
    )
    recorded = archives.groupBy("storage_location_id").agg(F.count(F.lit(1)).alias("archives"))
    joined = targets.join(names, F.col("id") == F.col("archive_location_id"), "left").join(
        recorded, F.col("id") == F.col("storage_location_id"), "left"
    )
    return joined.select(
        "id",
        "name",
        F.array_join(F.coalesce("libraries", F.array().cast("array<string>")), ",").alias("libraries"),
        zero(F.col("archives")).alias("archives"),
    )


def run_outcome(runs: DataFrame) -> DataFrame:
    ok, bad = F.col("files_done"), F.col("files_failed")
    return runs.select("id", F.when(bad == 0, "done").when(ok > 0, "partial").otherwise("failed").alias("outcome"))


def catalog_search(
    files: DataFrame,
    locations: DataFrame,
    media_type: str | None = None,
    genre: str | None = None,
    library: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Files by type, genre, library and a part of the name in any case; % and _ of the text stay wildcards."""
    found = files
    if media_type:
        found = found.filter(F.col("media_type") == media_type)
    if genre:
        found = found.filter(F.col("genre") == genre)
    if text:
        found = found.filter(F.col("filename").ilike(f"%{text}%"))
    if library:
        found = found.join(
            locations.filter(F.col("name") == library).select(F.col("id").alias("storage_location_id")),
            "storage_location_id",
            "left_semi",
        )
    return found.orderBy(F.col("genre").asc_nulls_last(), "filename", "id")


def page_of(files: DataFrame, page: int | None, size: int = 20) -> DataFrame:
    """One page in catalog order (genre, nulls last, filename, id); the page is put into the range there is, null is the
    one in the middle.

    An order statistic: ids are dealt to ranges of the order, the ranges are counted, and only those that hold the page are
    sorted. So a page anywhere costs one pass of narrow rows, and no task sorts more than a range or two.
    """
    order = [F.col("genre").asc_nulls_last(), F.col("filename").asc(), F.col("id").asc()]
    ranged = files.select("genre", "filename", "id").repartitionByRange(*order)
    ranged = settle(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())  # a row a partition
    total = sum(n for _, n in counts)
    pages = max(1, -(-total // size))
    first = ((pages + 1) // 2 if page is None else min(max(1, page), pages)) * size - size
    before, held, skip = 0, [], 0
    for part, n in counts:
        if before < first + size and before + n > first:
            skip = skip if held else first - before
            held.append(part)
        before += n
    ids = ranged.filter(F.col("_range").isin(held)).orderBy(*order).offset(skip).limit(size).select("id")
    return files.join(F.broadcast(ids), "id", "left_semi").orderBy(*order)


def folder_view(rel: DataFrame, folder: str) -> DataFrame:
    """One level below folder: its sub-folders with how many files they hold in all, and its own files. rel:
    rel_path.
    """
    depth = len([p for p in folder.split("/") if p])
    inside = rel.filter(F.startswith("rel_path", F.lit(folder + "/"))) if depth else rel
    parts = F.split("rel_path", "/")
    kind = F.when(F.size(parts) > depth + 1, "folder").otherwise("file")
    return inside.select(
        kind.alias("kind"), parts[depth].alias("name")
    ).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("files"))


def scan_message(changed: DataFrame, shown: int = 5) -> DataFrame:
    """'a, b, c and N more' of the changed names by library. Only as many names as are shown come together."""
    w = Window.partitionBy("storage_location_id").orderBy("filename")
    few = changed.withColumn(
        "r", F.row_number().over(w)
    ).filter(F.col("r") <= shown).groupBy("storage_location_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "filename"))), lambda x: x["filename"]), ", ").alias("names"))
    n = changed.groupBy("storage_location_id").agg(F.count(F.lit(1)).alias("n"))
    more = F.when(
        F.col("n") > shown, F.concat(F.lit(" and "), (F.col("n") - shown).cast("string"), F.lit(" more"))
    ).otherwise("")
    return few.join(n, "storage_location_id").select(
        "storage_location_id", "n", F.concat("names", more).alias("message")
    )


def recent_runs(runs: DataFrame, locations: DataFrame, kind: str, n: int = 25) -> DataFrame:
    named = runs.filter(F.col("kind") == kind).join(
        locations.select(F.col("id").alias("source_location_id"), F.col("name").alias("library")), "source_location_id"
    )
    return named.orderBy(
        F.col("started_us").desc(), F.col("id").desc()
    ).limit(n).select("id", "library", "status", "started_us")


def run_board(runs: DataFrame, kinds: tuple[str, ...] = ("backup", "restore", "sync")) -> DataFrame:
    """All kinds of runs on one board, under ids that name the kind."""
    board = None
    for kind in kinds:
        part = runs.filter(F.col("kind") == kind).select(
            F.concat(F.lit(f"{kind}-"), F.col("id").cast("string")).alias("key"), "status", "source_location_id"
        )
        board = part if board is None else board.unionByName(part)
    return board


#: What is shown for each phase of a run.
PHASES = {
    "hashing": "Hashing files",
    "preparing": "Compressing / encrypting files",
    "packing": "Packing archives",
    "uploading": "Uploading",
    "restoring": "Restoring files",
    "syncing": "Syncing from bucket",
}


def run_progress(runs: DataFrame, now_us: Column, stall_seconds: int = 120) -> DataFrame:
    """Percentage, rate, time left and heartbeat age of each run. Times are microseconds."""
    running = F.col("status") == "running"
    done, total = F.coalesce("phase_done", F.lit(0)), F.coalesce("phase_total", F.lit(0))
    live = running & F.col("phase").isNotNull()
    elapsed = (now_us - F.col("phase_started_us")) / 1e6
    rate = F.when(live & (done > 0) & (elapsed >= 3), done / elapsed)
    age = F.when(running, F.greatest(F.lit(0.0), (now_us - F.coalesce("heartbeat_us", "started_us")) / 1e6))
    labels = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])
    return runs.select(
        "id", F.concat("kind", F.lit("-"), F.col("id").cast("string")).alias("key"), F.when(
            live, F.coalesce(labels[F.col("phase")], F.col("phase"))
        ).alias("label"),
        F.when(
            live & F.col("phase").isin("uploading", "restoring", "syncing"), "bytes"
        ).otherwise("files").alias("unit"),
        F.round(
            F.when(live & (total > 0), F.least(F.lit(100.0), done / total * 100)), 3
        ).alias("percent"), F.round(rate, 3).alias("rate"),
        F.round(F.when(total > done, (total - done) / rate), 3).alias("eta_seconds"), F.round(age, 3).alias(
            "heartbeat_age"
        ), F.coalesce(age > stall_seconds, F.lit(False)).alias("stalled"),
    )


def file_archive(files: DataFrame, locations: DataFrame) -> DataFrame:
    """Each file's library and the archive its library goes to."""
    own = locations.select(
        F.col("id").alias("storage_location_id"),
        F.col("name").alias("library"),
        F.col("archive_location_id").alias("archive_id"),
    )
    archives = locations.select(F.col("id").alias("archive_id"), F.col("name").alias("archive"))
    return files.select(F.col("id").alias("media_file_id"), "storage_location_id").join(
        own, "storage_location_id", "left"
    ).join(archives, "archive_id", "left").select("media_file_id", "library", "archive")


def eligible_split(files: DataFrame, records: DataFrame, locations: DataFrame) -> DataFrame:
    """Whether a file has a finished record at its own library's archive, so that it can be restored or verified."""
    own = files.select(F.col("id").alias("media_file_id"), "storage_location_id").join(
        locations.select(
            F.col("id").alias("storage_location_id"), F.col("archive_location_id").alias("destination_id")
        ),
        "storage_location_id",
        "left",
    )
    done = records.filter("status = 'done'").select(
        "media_file_id", "destination_id", F.lit(True).alias("eligible")
    ).distinct()
    return own.join(done, ["media_file_id", "destination_id"], "left").select(
        "media_file_id", F.coalesce("eligible", F.lit(False)).alias("eligible")
    )


def runs_to_start(files: DataFrame, eligible: DataFrame, locations: DataFrame) -> DataFrame:
    """One run for each library and archive: how many files it takes and how many it skips."""
    joined = files.select(
        F.col("id").alias("media_file_id"), F.col("storage_location_id").alias("library_id")
    ).join(eligible, "media_file_id")
    own = locations.select(F.col("id").alias("library_id"), F.col("archive_location_id").alias("archive_id"))
    return joined.join(own, "library_id").groupBy("library_id", "archive_id").agg(
        F.count_if("eligible").alias("files"),
        F.count_if(~F.col("eligible")).alias("skipped"),
        F.coalesce(F.min(F.when(F.col("eligible"), F.col("media_file_id"))), F.lit(-1)).alias("first_file"),
    )
