"""Recovering the catalog from index documents: parsing, keys, grouping by content, sync plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import scalars
from stowage.operators.catalog import numbered_after
from stowage.session import settle

ENTRY = "struct<size:bigint,mtime:string,member:string,offset:bigint,paths:array<string>,paths_enc:string,compression:string,part:bigint,parts:bigint,sha256_enc:string>"
INDEX = f"v int, archive_id string, object string, type string, created_at string, size bigint, files map<string,{ENTRY}>, key_scheme string, key_check string, encrypted boolean"


def parse_index(documents: DataFrame) -> DataFrame:
    """key and the fields of each index document (key, body); bad where it isn't JSON or lacks a required field."""
    d = F.from_json("body", INDEX, {"mode": "PERMISSIVE"})
    parsed = documents.select("key", d.alias("d")).select("key", "d.*")
    bad = F.col("files").isNull() | (F.coalesce("object", F.lit("")) == "") | (
        F.coalesce("archive_id", F.lit("")) == ""
    )
    return parsed.withColumn("bad", bad)


def entries(parsed: DataFrame) -> DataFrame:
    """One row for each entry of the good documents: archive_id, object, type, key, entry."""
    return parsed.filter("not bad").select(
        "archive_id",
        "object",
        F.coalesce("type", F.lit("single")).alias("type"),
        F.coalesce("encrypted", F.lit(False)).alias("encrypted"),
        "key_scheme",
        F.explode("files").alias("key", "entry"),
    )


def open_entries(each: DataFrame, keys: DataFrame) -> DataFrame:
    """entries() with sha256 and paths. Keyed entries are opened: sha256_enc and paths_enc under their archive's key,
    with the entry's key as context.

    keys: archive_id, key (bytes). What no key opens is null; entries of unkeyed archives are named by their hash and
    have plain paths.
    """
    from stowage.operators.content import unseal

    joined = each.join(keys.select("archive_id", F.col("key").alias("own_key")), "archive_id", "left")
    opened = lambda name: unseal(F.col(f"entry.{name}"), F.col("own_key"), F.col("key"))
    real = F.when(
        F.col("entry.sha256_enc").isNotNull(), opened("sha256_enc")
    ).otherwise(F.when(F.col("key_scheme").isNull(), F.col("key")))
    paths = F.when(
        F.col("entry.paths_enc").isNotNull(), F.from_json(opened("paths_enc"), "array<string>")
    ).otherwise(F.col("entry.paths"))
    return joined.withColumn("sha256", real).withColumn("paths", paths).drop("own_key")


@dataclass
class Found:
    """What index documents tell of stored content. files: sha256, size_bytes, compression, paths, mtime_ns, and how many parts and
    copies there are. parts, a row each however many a hash has: sha256, size_bytes, part, archive_id, offset, type, encrypted, object.
    """

    files: DataFrame
    parts: DataFrame


def discover(each: DataFrame, listing: DataFrame) -> Found:
    """Files by content hash, from entries (see entries) with sha256 and paths whose archive object is listed.

    All entries of a hash must agree in size, time and compression, or the file is dropped. Paths are the first ones
    that can be read. The hash may be null where no key opens the entry; such entries have no identity and go. Parts are kept
    as rows: a content that very many archives hold, an empty file, is no list anywhere.
    """
    live = each.filter("sha256 is not null").join(
        listing.select(F.col("key").alias("object")).distinct(), "object", "left_semi"
    )
    one = settle(live.select(
        "sha256", "paths", "archive_id", "key", "type", "encrypted", "object", F.col("entry.size").alias("size_bytes"), F.col("entry.mtime").alias("mtime"),
        F.col("entry.compression").alias("compression"), F.coalesce("entry.part", F.lit(0)).alias("part"), F.coalesce("entry.offset", F.lit(0)).alias("offset"),
    ), "entries")
    same = F.struct("size_bytes", "mtime", "compression")
    first_paths = F.min_by("paths", F.when(F.col("paths").isNotNull(), F.struct("archive_id", "key"))).alias("paths")
    facts = one.groupBy("sha256").agg(
        F.min(same).alias("told"), F.max(same).alias("other"), first_paths, F.count(F.lit(1)).cast("int").alias("parts"), F.count_distinct("archive_id").cast("int").alias("copies")
    )
    whole = settle(facts.filter(F.col("told").eqNullSafe(F.col("other")) & F.col("told.size_bytes").isNotNull()).select(
        "sha256", "told.size_bytes", "told.compression", "paths", scalars.mtime_to_ns(F.col("told.mtime")).alias("mtime_ns"), "parts", "copies"
    ), "contents")
    parts = one.select("sha256", "size_bytes", "part", "archive_id", "offset", "type", "encrypted", "object")
    return Found(whole, parts.join(whole.select("sha256"), "sha256", "left_semi"))


def key_for_archive(parsed: DataFrame, keys: DataFrame, check_of: Column) -> DataFrame:
    """The key version whose check value an archive carries: the current one first, then the newest. keys is a short
    list by nature; -1: none opens it.
    """
    ranked = keys.select(
        F.col("id").alias("key_id"),
        check_of.alias("key_check"),
        F.struct(F.col("retired_at").isNotNull().alias("retired"), (-F.col("id")).alias("newest")).alias("rank"),
    )
    best = ranked.groupBy("key_check").agg(F.min_by("key_id", "rank").alias("key_id"))
    return parsed.filter("key_check is not null").select("archive_id", "key_check").join(
        F.broadcast(best), "key_check", "left"
    ).select("archive_id", F.coalesce("key_id", F.lit(-1)).alias("key_id"))


def key_by_opening(sealed: DataFrame, keys: DataFrame) -> DataFrame:
    """The key version that opens an archive's sealed value, for archives without a check value; -1: none does.

    sealed: archive_id, context, token; one value an archive is enough, so the smallest is tried. keys (id, retired_at,
    key) is a short list by nature, the current
    one is tried first, then the newest.
    """
    from stowage.operators.content import unseal

    one = sealed.groupBy("archive_id").agg(F.min(F.struct("context", "token")).alias("s")).select("archive_id", "s.*")
    tried = one.crossJoin(
        F.broadcast(
            keys.select(
                F.col("id").alias("key_id"),
                "key",
                F.struct(F.col("retired_at").isNotNull(), -F.col("id")).alias("rank"),
            )
        )
    )
    opened = F.when(unseal(F.col("token"), F.col("key"), F.col("context")).isNotNull(), F.col("rank"))
    return tried.groupBy("archive_id").agg(F.coalesce(F.min_by("key_id", opened), F.lit(-1)).alias("key_id"))


def key_match(found: DataFrame) -> DataFrame:
    """One word on whether the known keys open what is stored. found: encrypted, opened."""
    flags = found.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or("encrypted"), F.lit(False)).alias("enc"),
        F.coalesce(F.bool_or(F.col("encrypted") & F.col("opened")), F.lit(False)).alias("yes"),
        F.coalesce(F.bool_or(F.col("encrypted") & ~F.col("opened")), F.lit(False)).alias("no"),
    )
    return flags.select(
        F.when(F.col("n") == 0, "no_content").when(~F.col("enc"), "unencrypted").when(
            F.col("yes") & F.col("no"), "mixed"
        ).when(F.col("yes"), "match").otherwise("no_match").alias("verdict")
    )


def sync_plan(discovered: DataFrame, files: DataFrame, records: DataFrame, root: str) -> DataFrame:
    """For each path of the discovered content: already synced, candidate, or unresolved where no key opens its
    paths.
    """
    target = F.explode_outer("paths")
    each = discovered.select("sha256", "size_bytes", target.alias("path"))
    synced = records.filter(
        "status = 'done' and sha256 is not null"
    ).select("sha256", F.lit(True).alias("synced")).distinct()
    known = files.filter("fingerprint is not null").select("path", F.lit(True).alias("known")).distinct()
    joined = each.withColumn(
        "path", F.concat(F.lit(root), "path")
    ).join(synced, "sha256", "left").join(known, "path", "left")
    status = F.when(F.col("path").isNull(), "unresolved").when(
        F.col("synced") & F.col("known"), "already synced"
    ).otherwise("candidate")
    return joined.select("sha256", "path", "size_bytes", status.alias("status"))


def sync_archives(found: Found, archives: DataFrame, listing: DataFrame) -> DataFrame:
    """Each archive that discovered content needs, once: known, new or vanished."""
    needed = found.parts.select("archive_id").distinct()
    known = archives.select("archive_id", "path").distinct()
    stored = listing.select(F.col("key").alias("path"), F.lit(True).alias("stored")).distinct()
    joined = needed.join(known, "archive_id", "left").join(stored, "path", "left")
    return joined.select(
        "archive_id",
        F.when(F.col("path").isNull(), "new").when(
            F.col("stored").isNull(), "vanished"
        ).otherwise("known").alias("state"),
    )


def without_vanished(found: Found, states: DataFrame) -> Found:
    """The content none of whose archives has vanished (see sync_archives)."""
    gone = states.filter("state = 'vanished'").select("archive_id")
    lost = settle(found.parts.join(gone, "archive_id", "left_semi").select("sha256").distinct(), "lost")
    return Found(found.files.join(lost, "sha256", "left_anti"), found.parts.join(lost, "sha256", "left_anti"))


def sync_apply(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The files table with recovered paths added; a path that exists keeps its id."""
    fresh = plan.filter("status = 'candidate'").groupBy("path").agg(
        F.min("size_bytes").alias("size_bytes"), F.min("sha256").alias("sha256")
    )
    new = fresh.join(files.select("path"), "path", "left_anti")
    kept = files.select("id", "path", "size_bytes", "sha256")
    return kept.unionByName(numbered_after(files, new, "path").select("id", "path", "size_bytes", "sha256"))


def sync_archive_rows(found: Found, archives: DataFrame) -> DataFrame:
    """The archives table (id, archive_id, path, encrypted, archive_type) with a row for each archive that it didn't
    know, numbered in order of archive_id.
    """
    part = found.parts.select("archive_id", F.col("object").alias("path"), "encrypted", F.col("type").alias("archive_type"))
    new = part.groupBy("archive_id").agg(
        *[F.min(c).alias(c) for c in ("path", "encrypted", "archive_type")]
    ).join(archives.select("archive_id"), "archive_id", "left_anti")
    columns = "id", "archive_id", "path", "encrypted", "archive_type"
    return archives.select(*columns).unionByName(numbered_after(archives, new, "archive_id").select(*columns))


def sync_members(
    plan: DataFrame, found: Found, files: DataFrame, archives: DataFrame, destination: int, max_size: int
) -> DataFrame:
    """What recovered paths hold in which archive, as members for backup.record_archives: a part of a split file has
    its own length, not the file's.

    files and archives: the tables after sync_apply and sync_archive_rows. Of several copies of a part that of the
    smallest archive_id is linked.
    """
    one = found.parts.groupBy("sha256", "size_bytes", "part").agg(
        F.min_by(F.struct("archive_id", "offset", "type"), "archive_id").alias("c")
    ).select("sha256", "size_bytes", "part", "c.*")
    index = F.row_number().over(Window.partitionBy("sha256").orderBy("part")) - 1
    sizes = scalars.split_sizes(F.col("size_bytes"), scalars.payload_ceiling(max_size))
    length = F.when(
        F.col("type") == "part", scalars.part_length(sizes, F.col("part").cast("int"))
    ).otherwise(F.col("size_bytes"))
    placed = one.withColumn("part_index", index.cast("long")).withColumn("length", length.cast("long"))
    # of several contents at one path the one that the file's row has
    chosen = plan.filter("status = 'candidate'").groupBy("path").agg(F.min("sha256").alias("sha256"))
    wanted = chosen.join(files.select(F.col("id").alias("media_file_id"), "path"), "path")
    row = archives.groupBy("archive_id").agg(F.min("id").alias("row_id"))
    joined = wanted.join(placed, "sha256").join(row, "archive_id")
    return joined.select(
        F.col("row_id").alias("archive_id"),
        "media_file_id",
        F.lit(destination).cast("long").alias("destination_id"),
        "sha256",
        "part_index",
        "offset",
        "length",
    )
