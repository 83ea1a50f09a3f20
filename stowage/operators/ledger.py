"""The ledger of which bytes of which archive hold a file: parts, ranges, inventory against the listing,
verification.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from stowage.functions import paths, scalars
from stowage.session import settle
from stowage.sources import objects

MERGE_GAP = 256 * 1024


def trusted(archives: DataFrame) -> DataFrame:
    """Archives whose index was written; others are never relied on."""
    return archives.filter("archive_id is not null and indexed_at is not null")


def ledger_parts(records: DataFrame, links: DataFrame, archives: DataFrame) -> DataFrame:
    """For each record its parts in order, and the bytes that are stored for it."""
    joined = links.join(trusted(archives).select(F.col("id").alias("backup_archive_id"), "path"), "backup_archive_id")
    part = F.struct("part_index", "path", "archive_offset", "archive_length")
    held = joined.groupBy("backup_record_id").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.sum("archive_length").alias("stored_bytes")
    )
    return records.join(
        held, F.col("id") == F.col("backup_record_id")
    ).select("id", "media_file_id", "parts", "stored_bytes")


def stored_pieces(links: DataFrame, start: Column, length: Column) -> DataFrame:
    """(record, archive, offset, length) of the bytes that cover [start, start + length) of each record's stored
    bytes.
    """
    before = F.sum("archive_length").over(
        Window.partitionBy("backup_record_id").orderBy("part_index").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = links.withColumn("from", F.coalesce(before, F.lit(0))).withColumn(
        "to", F.col("from") + F.col("archive_length")
    )
    low, high = F.greatest(start, F.col("from")), F.least(start + length, F.col("to"))
    return placed.withColumn("lo", low).withColumn("hi", high).filter("lo < hi").select(
        "backup_record_id",
        "backup_archive_id",
        (F.col("archive_offset") + F.col("lo") - F.col("from")).alias("offset"),
        (F.col("hi") - F.col("lo")).alias("length"),
    )


def wanted_pieces(
    records: DataFrame, links: DataFrame, archives: DataFrame, sample: int = scalars.MIB, budget: int = 4 * scalars.MIB
) -> DataFrame:
    """The stored bytes that a shallow verification of each record reads."""
    joined = links.join(
        trusted(archives).select(F.col("id").alias("backup_archive_id"), "encrypted"), "backup_archive_id"
    )
    totals = joined.groupBy("backup_record_id").agg(
        F.sum("archive_length").alias("total"), F.min_by("encrypted", "part_index").alias("first_encrypted")
    )
    ranges = totals.withColumn(
        "want", F.explode(scalars.wanted_ranges(F.col("total"), F.col("first_encrypted"), sample, budget))
    ).select("backup_record_id", F.col("want.start").alias("start"), F.col("want.length").alias("want"))
    before = F.sum("archive_length").over(
        Window.partitionBy("backup_record_id").orderBy("part_index").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = joined.withColumn("from", F.coalesce(before, F.lit(0)))
    both = placed.join(ranges, "backup_record_id")
    lo, hi = F.greatest("start", "from"), F.least(
        F.col("start") + F.col("want"), F.col("from") + F.col("archive_length")
    )
    return both.withColumn("lo", lo).withColumn("hi", hi).filter("lo < hi").select(
        "backup_record_id",
        "backup_archive_id",
        (F.col("archive_offset") + F.col("lo") - F.col("from")).alias("offset"),
        (F.col("hi") - F.col("lo")).alias("length"),
        F.col("lo").alias("at"),
    )


def merge_ranges(pieces: DataFrame, gap: int = MERGE_GAP) -> DataFrame:
    """Ranges of one archive that overlap or lie at most `gap` apart become one read."""
    order = Window.partitionBy("backup_archive_id").orderBy("offset", "end")
    ends = pieces.withColumn("end", F.col("offset") + F.col("length")).withColumn(
        "reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    marked = ends.withColumn(
        "new", F.when(F.col("reach").isNull() | (F.col("offset") - F.col("reach") > gap), 1).otherwise(0)
    ).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("backup_archive_id", "run").agg(
        F.min("offset").alias("offset"), F.max("end").alias("end")
    ).select("backup_archive_id", "offset", (F.col("end") - F.col("offset")).alias("length"))


def _named_objects(listing: DataFrame) -> DataFrame:
    """key, size, folder, ident, is_archive of the listed archive and index objects, from one pass over the listing."""
    (folder, ident), (ifolder, iident) = paths.archive_parts(F.col("key")), paths.index_parts(F.col("key"))
    named = listing.select(
        "key",
        "size",
        F.coalesce(folder, ifolder).alias("folder"),
        F.coalesce(ident, iident).alias("ident"),
        ident.isNotNull().alias("is_archive"),
    )
    return named.filter("ident is not null")


def inventory(listing: DataFrame, archives: DataFrame) -> DataFrame:
    """key, finding for archive objects and index objects that don't match the ledger or each other."""
    named = settle(_named_objects(listing).drop("size"), "objects")
    found, indexes = named.filter("is_archive"), named.filter("not is_archive").withColumnRenamed("key", "index_key")
    known = archives.select(F.col("path").alias("key")).distinct()
    # a key listed or in the ledger, but not both; and a (folder, id) with an archive or an index, but not both
    tracked = found.select("key", F.lit(1).alias("listed"), F.lit(0).alias("kept")).unionByName(
        known.select("key", F.lit(0).alias("listed"), F.lit(1).alias("kept"))
    )
    sides = tracked.groupBy("key").agg(
        F.max("listed").alias("listed"), F.max("kept").alias("kept")
    ).filter("listed <> kept")
    unmatched = sides.select("key", F.when(F.col("listed") == 1, "untracked").otherwise("missing").alias("finding"))
    pairs = found.join(indexes, ["folder", "ident"], "full_outer").filter("key is null or index_key is null")
    odd = pairs.select(
        F.coalesce("key", "index_key").alias("key"),
        F.when(F.col("key").isNull(), "orphan_index").otherwise("no_index").alias("finding"),
    )
    return unmatched.unionByName(odd)


def discover_report(listing: DataFrame) -> DataFrame:
    named = settle(_named_objects(listing), "objects")
    indexes = named.filter("not is_archive").select("folder", "ident", F.lit(1).alias("has")).distinct()
    found = named.filter("is_archive").join(indexes, ["folder", "ident"], "left")
    return found.agg(
        F.count(F.lit(1)).alias("found_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("found_size"),
        F.count_if(F.col("has").isNull()).alias("no_index_count"),
    )


def prefix_counts(archives: DataFrame) -> DataFrame:
    return archives.select(
        "id", F.regexp_extract("path", "^(.*/)[^/]*$", 1).alias("prefix")
    ).distinct().groupBy("prefix").agg(F.count(F.lit(1)).alias("archives"))


def archive_key(archives: DataFrame, keys: DataFrame) -> DataFrame:
    """The key version that opens each archive; the current one where the recorded one is null or gone."""
    current = keys.filter("retired_at is null").agg(F.max("id").alias("current"))
    known = keys.select(F.col("id").alias("known"))
    return archives.join(
        F.broadcast(known), F.col("key_version_id") == F.col("known"), "left"
    ).crossJoin(F.broadcast(current)).select("id", F.coalesce("known", "current").alias("key_id"))


def index_entry_lookup(
    records: DataFrame, links: DataFrame, archives: DataFrame, entries: DataFrame, content_id: Column
) -> DataFrame:
    """The index entry of each link: under the file's hash, or under its content id in archives that are keyed."""
    joined = links.join(
        trusted(archives).select(F.col("id").alias("backup_archive_id"), "archive_id", "encrypted"), "backup_archive_id"
    ).join(records.select(F.col("id").alias("backup_record_id"), "sha256"), "backup_record_id")
    keyed = joined.withColumn("entry_key", F.when(F.col("encrypted"), content_id).otherwise(F.col("sha256")))
    return keyed.join(entries, ["archive_id", "entry_key"], "left")


def verify_shallow(
    records: DataFrame,
    links: DataFrame,
    archives: DataFrame,
    listing: DataFrame,
    entries: DataFrame,
    content_id: Column,
    local: DataFrame,
    ends: DataFrame | None = None,
) -> DataFrame:
    """One verdict a record: the first failing check of its archives in order.

    First all objects' metadata (missing, then size or checksum), then the index entries (missing, other offset or
    compression), then whether the local file is
    still the one that was stored (changed). entries: archive_id, entry_key, entry_offset, entry_compression, a written
    table with a row of null key for an index
    without entries. Where an archive has a content more than once, one entry of it must fit.
    The table and the listing are read once and an archive is judged once, before the links meet it. local: media_file_id, same (null: gone). ends: backup_record_id, sound (see sampled_ends), the bytes' own step, before the last.
    """
    found = listing.select(
        F.col("key").alias("path"), F.col("size").alias("object_size"), F.col("crc32c").alias("object_crc")
    )
    indexed = entries.select("archive_id", F.lit(True).alias("has_index")).distinct()
    step = lambda n, verdict: F.struct(F.lit(n).alias("step"), F.lit(verdict).alias("verdict"))
    bad_size = (F.col("object_size") != F.col("size_bytes")) | F.coalesce(
        F.col("crc32c").isNotNull() & ~F.col("crc32c").eqNullSafe(F.col("object_crc")), F.lit(False)
    )
    state = F.when(
        F.col("object_size").isNull(), step(1, "missing")
    ).when(bad_size, step(1, "mismatch")).when(F.col("has_index").isNull(), step(2, "missing"))
    judged = trusted(archives).join(found, "path", "left").join(indexed, "archive_id", "left")
    judged = judged.select(
        F.col("id").alias("backup_archive_id"), "archive_id", "encrypted", "archive_type", state.alias("state")
    )
    linked = links.join(judged, "backup_archive_id").select("backup_record_id", "part_index", "archive_offset", "archive_id", "encrypted", "archive_type", "state")
    keyed = linked.join(
        records.select(F.col("id").alias("backup_record_id"), "sha256", "compression"), "backup_record_id"
    ).withColumn("entry_key", F.when(F.col("encrypted"), content_id).otherwise(F.col("sha256")))
    # links and entries of one content in one archive meet by a digest of both names; an entry fits by its compression, and by its offset
    # but for parts
    name = F.unhex(F.sha2(F.concat_ws("\0", "archive_id", "entry_key"), 256))
    place = F.when(F.col("archive_type") != "part", F.col("archive_offset"))
    asked = keyed.select(
        F.when(F.col("archive_id").isNotNull() & F.col("entry_key").isNotNull(), name).alias("name"), F.col("compression").alias("as"), place.alias("place"),
        F.lit(False).alias("told"), "backup_record_id", "part_index", "state",
    )
    told = entries.filter("archive_id is not null and entry_key is not null and entry_offset is not null").select(
        name.alias("name"), F.col("entry_compression").alias("as"), F.col("entry_offset").alias("place"), F.lit(True).alias("told")
    )
    both = asked.unionByName(told, allowMissingColumns=True).repartition("name", "as")
    there = lambda *of: F.bool_or("told").over(Window.partitionBy("name", "as", *of))
    fits = F.col("name").isNotNull() & F.when(F.col("place").isNull(), there()).otherwise(there("place"))
    joined = both.withColumn("fits", fits).filter("not told")
    index = F.when(~F.col("fits"), step(2, "mismatch"))
    failed = F.coalesce("state", index)
    ranked = F.when(
        failed.isNotNull(),
        F.struct(failed["step"].alias("step"), F.col("part_index").alias("part"), failed["verdict"].alias("verdict")),
    )
    first = joined.groupBy("backup_record_id").agg(F.min(ranked).alias("bad"))
    whole = records.join(first, F.col("id") == F.col("backup_record_id")).join(local, "media_file_id", "left")
    sound = F.lit(True)
    if ends is not None:
        whole = whole.join(ends.select(F.col("backup_record_id").alias("id"), "sound"), "id", "left")
        sound = F.coalesce("sound", F.lit(True))
    verdict = F.when(F.col("sha256").isNull(), "mismatch").when(
        F.col("bad").isNotNull(), F.col("bad.verdict")
    ).when(~sound, "mismatch").when(~F.col("same"), "changed").otherwise("match")
    return whole.select("id", verdict.alias("verdict"))


def read_ends(
    records: DataFrame, links: DataFrame, archives: DataFrame, root: str, sample: int = scalars.MIB, budget: int = 4 * scalars.MIB
) -> DataFrame:
    """backup_record_id, total, head, tail, requests: the ends of each record's stored bytes, read below the root.

    The ranges that all records want of an archive meet in one task, which reads what lies near each other by one request
    and hands each record its own pieces; pieces of split records are put together in their order. head is the whole
    where that is what is wanted, and then tail too. A record whose bytes aren't all there has null ends; one that isn't
    sampled, a sealed one over the budget, has no row.
    """
    wanted = wanted_pieces(records, links, archives, sample, budget)
    keyed = wanted.join(archives.select(F.col("id").alias("backup_archive_id"), F.col("path").alias("key")), "backup_archive_id")
    read = objects.read_ranges(keyed.select("key", "offset", "length", "backup_record_id", "at"), root)
    totals = links.groupBy("backup_record_id").agg(F.sum("archive_length").alias("total"))
    piece = F.struct("at", "length", "data")
    held = read.groupBy("backup_record_id").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"),
        F.bool_and(F.coalesce(F.octet_length("data") == F.col("length"), F.lit(False))).alias("all"),
        F.sum("requests").alias("requests"),
    ).join(totals, "backup_record_id")  # at most twice the sample or the budget of a record
    joined = lambda pieces: F.unhex(F.array_join(F.transform(pieces, lambda p: F.hex(p["data"])), ""))
    split = held.withColumn("two", F.col("total") > F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["length"]))
    head = F.filter("pieces", lambda p: ~F.col("two") | (p["at"] < sample))
    tail = F.filter("pieces", lambda p: ~F.col("two") | (p["at"] >= F.col("total") - sample))
    return split.select(
        "backup_record_id", "total", F.when(F.col("all"), joined(head)).alias("head"), F.when(F.col("all"), joined(tail)).alias("tail"), "requests"
    )


@F.pandas_udf(BinaryType())
def _inflated_start(head: pd.Series) -> pd.Series:
    """What the start of a gzip stream, without the size at its end, inflates to; null if it isn't one."""
    out = []
    for data in head:
        try:
            out.append(None if data is None else zlib.decompressobj(31).decompress(bytes(data), 1 << 20))
        except zlib.error:
            out.append(None)
    return pd.Series(out, dtype=object)


def _number(column: Column, at: Column | int, n: int, little: bool = False) -> Column:
    """The n bytes from at (from 1) on as a number."""
    places = range(n - 1, -1, -1) if little else range(n)
    digits = F.concat(*(F.hex(F.substring(column, F.lit(at) + k, F.lit(1))) for k in places))
    return F.conv(digits, 16, 10).cast("long")


def sampled_ends(
    ends: DataFrame, records: DataFrame, local: DataFrame, header: int = objects.HEADER, tag: int = objects.TAG, magic: bytes = b"SBE1"
) -> DataFrame:
    """backup_record_id, sound: whether the sampled ends of what is stored (see read_ends) are what they should be.

    records: id, compressed, seal (the key of its seal, null: none). local: backup_record_id, size, crc, content of the file as it was
    stored; no row where it is gone or changed, and then only the form is judged. Sealed bytes must have a right header and total,
    and their first and last chunk must open; compressed ones must have a gzip frame that inflates and whose trailer has the file's
    checksum and size; then both ends must be the file's bytes.
    """
    both = ends.join(records.select(F.col("id").alias("backup_record_id"), "compressed", "seal"), "backup_record_id").join(
        local.select("backup_record_id", F.col("size").alias("own_size"), F.col("crc").alias("own_crc"), F.col("content").alias("own")),
        "backup_record_id", "left",
    )
    blob, sealed = F.col("head"), F.col("seal").isNotNull()
    top, chunk, plain = F.substring(blob, 1, header), _number(blob, 9, 4), _number(blob, 13, 8)
    n = F.greatest(F.ceil(F.col("plain_size") / F.col("chunk")), F.lit(1))
    formed = (F.substring(blob, 1, 4) == F.lit(magic)) & (F.col("chunk") > 0) & (F.col("total") == header + F.col("plain_size") + n * tag)
    told = both.withColumn("chunk", F.when(sealed, chunk)).withColumn("plain_size", F.when(sealed, plain)).withColumn("n", F.when(sealed, n))

    def opened(i: Column) -> Column:
        at = header + 1 + i * (F.col("chunk") + tag)
        size = F.least(F.col("chunk"), F.col("plain_size") - i * F.col("chunk")) + tag
        nonce = F.concat(F.substring(blob, 5, 4), F.unhex(F.lpad(F.hex(i.cast("long")), 16, "0")))
        piece = F.substring(blob, at.cast("int"), size.cast("int"))
        return F.try_aes_decrypt(F.concat(nonce, piece), F.col("seal"), F.lit("GCM"), F.lit("DEFAULT"), top)

    right = sealed & F.coalesce(formed, F.lit(False))
    plainly = told.select(
        "backup_record_id", "compressed", "own_size", "own_crc", "own",
        F.when(right, opened(F.lit(0).cast("long"))).when(~sealed, blob).alias("first"),
        # two chunks: a gzip trailer may lie across the last cut
        F.when(right & (F.col("n") > 1), F.concat(opened(F.col("n") - 2), opened(F.col("n") - 1))).when(right, opened(F.col("n") - 1)).when(~sealed, F.col("tail")).alias("last"),
        F.when(right, F.col("plain_size")).when(~sealed, F.col("total")).alias("stream"),
    )
    first, last, stream = F.col("first"), F.col("last"), F.col("stream")
    # the size in the trailer is judged against the file below, alike for streams that the sample holds whole and for longer ones
    body = F.substring(first, F.lit(1), F.least(F.octet_length(first).cast("long"), stream - 4).cast("int"))
    inflated = plainly.withColumn("start", F.when(F.col("compressed"), _inflated_start(body)))
    at_start = lambda c, own: F.substring(own, F.lit(1), F.octet_length(c)) == c
    end = F.octet_length(last)
    gone = F.col("own_size").isNull()
    as_is = gone | (F.col("own_size") == stream) & at_start(first, F.col("own")) & (F.substring(F.col("own"), (stream - end + 1).cast("int"), end) == last)
    trailer = (_number(last, end - 7, 4, little=True) == F.col("own_crc")) & (_number(last, end - 3, 4, little=True) == F.col("own_size") % (1 << 32))
    frame = (F.hex(F.substring(first, 1, 2)) == "1F8B") & (stream >= 18) & (end >= 8) & F.col("start").isNotNull()
    packed = frame & (gone | trailer & at_start(F.col("start"), F.col("own")))
    sound = first.isNotNull() & last.isNotNull() & F.when(F.col("compressed"), packed).otherwise(as_is)
    return inflated.select("backup_record_id", F.coalesce(sound, F.lit(False)).alias("sound"))


def verify_apply(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The next records: a verdict replaces verify_status where there is one."""
    return records.join(verdicts.select("id", "verdict"), "id", "left").select(
        "id",
        F.coalesce("verdict", "verify_status").alias("verify_status"),
        F.col("verdict").isNotNull().alias("verified"),
    )


def restore_plan(
    files: DataFrame,
    records: DataFrame,
    links: DataFrame,
    archives: DataFrame,
    listing: DataFrame,
    replace_older: bool = True,
) -> DataFrame:
    """Per selected file: restore, skipped (the local file is as new), or failed; with the archive and offset of its
    first part for the order of reads.
    """
    first = links.join(trusted(archives).select(F.col("id").alias("backup_archive_id")), "backup_archive_id").groupBy(
        "backup_record_id"
    ).agg(F.min_by(F.struct("backup_archive_id", "archive_offset"), "part_index").alias("first"))
    usable = records.filter("status = 'done'").join(first, F.col("id") == F.col("backup_record_id")).select(
        "media_file_id", F.col("id").alias("record_id"), F.col("mtime_ns").alias("stored_ns"), "first"
    )
    best = usable.groupBy("media_file_id").agg(
        F.min_by(F.struct("record_id", "stored_ns", "first"), "record_id").alias("r")
    )
    local = listing.groupBy("path").agg(F.max("mtime_ns").alias("local_ns"))
    joined = files.join(best, F.col("id") == F.col("media_file_id"), "left").join(local, "path", "left")
    newer = F.lit(replace_older) & (F.col("local_ns") >= F.col("r.stored_ns"))
    action = F.when(F.col("r").isNull(), "failed").when(F.coalesce(newer, F.lit(False)), "skipped").otherwise("restore")
    return joined.select(
        "id",
        action.alias("action"),
        F.coalesce("r.record_id", F.lit(-1)).alias("record_id"),
        F.coalesce("r.first.backup_archive_id", F.lit(-1)).alias("archive_id"),
        F.coalesce("r.first.archive_offset", F.lit(-1)).alias("archive_offset"),
    )


def upload_confirm(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Staged objects whose stored size or checksum isn't what was sent, or that aren't stored."""
    stored = listing.select(
        F.col("key").alias("path"), F.col("size").alias("stored_size"), F.col("crc32c").alias("stored_crc")
    )
    joined = manifest.join(stored, "path", "left")
    why = F.when(F.col("stored_size").isNull(), "absent").when(
        F.col("stored_size") != F.col("size_bytes"), "size"
    ).when(F.col("crc32c").isNotNull() & ~F.col("crc32c").eqNullSafe(F.col("stored_crc")), "checksum")
    return joined.select("path", why.alias("problem")).filter("problem is not null")
