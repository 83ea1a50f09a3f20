"""Queries over real files: documents are stored as objects, archives and parts in the shared folder, and listed, read by ranges,
verified and restored from there.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.operators import content, ledger, mutations
from stowage.plans.registry import query
from stowage.session import settle, shared_dir
from stowage.sources import events, listing, objects
from stowage.sources.views import Tables
from stowage.streaming import progress

CHUNK, SAMPLE, ARCHIVE_BYTES = 1024, 512, 1 << 20


def _root(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _texts(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "source", "lang", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))


# -- listing


def _library(t: Tables) -> str:
    """A folder with a file for each document, below folders for its source and its language; `none` where it has none."""
    root = _root(t, "library")
    name = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.lit("doc-"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, ".TXT").otherwise(".md")))
    objects.put_objects(_texts(t).select(name.alias("key"), "content"), root)
    return root


_SCANNED = "SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc-' || doc_id || ext AS path, 'doc-' || doc_id || ext AS name, lower(substr(ext, 2)) AS suffix, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '.TXT' ELSE '.md' END AS ext FROM documents)"


@query(_SCANNED)
def scan_folder(t: Tables) -> DataFrame:
    """A real scan, file by file. No content is read."""
    return listing.list_files(t.spark, _library(t)).select("path", "name", "suffix", "size")


@query(f"SELECT * FROM ({_SCANNED}) AS s WHERE starts_with(path, coalesce((SELECT min(source) FROM documents), 'none') || '/e')")
def scan_prefix(t: Tables) -> DataFrame:
    """The listing of a prefix: the source's filter is pushed down, and other folders aren't listed."""
    first = t.documents.agg(F.coalesce(F.min("source"), F.lit("none"))).first()[0]
    return listing.list_files(t.spark, _library(t)).filter(F.col("path").startswith(f"{first}/e")).select("path", "name", "suffix", "size")


# -- events


@query("SELECT id, level, title FROM notification_events WHERE id > 500 ORDER BY id LIMIT 20")
def poll_events(t: Tables) -> DataFrame:
    return progress.poll(t.notification_events, 500).select("id", "level", "title")


@query("SELECT id, level, title FROM notification_events WHERE id > 500 ORDER BY id LIMIT 60")
def poll_events_stream(t: Tables) -> DataFrame:
    """Three polls of a stream that is started anew for each; the cursor is in its checkpoint."""
    root = _root(t, "events")
    t.notification_events.write.parquet(f"{root}/in")
    for _ in range(3):
        polled = events.poll_stream(t.spark, f"{root}/in", after=500).writeStream.format("parquet").option("path", f"{root}/out")
        polled.option("checkpointLocation", f"{root}/marks").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(t.notification_events.schema).parquet(f"{root}/out").select("id", "level", "title")


# -- ranges and archives


@query("SELECT CAST(doc_id AS VARCHAR) AS key, (doc_id % 50)::BIGINT AS \"offset\", 40::BIGINT AS length, lower(hex(encode(text)[(doc_id % 50) + 1 : (doc_id % 50) + 40])) AS data FROM documents")
def range_read(t: Tables) -> DataFrame:
    root, key = _root(t, "objects"), F.col("id").cast("string").alias("key")
    objects.put_objects(_texts(t).select(key, "content"), root)
    ranges = _texts(t).select(key, (F.col("id") % 50).alias("offset"), F.lit(40).cast("long").alias("length"))
    return objects.read_ranges(ranges, root).select("key", "offset", "length", F.lower(F.hex("data")).alias("data"))


_TARS = f"""
    w AS (SELECT source || '-' || (sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id) - octet_length(encode(text))) // {ARCHIVE_BYTES} AS archive, octet_length(encode(text)) AS n FROM documents),
    ta AS (SELECT archive, (sum(512 + (n + 511) // 512 * 512) + 1024 + 10239) // 10240 * 10240 AS tar_size, count(*) AS members FROM w GROUP BY archive)
"""


@query(f"WITH {_TARS} SELECT archive, tar_size::BIGINT AS tar_size, members::BIGINT AS members FROM ta")
def write_archives(t: Tables) -> DataFrame:
    """Archives as files; their sizes are those that a listing tells afterwards."""
    root, texts = _root(t, "archives"), _texts(t)
    sizes = texts.select("id", "source", F.octet_length("content").cast("long").alias("n_bytes"))
    dealt = content.deal_to_archives(sizes, "source", "id", ARCHIVE_BYTES)
    members = texts.join(dealt.select("id", "archive"), "id").select("archive", F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("member"), F.col("id").alias("n"), "content")
    written = objects.put_tars(members, root).groupBy("archive").agg(F.count(F.lit(1)).alias("members"))
    found = listing.list_files(t.spark, root).select(F.col("path").alias("archive"), F.col("size").alias("tar_size"))
    return written.join(found, "archive").select("archive", "tar_size", "members")


# -- a vault: split, clumped, compressed and sealed records, some damaged or lost


@dataclass
class Vault:
    root: str
    records: DataFrame
    links: DataFrame
    archives: DataFrame
    entries: DataFrame


def _content_id() -> Column:
    return F.sha2(F.concat(F.lit("id:"), "sha256"), 256)


def _vault(t: Tables) -> Vault:
    """Every document stored: of four, one as it is, one compressed, one sealed, one both; every third in three parts, every
    thirteenth in an archive of its own that is lost, the others clumped; of every eleventh the last stored byte is turned.
    """
    root, ident = _root(t, "vault"), F.col("id")
    seal = ident % 4 >= 2
    own = F.sha2(ident.cast("string"), 256)
    files = _texts(t).select(
        "id", "source", "content", F.when(ident % 2 == 1, "txt").otherwise("jpg").alias("extension"),
        F.when(seal, F.unhex(own)).alias("key"), F.when(seal, F.unhex(F.substring(own, 1, 8))).alias("prefix"),
    )
    prepared = settle(content.prepare(files, CHUNK), "prepared")
    last = F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("stored", -1, 1)), 16, 10).cast("long").bitwiseXOR(F.lit(255))), 2, "0"))
    turned = F.concat(F.expr("substring(stored, 1, octet_length(stored) - 1)"), last)
    stored = prepared.withColumn("stored", F.when((ident % 11 == 0) & (F.octet_length("stored") > 0), turned).otherwise(F.col("stored")))
    kind = F.when(ident % 13 == 0, "single").when(ident % 3 == 0, "part").otherwise("clump")
    third = F.greatest(F.ceil(F.octet_length("stored") / 3).cast("int"), F.lit(1))
    at = F.when(F.col("kind") == "part", F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (k == 0) | (k * third < F.octet_length("stored")))).otherwise(F.array(F.lit(0)))
    cut = stored.withColumn("kind", kind).select("*", F.explode(at).alias("k"))
    piece = F.when(F.col("kind") == "part", F.substring("stored", F.col("k") * third + 1, third)).otherwise(F.col("stored"))
    # contents are kept once, as prepared; what is narrow is taken from there again
    pieces = cut.select("id", "kind", "sealed", "k", piece.alias("content")).withColumn("n_bytes", F.octet_length("content").cast("long"))
    sizes = pieces.filter("kind = 'clump'").join(files.select("id", "source"), "id").select(
        "id", F.concat_ws("-", F.coalesce("source", F.lit("none")), F.col("sealed").cast("string")).alias("group"), "n_bytes"
    )
    clumps = settle(content.deal_to_archives(sizes, "group", "id", 64 << 10).select("id", "archive"), "clumps")
    number = F.concat_ws("-", F.col("kind"), F.col("id").cast("string"), F.col("k").cast("string"))
    archive = F.concat(F.lit("archives/"), F.coalesce("archive", number), F.lit(".tar")).alias("archive")
    members = lambda some: some.join(clumps, "id", "left").withColumn("archive", archive).withColumn("member", number)
    written = objects.put_tars(members(pieces.filter("kind <> 'single'")).select("archive", "member", ident.alias("n"), "content"), root)
    placed = members(pieces.drop("content")).join(written, ["archive", "member"], "left")
    links = settle(placed.select(
        ident.alias("backup_record_id"), F.col("k").cast("long").alias("part_index"), F.col("archive").alias("backup_archive_id"), "kind", "sealed",
        F.coalesce("offset", F.lit(512)).cast("long").alias("archive_offset"), F.col("n_bytes").alias("archive_length"),
    ), "links")
    sizes = listing.list_files(t.spark, root).select("path", F.col("size").alias("size_bytes"))
    each = links.groupBy("backup_archive_id").agg(F.first("kind").alias("archive_type"), F.first("sealed").alias("encrypted")).withColumnRenamed("backup_archive_id", "id")
    archives = settle(each.join(sizes, F.col("id") == F.col("path"), "left").select(
        "id", F.col("id").alias("path"), F.col("id").alias("archive_id"), F.lit(1).alias("indexed_at"), "encrypted", "archive_type", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), F.lit(None).cast("string").alias("crc32c"),
    ), "archives")
    hashed = files.select("id", F.sha2("content", 256).alias("sha256"), "key")
    records = settle(hashed.join(prepared.select("id", "compressed"), "id").select(
        "id", F.col("id").alias("media_file_id"), "sha256", F.when(F.col("compressed"), "gzip").alias("compression"), "compressed", F.col("key").alias("seal")
    ), "records")
    entry = links.join(records.select(F.col("id").alias("backup_record_id"), "sha256", "compression"), "backup_record_id").select(
        F.col("backup_archive_id").alias("archive_id"), F.when(F.col("sealed"), _content_id()).otherwise(F.col("sha256")).alias("entry_key"),
        F.col("archive_offset").alias("entry_offset"), F.col("compression").alias("entry_compression"),
    ).distinct()
    return Vault(root, records, links, archives, settle(entry, "entries"))


@query("""
    SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 AND (doc_id % 4 >= 2 OR (octet_length(encode(coalesce(text, ''))) > 0 AND doc_id % 8 <> 3 AND doc_id % 9 <> 0)) THEN 'mismatch' WHEN doc_id % 8 = 3 THEN 'changed' ELSE 'match' END AS verdict
    FROM documents
""")
def verify_bytes(t: Tables) -> DataFrame:
    """Shallow verification with all its steps: the listing of the vault, the index, and the bytes at both ends of what is stored, split and
    sealed records included. Every eighth local file was changed, every ninth is gone.
    """
    v = _vault(t)
    state = F.when(F.col("id") % 8 == 3, False).when(F.col("id") % 9 != 0, True)
    local = v.records.select("id", "media_file_id", state.alias("same"))
    contents = _texts(t).select("id", "content")
    same = local.filter("same").join(contents, "id").select(
        F.col("id").alias("backup_record_id"), F.octet_length("content").cast("long").alias("size"), F.crc32("content").alias("crc"), "content"
    )
    found = listing.list_files(t.spark, v.root).select(F.col("path").alias("key"), "size", F.lit(None).cast("string").alias("crc32c"))
    ends = settle(ledger.read_ends(v.records, v.links, v.archives, v.root, SAMPLE), "ends")
    sound = ledger.sampled_ends(ends, v.records, same)
    return ledger.verify_shallow(v.records, v.links.drop("sealed", "kind"), v.archives, found, v.entries, _content_id(), local.drop("id"), sound)


def _streamed(v: Vault) -> DataFrame:
    links = v.links.select(
        F.col("backup_record_id").alias("id"), F.col("part_index").alias("part"), F.col("backup_archive_id").alias("key"), F.col("archive_offset").alias("offset"),
        F.col("archive_length").alias("length"), (F.col("kind") == "part").alias("whole"),
    )
    return links.join(v.records.select("id", "sha256", "compressed", "seal", F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("name")), "id")


@query("""
    SELECT doc_id AS id, verdict, CASE WHEN verdict = 'ok' THEN n ELSE 0 END::BIGINT AS bytes
    FROM (SELECT doc_id, n, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 AND (doc_id % 4 >= 2 OR n > 0) THEN 'mismatch' ELSE 'ok' END AS verdict FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents))
""")
def restore_stream(t: Tables) -> DataFrame:
    """Every record restored from the vault's files as a stream: opened, inflated, hashed."""
    v = _vault(t)
    return content.restore_streams(_streamed(v), v.root).drop("digest")


@query("SELECT 'doc-' || doc_id AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents WHERE doc_id % 13 <> 0 AND NOT (doc_id % 11 = 0 AND (doc_id % 4 >= 2 OR octet_length(encode(coalesce(text, ''))) > 0))")
def restore_files(t: Tables) -> DataFrame:
    """The files that a restore leaves in its target: what verifies, and nothing half done."""
    v, target = _vault(t), _root(t, "restored")
    settle(content.restore_streams(_streamed(v), v.root, target), "restored")
    return listing.list_files(t.spark, target).select("path", "size")


# -- plain copies, each an object or two


@query("SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 AND octet_length(encode(text)) > 200 THEN 'mismatch' ELSE 'match' END AS verdict FROM documents")
def verify_ends(t: Tables) -> DataFrame:
    """The ends of each stored object, 100 bytes each, against the local file's. Of every eleventh longer one the tail is damaged."""
    root, texts = _root(t, "objects"), _texts(t)
    size = F.octet_length("content")
    damaged = F.concat(F.substring(F.col("content"), F.lit(1), size - 3), F.lit(b"\0\0\0"))
    stored = texts.select(F.col("id").cast("string").alias("key"), F.when((F.col("id") % 11 == 0) & (size > 200), damaged).otherwise(F.col("content")).alias("content"))
    put = objects.put_objects(stored, root)
    archives = put.select(F.col("key").alias("id"), F.col("key").alias("path"), F.col("key").alias("archive_id"), F.lit(1).alias("indexed_at"), F.lit(False).alias("encrypted"))
    links = put.select(F.col("key").cast("long").alias("backup_record_id"), F.lit(0).alias("part_index"), F.col("key").alias("backup_archive_id"), F.lit(0).cast("long").alias("archive_offset"), F.col("size").alias("archive_length"))
    records = texts.select("id", F.lit(False).alias("compressed"), F.lit(None).cast("binary").alias("seal"))
    local = texts.select(F.col("id").alias("backup_record_id"), size.cast("long").alias("size"), F.crc32("content").alias("crc"), "content")
    sound = ledger.sampled_ends(settle(ledger.read_ends(records, links, archives, root, 100), "ends"), records, local)
    return records.join(sound, F.col("id") == F.col("backup_record_id"), "left").select("id", F.when(F.coalesce("sound", F.lit(True)), "match").otherwise("mismatch").alias("verdict"))


def _restored(t: Tables) -> DataFrame:
    """Objects of two parts each; of every eleventh the second one has another content."""
    root, texts = _root(t, "parts"), _texts(t)
    half = F.floor(F.octet_length("content") / 2).cast("int")
    rest = F.when(F.col("id") % 11 == 0, F.lit(b"?")).otherwise(F.substring(F.col("content"), half + 1, F.octet_length("content")))
    both = F.explode(F.array(F.struct(F.lit(1).alias("part"), F.substring(F.col("content"), F.lit(1), half).alias("data")), F.struct(F.lit(2).alias("part"), rest.alias("data"))))
    cut = texts.select("id", both.alias("p")).select("id", "p.part", F.concat_ws("-", F.col("id").cast("string"), F.col("p.part").cast("string")).alias("key"), F.col("p.data").alias("content"))
    put = objects.put_objects(cut, root).withColumn("id", F.split("key", "-")[0].cast("long")).withColumn("part", F.split("key", "-")[1].cast("int"))
    parts = put.select("id", "part", "key", F.lit(0).cast("long").alias("offset"), F.col("size").alias("length"), F.lit(False).alias("whole"))
    own = texts.select("id", F.sha2("content", 256).alias("sha256"), F.lit(False).alias("compressed"), F.lit(None).cast("binary").alias("seal"), F.lit("").alias("name"))
    return content.restore_streams(parts.join(own, "id"), root)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'mismatch' ELSE 'ok' END AS verdict FROM documents")
def restore_check(t: Tables) -> DataFrame:
    return _restored(t).select("id", "verdict")


@query("SELECT CASE WHEN doc_id % 11 = 0 THEN 'mismatch' ELSE 'match' END AS verdict, count(*)::BIGINT AS files FROM documents GROUP BY 1")
def verify_deep(t: Tables) -> DataFrame:
    return _restored(t).groupBy(F.when(F.col("verdict") == "ok", "match").otherwise("mismatch").alias("verdict")).agg(F.count(F.lit(1)).alias("files"))


# -- blobs


@query(
    "SELECT doc_id AS id, doc_id % 5 <> 3 OR octet_length(encode(text)) <= 512 AS whole, CASE WHEN doc_id % 5 <> 3 OR octet_length(encode(text)) <= 512 THEN $SHA(text) ELSE '' END AS sha256 FROM documents"
)
def blob_roundtrip(t: Tables) -> DataFrame:
    """Contents sealed in chunks of 512 bytes, streamed into files and opened again from there; of every fifth one the first chunk of
    several is lost on the way.
    """
    root, own = _root(t, "blobs"), F.sha2(F.col("id").cast("string"), 256)
    files = _texts(t).select("id", "content", F.unhex(own).alias("key"), F.unhex(F.substring(own, 1, 8)).alias("prefix"))
    chunks = settle(content.encrypt_blob(files, 512), "chunks")
    several = F.conv(F.hex(F.substring("header", 13, 8)), 16, 10).cast("long") > 512
    kept = chunks.filter(~((F.col("id") % 5 == 3) & (F.col("i") == 0) & several))
    name = F.col("id").cast("string").alias("key")
    heads = chunks.filter("i = 0").select(name, F.lit(-1).alias("i"), F.col("header").alias("data"))
    put = objects.put_streams(heads.unionByName(kept.select(name, "i", F.col("sealed").alias("data"))), root)
    parts = put.select(F.col("key").cast("long").alias("id"), F.lit(0).alias("part"), "key", F.lit(0).cast("long").alias("offset"), F.col("size").alias("length"), F.lit(False).alias("whole"))
    told = files.select("id", F.lit(None).cast("string").alias("sha256"), F.lit(False).alias("compressed"), F.col("key").alias("seal"), F.lit("").alias("name"))
    back = content.restore_streams(parts.join(told, "id"), root)
    return back.select("id", F.col("digest").isNotNull().alias("whole"), F.coalesce("digest", F.lit("")).alias("sha256"))


@query("SELECT doc_id AS id, doc_id % 3 <> 2 AS sealed, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, $SHA(coalesce(text, '')) AS sha256 FROM documents")
def prepare_files(t: Tables) -> DataFrame:
    """Files compressed where it saves, then two of three sealed, from file to file; and read back through both."""
    root, packed_to, sealed_to = _root(t, "files"), _root(t, "packed"), _root(t, "sealed")
    name, own = F.col("id").cast("string"), F.sha2(F.col("id").cast("string"), 256)
    texts = _texts(t)
    objects.put_objects(texts.select(name.alias("key"), "content"), root)
    given = texts.select(name.alias("key"), F.when(F.col("id") % 2 == 1, "txt").otherwise("jpg").alias("extension"), F.when(F.col("id") % 3 != 2, F.unhex(own)).alias("seal"), F.unhex(F.substring(own, 1, 8)).alias("prefix"))
    packed = content.gzip_files(given, root, packed_to).join(given, "key")
    closed = packed.filter("seal is not null")
    from_packed = content.seal_files(closed.filter("compressed"), packed_to, sealed_to, CHUNK)
    sealed = from_packed.unionByName(content.seal_files(closed.filter("not compressed"), root, sealed_to, CHUNK))
    bare = lambda some: packed.filter("seal is null").filter(some).select("key", "size", "compressed", "seal")
    told = sealed.join(packed.select("key", "compressed", "seal"), "key")

    def back(stored: DataFrame, where: str) -> DataFrame:
        parts = stored.select(
            F.col("key").cast("long").alias("id"), F.lit(0).alias("part"), "key", F.lit(0).cast("long").alias("offset"), F.col("size").alias("length"), F.lit(False).alias("whole"),
            F.lit(None).cast("string").alias("sha256"), "compressed", "seal", F.lit("").alias("name"),
        )
        return content.restore_streams(parts, where).select("id", F.lit(where == sealed_to).alias("sealed"), "digest")

    found = back(told, sealed_to).unionByName(back(bare("compressed"), packed_to)).unionByName(back(bare("not compressed"), root))
    sizes = texts.select("id", F.octet_length("content").cast("long").alias("bytes"))
    return found.join(sizes, "id").select("id", "sealed", "bytes", F.col("digest").alias("sha256"))


@query("SELECT doc_id AS id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, $SHA(coalesce(text, '')) AS sha256 FROM documents")
def content_hash_stream(t: Tables) -> DataFrame:
    """Hashes of objects read by ranges, in two pieces each, as contents beyond a cell are."""
    root, texts = _root(t, "objects"), _texts(t)
    put = objects.put_objects(texts.select(F.col("id").cast("string").alias("key"), "content"), root)
    half = F.floor(F.col("size") / 2)
    cut = put.select(F.col("key").cast("long").alias("id"), "key", "size", F.posexplode(F.array(F.struct(F.lit(0).cast("long").alias("offset"), half.alias("length")), F.struct(half.alias("offset"), (F.col("size") - half).alias("length")))).alias("part", "p"))
    parts = cut.select("id", "part", "key", "p.offset", "p.length", F.lit(False).alias("whole"), F.lit(None).cast("string").alias("sha256"), F.lit(False).alias("compressed"), F.lit(None).cast("binary").alias("seal"), F.lit("").alias("name"))
    hashed = content.restore_streams(parts, root).select("id", F.col("digest").alias("sha256"))
    return hashed.join(put.select(F.col("key").cast("long").alias("id"), "size"), "id")


# -- versions of a table


@query("SELECT id, path, size_bytes FROM media_files")
def publish_catalog(t: Tables) -> DataFrame:
    """The catalog published twice, without and with its missing files; a reader gets the last version that is whole."""
    root, files = _root(t, "versions"), t.media_files.select("id", "path", "size_bytes", "is_missing")
    mutations.publish(t.spark, files.filter("not is_missing"), root, "files", 1)
    mutations.publish(t.spark, files, root, "files", 2)
    files.limit(1).write.parquet(f"{root}/files/v=3")  # a writer that stopped before it published
    return mutations.read_current(t.spark, root, "files").select("id", "path", "size_bytes")


@query("SELECT true AS bounded")
def verify_requests(t: Tables) -> DataFrame:
    """Whether the vault's verification reads each archive by three requests at most, five more allowed in all."""
    v = _vault(t)
    ends = ledger.read_ends(v.records, v.links, v.archives, v.root, SAMPLE)
    archives = v.archives.agg(F.count(F.lit(1)).alias("n"))
    return ends.agg(F.sum("requests").alias("requests")).crossJoin(archives).select((F.col("requests") <= 3 * F.col("n") + 5).alias("bounded"))
