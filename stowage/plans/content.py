"""Content queries. Those whose functions no SQL engine has (BLAKE2b, CRC32C, gzip, tar, AES) are checked by tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators import content, ledger
from stowage.plans.registry import query
from stowage.sources.views import Tables


def _files(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))


@query("SELECT doc_id AS key, $SHA(text) AS sha256 FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return content.content_hash(_files(t).withColumnRenamed("id", "key"))


@query()
def fingerprint(t: Tables) -> DataFrame:
    return _files(t).select("id", content.fingerprint("content").alias("fingerprint"))


_CRC_TABLE = "[" + ", ".join(str(x) for x in content._crc_table().tolist()) + "]"
_CRC = f"""
    b AS (SELECT doc_id AS id, octet_length(encode(text)) AS n, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, {_CRC_TABLE}[(xor(a, x) & 255) + 1]::BIGINT)) AS r FROM documents),
    c AS (SELECT id, n, base64(unhex(format('{{:08X}}', xor(r, 4294967295::BIGINT)))) AS crc FROM b)
"""


@query(f"WITH {_CRC} SELECT id, crc AS crc32c FROM c")
def crc32c(t: Tables) -> DataFrame:
    return _files(t).select("id", content.crc32c("content").alias("crc32c"))


@query(f"WITH {_CRC} SELECT id, n::BIGINT AS size, crc AS crc32c FROM c")
def crc32c_pieces(t: Tables) -> DataFrame:
    """The same from pieces of 700 bytes, checksummed apart and put together in no order."""
    size = F.octet_length("content")
    at = F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(700)))
    cut = _files(t).select("id", "content", at.alias("at"))
    pieces = cut.select("id", F.col("at").cast("long").alias("offset"), F.substring("content", F.col("at") + 1, F.lit(700)).alias("data"))
    return content.crc32c_of_pieces(pieces.repartition("offset"))


_PAD = "from_hex(array_to_string([format('{{:02X}}', xor(('0x' || substr(rpad(upper(master_key), 128, '0'), i, 2))::INTEGER, {pad})) for i in generate_series(1, 127, 2)], ''))".replace("{{", "{").replace("}}", "}")


@query(
    "WITH k AS (SELECT id, "
    + _PAD.replace("{pad}", "54")
    + " AS ip, "
    + _PAD.replace("{pad}", "92")
    + """ AS op FROM backup_key_versions)
    SELECT r.id AS record_id, k.id AS key_version_id, sha256(op || from_hex(sha256(ip || encode('content-id:' || r.sha256)))) AS content_id FROM backup_records r, k WHERE r.sha256 IS NOT NULL AND NOT (r.id % 3 = 0 AND k.id = 2)"""
)
def content_ids(t: Tables) -> DataFrame:
    present = t.backup_records.filter("id % 3 = 0").select(
        F.col("id").alias("record_id"), F.lit(2).cast("long").alias("key_version_id")
    )
    return content.content_ids(t.backup_records, t.backup_key_versions, present)


def _sealed(t: Tables) -> DataFrame:
    """Each record's path sealed under a key of its archive location, with its hash as context."""
    keyed = t.backup_records.join(
        F.broadcast(
            t.backup_key_versions.select((F.col("id") - 1).alias("destination_id"), F.unhex("master_key").alias("key"))
        ),
        "destination_id",
    )
    nonce = F.unhex(F.substring(F.md5(F.col("id").cast("string")), 1, 24))
    return keyed.select(
        "id",
        "destination_id",
        "sha256",
        "local_path",
        content.seal(F.col("local_path"), F.col("key"), nonce, F.col("sha256")).alias("token"),
    )


@query("SELECT id, CASE WHEN destination_id = 1 THEN '' ELSE local_path END AS path FROM backup_records")
def open_index(t: Tables) -> DataFrame:
    """What the keys but number 2 open; a wrong key gives nothing."""
    keys = t.backup_key_versions.select(
        (F.col("id") - 1).alias("destination_id"),
        F.when(F.col("id") == 2, F.unhex(F.sha2(F.lit("wrong"), 256))).otherwise(F.unhex("master_key")).alias("key"),
    )
    return _sealed(t).join(F.broadcast(keys), "destination_id").select(
        "id", F.coalesce(content.unseal(F.col("token"), F.col("key"), F.col("sha256")), F.lit("")).alias("path")
    )


def _packed(t: Tables) -> DataFrame:
    files = t.media_files.select("id", "extension").join(_files(t), "id")
    return content.gzip_plan(files)


@query()
def gzip_plan(t: Tables) -> DataFrame:
    return _packed(t).select("id", F.octet_length("stored").alias("stored_size"), "compressed")


@query()
def gzip_ends(t: Tables) -> DataFrame:
    """The trailers of what was compressed, against the contents' own CRC and size."""
    ends = content.gzip_ends(_packed(t)).filter("gzip")
    return ends.join(_files(t), "id").select(
        "id",
        (F.col("crc") == F.crc32("content")).alias("crc_right"),
        (F.col("plain_size") == F.octet_length("content")).alias("size_right"),
    )


@query()
def prepare_plan(t: Tables) -> DataFrame:
    files = t.media_files.select("path", "sha256", "id", "extension")
    once = files.groupBy("sha256").agg(F.min_by(F.struct("id", "extension"), "path").alias("f")).select(
        "sha256", "f.id", "f.extension"
    ).join(_files(t), "id").select(F.col("sha256").alias("id"), "extension", "content")
    return content.prepare_plan(files, content.gzip_plan(once))


@query(
    "SELECT m.path, $SHA('id:' || m.sha256) || '.file' AS member, (n + 20 + greatest((n + 1023) // 1024, 1) * 16)::BIGINT AS stored_size FROM media_files m JOIN (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) d ON d.doc_id = m.id"
)
def prepare_sealed(t: Tables) -> DataFrame:
    """Contents as they are, encrypted once for each hash in chunks of 1024 bytes."""
    files = t.media_files.select("path", "sha256", "id")
    once = files.groupBy("sha256").agg(F.min_by("id", "path").alias("id")).join(_files(t), "id").select(
        F.col("sha256").alias("id"), F.col("content").alias("stored")
    )
    key, prefix = F.unhex(F.sha2(F.lit("key"), 256)), F.unhex(F.substring("id", 1, 8))
    return content.prepare_sealed(files, once, key, prefix, F.sha2(F.concat(F.lit("id:"), "id"), 256), 1024)
