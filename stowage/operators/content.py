"""Jobs over file contents: hashes, fingerprints, keyed ids, sealing, compression, archives, restoring.

Contents come as a table (key, content) or from binaryFile; filter by metadata first, so that only files that are
needed are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from stowage.functions import scalars
from stowage.operators.ordered import running
from stowage.session import settle
from stowage.sources import objects

SAMPLE = 1 << 20
MIN_SAVING = 0.05
#: Extensions whose files are compressed already.
COMPRESSED = (
    "mp4", "m4v", "mkv", "avi", "mov", "wmv", "flv", "webm", "mpg", "mpeg", "ts", "m2ts", "vob", "3gp", "jpg", "jpeg",
    "png", "gif", "webp", "heic", "heif", "avif", "jp2", "mp3", "m4a", "aac", "ogg", "opus", "flac", "wma", "zip",
    "gz", "tgz", "bz2", "xz", "zst", "7z", "rar", "lz4", "docx", "xlsx", "pptx", "odt", "ods", "odp", "epub", "jar",
    "apk",
)


def content_hash(files: DataFrame) -> DataFrame:
    return files.select("key", F.sha2("content", 256).alias("sha256"))


@F.pandas_udf(StringType())
def _blake2b(head: pd.Series, tail: pd.Series) -> pd.Series:
    digests = [None if a is None else hashlib.blake2b(bytes(a) + bytes(b), digest_size=32).hexdigest() for a, b in zip(head, tail)]
    return pd.Series(digests)


def fingerprint(content: str) -> Column:
    """BLAKE2b-256 over the size as text, the first MiB, and the last MiB that isn't in the first.

    The two ends are cut out by Spark, so at most 2 MiB of a content go to a Python worker, whatever its size.
    """
    size = F.octet_length(content)
    from_ = F.greatest(size - SAMPLE, F.lit(SAMPLE)) + 1
    head = F.concat(size.cast("string").cast("binary"), F.substring(F.col(content), F.lit(1), F.lit(SAMPLE)))
    return _blake2b(head, F.substring(F.col(content), from_, F.lit(SAMPLE)))


CASTAGNOLI = 0x82F63B78  # a fixed value: the polynomial of CRC32C, its bits reversed
LANE = 1024


def _crc_table() -> np.ndarray:
    """What a byte does to a CRC, for each byte."""
    n = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        n = np.where(n & 1, n >> 1 ^ CASTAGNOLI, n >> 1).astype(np.uint32)
    return n


def _zeros_operator(length: int) -> np.ndarray:
    """What `length` zero bytes do to a CRC, as a table for each of its four bytes: a linear map, so it is squared and
    multiplied like a power.
    """
    table = _crc_table()
    units = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    power = np.stack([table[u & 0xFF] ^ (u >> 8) for u in units])
    total = units
    while length:
        if length & 1:
            total = np.stack([_mapped(power, t) for t in total])
        power = np.stack([_mapped(power, p) for p in power])
        length >>= 1
    return total


def _mapped(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 0xFF] ^ tables[1][x >> 8 & 0xFF] ^ tables[2][x >> 16 & 0xFF] ^ tables[3][x >> 24]


def _registers(content: pd.Series, start: int) -> np.ndarray:
    """The CRC register after each content, from a start; that start for null.

    Contents are cut into lanes of LANE bytes from their ends; all lanes of all rows advance together, a byte a step, and a
    row's lanes are then joined from left to right by the map that LANE zero bytes are.
    """
    table, shift = _crc_table(), _zeros_operator(LANE)
    sizes = np.array([0 if c is None else len(c) for c in content], np.int64)
    if not len(sizes):
        return np.zeros(0, np.uint32)
    lanes = np.maximum(1, -(-sizes // LANE))
    first = np.cumsum(lanes) - lanes
    block = np.zeros((int(lanes.sum()), LANE), np.uint8)
    for k, c in enumerate(content):
        if sizes[k]:
            block[first[k] : first[k] + lanes[k]].reshape(-1)[int(lanes[k]) * LANE - int(sizes[k]) :] = np.frombuffer(c, np.uint8)
    crc = np.zeros(len(block), np.uint32)
    skip = lanes * LANE - sizes  # a row's first lane is short: it starts where its bytes do
    fresh = np.argsort(skip, kind="stable")
    begun = np.sort(skip, kind="stable")
    by_step = np.ascontiguousarray(block.T)
    for at in range(LANE):
        lo, hi = np.searchsorted(begun, [at, at + 1])
        crc[first[fresh[lo:hi]]] = start
        crc = table[(crc ^ by_step[at]) & 0xFF] ^ (crc >> np.uint32(8))
        crc[first[fresh[hi:]]] = 0
    crc[first[sizes == 0]] = start
    total = crc[first]
    for step in range(1, int(lanes.max(initial=1))):
        live = np.flatnonzero(lanes > step)
        total[live] = _mapped(shift, total[live]) ^ crc[first[live] + step]
    return total


@F.pandas_udf(StringType())
def crc32c(content: pd.Series) -> pd.Series:
    """Base64 of the big-endian CRC32C (Castagnoli), as object stores report it."""
    told = _registers(content, 0xFFFFFFFF) ^ np.uint32(0xFFFFFFFF)
    return pd.Series([None if c is None else base64.b64encode(int(x).to_bytes(4, "big")).decode() for c, x in zip(content, told)])


def content_ids(records: DataFrame, keys: DataFrame, present: DataFrame, label: str = "content-id:") -> DataFrame:
    """Keyed ids of all records for all key versions that don't have one yet; running it again adds nothing. keys is a
    short list by nature.
    """
    inner, outer = scalars.hmac_pads(F.unhex("master_key"))
    padded = keys.select(F.col("id").alias("key_version_id"), inner.alias("inner"), outer.alias("outer"))
    pairs = records.filter("sha256 is not null").select(
        F.col("id").alias("record_id"), "sha256"
    ).crossJoin(F.broadcast(padded))
    missing = pairs.join(present.select("record_id", "key_version_id"), ["record_id", "key_version_id"], "left_anti")
    return missing.select(
        "record_id",
        "key_version_id",
        scalars.hmac_with_pads(F.col("inner"), F.col("outer"), F.concat(F.lit(label), "sha256")).alias("content_id"),
    )


def seal(plain: Column, key: Column, nonce: Column, context: Column) -> Column:
    """Base64 of nonce, AES-256-GCM ciphertext and tag; context is authenticated too."""
    return F.base64(
        F.aes_encrypt(plain.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce, context.cast("binary"))
    )


def unseal(token: Column, key: Column, context: Column) -> Column:
    """The text, or null for a wrong key, context or token."""
    return F.try_aes_decrypt(
        F.try_to_binary(token, F.lit("base64")), key, F.lit("GCM"), F.lit("DEFAULT"), context.cast("binary")
    ).cast("string")


MAGIC = b"SBE1"


def encrypt_blob(files: DataFrame, chunk: int, magic: bytes = MAGIC) -> DataFrame:
    """files (id, content, key, prefix: 4 bytes) in chunks: id, header, i, sealed. The header (magic, nonce prefix,
    chunk size, plain size) authenticates each chunk.
    """
    size = F.octet_length("content")
    number = lambda n, width: F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))
    header = F.concat(F.lit(magic), "prefix", number(F.lit(chunk), 4), number(size, 8))
    last = F.greatest(F.floor((size - 1) / chunk), F.lit(0)).cast("int")
    each = files.withColumn("header", header).withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    piece = F.substring("content", F.col("i") * chunk + 1, F.lit(chunk))
    nonce = F.concat("prefix", number(F.col("i"), 8))
    sealed = F.aes_encrypt(piece, F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), nonce, F.col("header"))
    return each.select(
        "id", "header", "key", "i", F.substring(sealed, F.lit(13), F.octet_length(sealed)).alias("sealed")
    )


def gzip_plan(files: DataFrame) -> DataFrame:
    """id, extension, content -> id, stored (bytes), compressed: gzip where it saves 5 % or more.

    Contents whose extension says that they are compressed already stay in Spark; only the others go to Python workers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for ident, data in frame[["id", "content"]].itertuples(index=False):
                data = bytes(data)
                middle = len(data) // 2
                sample = data[:SAMPLE] + (data[middle : middle + SAMPLE] if len(data) > 4 * SAMPLE else b"")
                stored = data
                if data and len(zlib.compress(sample, 6)) <= len(sample) * (1 - MIN_SAVING):
                    packed = gzip.compress(data, 6, mtime=0)
                    stored = packed if len(packed) <= len(data) * (1 - MIN_SAVING) else data
                out.append((ident, stored, stored is not data))
            yield pd.DataFrame(out, columns=["id", "stored", "compressed"])

    gated = F.coalesce(F.col("extension").isin(*COMPRESSED), F.lit(False))
    kind = files.schema["id"].dataType.simpleString()
    tried = files.filter(~gated).select("id", "content").mapInPandas(
        run, f"id {kind}, stored binary, compressed boolean"
    )
    return tried.unionByName(
        files.filter(gated).select("id", F.col("content").alias("stored"), F.lit(False).alias("compressed"))
    )


def gzip_ends(stored: DataFrame) -> DataFrame:
    """Whether stored bytes have a gzip frame, and the CRC and size that its trailer tells."""
    at = F.octet_length("stored")
    word = lambda start: F.conv(F.concat(*[F.hex(F.substring(F.col("stored"), start + k, F.lit(1))) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    is_gzip = (at >= 18) & (F.hex(F.substring("stored", 1, 2)) == "1F8B")
    return stored.select(
        "id",
        is_gzip.alias("gzip"),
        F.when(is_gzip, word(at - 7)).alias("crc"),
        F.when(is_gzip, word(at - 3)).alias("plain_size"),
    )


def prepare_plan(files: DataFrame, packed: DataFrame) -> DataFrame:
    """Each path with the stored form of its content, which is made once for each hash. files: path, sha256; packed: id
    (the hash), stored, compressed.
    """
    return files.join(packed.select(F.col("id").alias("sha256"), "stored", "compressed"), "sha256").select(
        "path",
        F.concat("sha256", F.when(F.col("compressed"), ".gz").otherwise(".file")).alias("member"),
        F.octet_length("stored").alias("stored_size"),
        "compressed",
    )


def prepare_sealed(
    files: DataFrame, packed: DataFrame, key: Column, prefix: Column, content_id: Column, chunk: int
) -> DataFrame:
    """prepare_plan for an encrypted archive: each content is encrypted once, and its member is named by its content id.

    files: path, sha256; packed: id (the hash), stored (after gzip_plan, or as it is). key, prefix (4 random bytes,
    never two contents of one key alike) and content_id
    are columns of packed's id. The size is that of what was sealed, header included.
    """
    keyed = packed.select("id", F.col("stored").alias("content"), key.alias("key"), prefix.alias("prefix"))
    sealed = encrypt_blob(keyed, chunk).groupBy("id", "header").agg(F.sum(F.octet_length("sealed")).alias("body"))
    made = sealed.select(
        F.col("id").alias("sha256"),
        F.concat(content_id, F.lit(".file")).alias("member"),
        (F.col("body") + F.octet_length("header")).alias("stored_size"),
    )
    return files.join(made, "sha256").select("path", "member", "stored_size")


def deal_to_archives(members: DataFrame, group: str, order: str, archive_bytes: int) -> DataFrame:
    """members with `archive`: the group's name and a number, from running sums of n_bytes in the order. An archive
    holds less than archive_bytes and
    one more member, whatever a group's size. Only narrow columns go through it; contents are joined afterwards."""
    placed = running(members, group, [order], "n_bytes")
    number = F.floor((F.col("to") - F.col("n_bytes")) / archive_bytes).cast("string")
    return placed.select(*members.columns, F.concat_ws("-", group, number).alias("archive"))


def gzip_files(files: DataFrame, root: str, target: str) -> DataFrame:
    """key, size, compressed of files (key, extension) below the root, each compressed into a file of its key below the target where that saves
    5 % or more; what isn't compressed stays where it is, and size is then its own.

    gzip_plan for contents of any size: the first and the middle MiB say whether it is worth trying, then blocks go through the
    compressor from file to file.
    """
    schema = pa.schema([("key", pa.string()), ("size", pa.int64()), ("compressed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, base), (to, place) = fs.FileSystem.from_uri(root), fs.FileSystem.from_uri(target)
        for batch in batches:
            done = []
            for key, gated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{base}/{key}") as file:
                    size = file.size()
                    packed = None if gated else _gzip_file(file, size, to, f"{place}/{key}")
                done.append((key, size if packed is None else packed, packed is not None))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    gated = F.coalesce(F.col("extension").isin(*COMPRESSED), F.lit(False))
    return settle(files.select("key", gated.alias("gated")).mapInArrow(run, "key string, size long, compressed boolean"), "packed")


def _gzip_file(file, size: int, store: fs.FileSystem, path: str) -> int | None:
    """The size of what a file was compressed to; None where that isn't worth it, and nothing is left then."""
    sample = file.read_at(min(SAMPLE, size), 0) + (file.read_at(SAMPLE, size // 2) if size > 4 * SAMPLE else b"")
    if not size or len(zlib.compress(sample, 6)) > len(sample) * (1 - MIN_SAVING):
        return None
    packer, out = zlib.compressobj(6, zlib.DEFLATED, 31), objects.Writing(store, path)
    for lo in range(0, size, objects.BLOCK):
        out.write(packer.compress(file.read_at(min(objects.BLOCK, size - lo), lo)))
    out.write(packer.flush())
    if out.at > size * (1 - MIN_SAVING):
        out.undo()
        return None
    out.done()
    return out.at


def seal_files(files: DataFrame, root: str, target: str, chunk: int, magic: bytes = MAGIC) -> DataFrame:
    """key, size of files (key, size, seal: their key, prefix) below the root, sealed into files of the same keys below the target.

    encrypt_blob for contents of any size: each file's chunks are read by ranges, sealed by Spark and streamed into its blob in one
    pass, without a shuffle of what was read.
    """
    number = lambda n, width: F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))
    header = F.concat(F.lit(magic), "prefix", number(F.lit(chunk), 4), number(F.col("size"), 8))
    last = F.greatest(F.floor((F.col("size") - 1) / chunk), F.lit(0))
    each = files.select("key", "size", "seal", "prefix", header.alias("header"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    ranges = each.withColumn("offset", F.col("i") * chunk).withColumn("length", F.least(F.lit(chunk), F.col("size") - F.col("i") * chunk))
    read = objects.read_ranges(ranges.drop("size"), root)
    sealed = F.aes_encrypt(F.col("data"), F.col("seal"), F.lit("GCM"), F.lit("DEFAULT"), F.concat("prefix", number(F.col("i"), 8)), F.col("header"))
    body = F.substring(sealed, F.lit(13), F.octet_length(sealed))
    pieces = read.select("key", "i", F.when(F.col("i") == 0, F.concat("header", body)).otherwise(body).alias("data"))
    return objects.put_streams(pieces, target, in_order=True)


def prepare(files: DataFrame, chunk: int) -> DataFrame:
    """The stored form of contents: compressed where that saves 5 %, then sealed where a key is given.

    files: id, extension, content, key and prefix (of the seal; null: none). Returns id, stored, compressed, sealed. Each content
    goes through both steps by itself; a sealed one's chunks are put together again in their order.
    """
    kept = files.select("id", F.col("key"), "prefix")
    packed = gzip_plan(files.select("id", "extension", "content")).join(kept, "id")
    open_, closed = packed.filter("key is null"), packed.filter("key is not null")
    chunks = encrypt_blob(closed.select("id", F.col("stored").alias("content"), "key", "prefix"), chunk)
    blobs = chunks.groupBy("id").agg(
        F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("i", "sealed"))).alias("c")
    ).select("id", F.concat("header", F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["sealed"])), ""))).alias("stored"))
    sealed = closed.select("id", "compressed").join(blobs, "id").select("id", "stored", "compressed", F.lit(True).alias("sealed"))
    return open_.select("id", "stored", "compressed", F.lit(False).alias("sealed")).unionByName(sealed)


def opened(streams: DataFrame) -> DataFrame:
    """The rows of read_streams with `plain`, their bytes without the seal, null where they don't open. streams also have `key`."""
    nonce = F.concat(F.substring("head", 5, 4), F.unhex(F.lpad(F.hex(F.col("i")), 16, "0")))
    chunk = F.try_aes_decrypt(F.concat(nonce, "data"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("head"))
    return streams.withColumn("plain", F.when(F.col("key").isNull(), F.col("data")).otherwise(chunk)).drop("data", "key")


class _Inflate:
    """Gzip members of a stream, a block at a time."""

    def __init__(self) -> None:
        self.member, self.ended = zlib.decompressobj(31), False

    def take(self, data: bytes) -> Iterator[bytes]:
        while data:
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            yield self.member.decompress(data, objects.BLOCK)
            data = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        while not self.member.eof and (more := self.member.decompress(b"", objects.BLOCK)):
            yield more

    def whole(self) -> bool:
        return self.member.eof


class _Checked:
    """One id's bytes on their way: hashed, and written under a name of their own if there is a target."""

    def __init__(self, compressed: bool, sha256: str | None, target) -> None:
        self.inflate, self.sha, self.wanted, self.bytes = _Inflate() if compressed else None, hashlib.sha256(), sha256, 0
        self.plain_size, self.opened, self.next, self.missing, self.broken, self.file = None, 0, 0, False, False, target

    def take(self, i: int, head: bytes, plain: bytes | None, gone: bool) -> None:
        self.missing = self.missing or gone
        self.broken = self.broken or plain is None or i != self.next or bool(head) and head[:4] != MAGIC
        self.next += 1
        if head:
            self.plain_size = int.from_bytes(head[12:20], "big")
        if self.broken:
            return
        self.opened += len(plain)
        try:
            for data in self.inflate.take(plain) if self.inflate else (plain,):
                self.sha.update(data)
                self.bytes += len(data)
                if self.file:
                    self.file.write(data)
        except zlib.error:
            self.broken = True

    def verdict(self) -> str:
        if self.missing:
            return "missing"
        whole = (self.plain_size in (None, self.opened)) and (self.inflate is None or self.inflate.whole())
        self.broken = self.broken or not whole
        return "ok" if not self.broken and self.sha.hexdigest() == self.wanted else "mismatch"

    def digest(self) -> str | None:
        """The hash of all bytes, after verdict(); null where they don't decode."""
        return None if self.missing or self.broken else self.sha.hexdigest()


def restore_streams(parts: DataFrame, root: str, target: str | None = None) -> DataFrame:
    """id, verdict (ok, mismatch or missing), bytes and digest of what is stored in parts below the root, decoded and hashed as a
    stream; with a target, what is ok is written there, a file named by `name`. The digest, a SHA-256, is there for all that decodes,
    so without an expected hash this is how contents beyond a cell are hashed.

    parts: id, part, key, offset, length, whole (see objects.read_streams), and of each id sha256, compressed, seal (the
    key, null: none) and name. Bytes go through in order: read by ranges, opened by Spark chunk by chunk, then inflated and hashed.
    Nothing is shuffled after the parts were sorted, so no object, of any size or number of parts, is ever whole.
    """
    given = parts.withColumn("sealed", F.col("seal").isNotNull()).withColumnRenamed("seal", "key_bytes")
    streams = objects.read_streams(given, root).withColumnRenamed("key_bytes", "key")
    rows = opened(streams.withColumn("gone", F.col("data").isNull())).select("id", "i", "head", "plain", "gone", "sha256", "compressed", "name")
    kind = parts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(target) if target else (None, "")
        now, state, done, schema = None, None, [], None
        for batch in batches:
            schema = pa.schema([batch.schema.field("id"), ("verdict", pa.string()), ("bytes", pa.int64()), ("digest", pa.string())])
            for k in range(batch.num_rows):  # a block at a time, not the batch's all at once
                ident, i, head, plain, gone, sha256, compressed, name = (batch.column(c)[k].as_py() for c in range(8))
                if state is None or ident != now:
                    if state:
                        done.append(_closed(now, state))
                    file = objects.Writing(store, f"{base}/{name}") if target else None
                    now, state = ident, _Checked(bool(compressed), sha256, file)
                state.take(i, head, plain, gone)
            if len(done) > 1000:
                yield _rows(done, schema)
                done = []
        if state:
            done.append(_closed(now, state))
        if done:
            yield _rows(done, schema)

    def _closed(ident, state: _Checked) -> tuple:
        verdict = state.verdict()
        if state.file:
            state.file.done() if verdict == "ok" else state.file.undo()
        return ident, verdict, state.bytes if verdict == "ok" else 0, state.digest()

    def _rows(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return rows.mapInArrow(run, f"id {kind}, verdict string, bytes long, digest string")


def crc32c_of_pieces(pieces: DataFrame) -> DataFrame:
    """id, size, crc32c (as object stores report it) of contents given in pieces: id, offset, data, in any order and cutting.

    A checksum is linear: the whole's is the exclusive or of its pieces', each moved by the zero bytes after it, and of what the
    register's first ones become. So pieces are summed up where they are, in any number of tasks, and 12 bytes each are
    shuffled. Pieces that leave gaps or overlap give null.
    """
    size = F.octet_length("data").cast("long")
    ends = pieces.groupBy("id").agg(F.max(F.col("offset") + size).alias("size"), F.sum(size).alias("covered"))
    each = pieces.select("id", "offset", size.alias("n"), crc_register("data").alias("register"))
    joined = each.join(ends, "id")
    moved = joined.select("id", "size", "covered", crc_moved(F.col("register"), F.col("size") - F.col("offset") - F.col("n")).alias("x"))
    summed = moved.groupBy("id", "size", "covered").agg(F.bit_xor("x").alias("x"))
    whole = F.col("x").bitwiseXOR(crc_moved(F.lit((1 << 32) - 1).cast("long"), F.col("size"))).bitwiseXOR(F.lit((1 << 32) - 1).cast("long"))
    told = F.base64(F.unhex(F.lpad(F.hex(whole), 8, "0")))
    return summed.select("id", "size", F.when(F.col("size") == F.col("covered"), told).alias("crc32c"))


@F.pandas_udf(LongType())
def crc_register(data: pd.Series) -> pd.Series:
    """The register that starts at 0 after the bytes of each row; null for null."""
    return pd.Series([None if c is None else int(r) for c, r in zip(data, _registers(data, 0))], dtype="Int64")


@F.pandas_udf(LongType())
def crc_moved(register: pd.Series, zeros: pd.Series) -> pd.Series:
    """What a register becomes by so many zero bytes: a power of one linear map, taken bit by bit of the number for all rows."""
    x, n = register.to_numpy(np.int64).astype(np.uint32), zeros.to_numpy(np.int64).copy()
    power = _zeros_operator(1)
    while n.any():
        odd = (n & 1).astype(bool)
        x[odd] = _mapped(power, x[odd])
        n >>= 1
        power = np.stack([_mapped(power, p) for p in power])
    return pd.Series(x.astype(np.int64))
