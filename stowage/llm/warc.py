"""Operator 7: WARC archives, and a normaliser of monolithic gzip.

write_archives() puts pages in WARC records; an archive is one gzip stream over the whole file, as naive writers make
them, and one
cell of a table (archives stay under a byte limit, so a cell is bounded). normalise() inflates such a stream once
(whatever members it has: one, or several
one after another), rewrites each record as a gzip member of its own, and makes the sidecar index: where each member
lies. read_records() reads through the index, so that
single records can be had without inflating the rest. export_files() writes archives and indexes as files.

Of pages with equal payloads of at least `least` bytes the one with the largest id is the response and the others are
revisits of it,
which hold no payload: their HTTP headers tell its length.

Defined cases: a null payload is empty; a null id is never the response others refer to, unless all ids are null (then
all are responses);
of rows with one id and payload, one after the other, each is a response, as none has a larger id; a null url is
written as
`urn:none`; ids may be of any type that casts to text and back; a payload of any length is one record, of which an
archive holds at least one; header bytes
that aren't UTF-8 are read as Latin-1; a stream that is cut off is an error. Only id, url and payload are read, so
extra columns can't clash. An empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut, text_bytes

BROADCAST_ROWS = 100_000  # of a digest and an id
ARCHIVE_BYTES = 4 << 20
WHEN = "2024-01-01T00:00:00Z"


def with_roles(pages: DataFrame, id_col: str, url_col: str, body_col: str, least: int) -> DataFrame:
    """id, url, payload, digest, refers_to (null for responses)."""
    base = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_bytes(body_col).alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    many = base.filter(F.length("payload") >= least).groupBy("digest").agg(
        F.max("id").alias("response"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1 and response is not null").select(F.col("digest").alias("shared"), "response")
    many = cut(many, "shared-payloads")
    small = many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = base.join(F.broadcast(many) if small else many, F.col("digest") == F.col("shared"), "left")
    return joined.select(
        "id",
        "url",
        "payload",
        "digest",
        F.when(
            F.coalesce(F.col("id") != F.col("response"), F.col("response").isNotNull()), F.col("response")
        ).alias("refers_to"),
    )


def _name(ident: object) -> str:
    return "none" if ident is None else "id-" + quote(str(ident), safe="")


def record(ident: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.0 record of an HTTP response, or a revisit of one by an identical payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{ident}>",
        f"WARC-Date: {WHEN}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The headers and block of the record that starts at `at`, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    try:
        lines = data[at:end].decode().split("\r\n")
    except UnicodeDecodeError:
        lines = data[at:end].decode("latin-1").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    start, size = end + 4, int(headers["content-length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, data[start : start + size], start + size + 4


def inflate(stream: bytes) -> bytes:
    """All members of a gzip stream, one after another; zero bytes may fill its end."""
    out = []
    while stream.strip(b"\0"):
        member = zlib.decompressobj(31)
        out.append(member.decompress(stream))
        if not member.eof:
            raise ValueError("a gzip stream is cut off")
        stream = member.unused_data
    return b"".join(out)


def write_archives(roles: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive (its name), stream: one gzip stream for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, out, size, name = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0, hashlib.sha1()

        def row() -> pa.RecordBatch:
            out.append(squeeze.flush())
            return pa.RecordBatch.from_arrays(
                [pa.array([name.hexdigest()]), pa.array([b"".join(out)], pa.binary())], ["archive", "stream"]
            )

        for batch in batches:
            ids, urls, digests, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for ident, url, body, digest, ref in zip(ids, urls, batch.column(2), digests, refers):
                place = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
                made = record(_name(ident), place, body.as_py(), digest, None if ref is None else _name(ref))
                out.append(squeeze.compress(made))
                name.update(made[:400])
                size += len(made)
                if size >= archive_bytes:
                    yield row()
                    squeeze, out, size, name = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0, hashlib.sha1()
        if size:
            yield row()

    return roles.select(
        F.col("id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string")
    ).mapInArrow(run, "archive string, stream binary")


def normalise(archives: DataFrame) -> DataFrame:
    """archive, members (one gzip member for each record, one after another), index: array of (offset, length,
    record_id, type).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, members, index, at, place = inflate(batch.column(1)[i].as_py()), [], [], 0, 0
                while at < len(data):
                    headers, _, after = parse(data, at)
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = squeeze.compress(data[at:after]) + squeeze.flush()
                    members.append(member)
                    index.append(
                        {
                            "offset": place,
                            "length": len(member),
                            "record_id": headers["warc-record-id"],
                            "type": headers["warc-type"],
                        }
                    )
                    place, at = place + len(member), after
                kind = pa.list_(
                    pa.struct(
                        [
                            ("offset", pa.int64()),
                            ("length", pa.int64()),
                            ("record_id", pa.string()),
                            ("type", pa.string()),
                        ]
                    )
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([b"".join(members)], pa.binary()), pa.array([index], kind)],
                    ["archive", "members", "index"],
                )

    return archives.mapInArrow(
        run, "archive string, members binary, index array<struct<offset:long,length:long,record_id:string,type:string>>"
    )


def read_records(normalised: DataFrame) -> DataFrame:
    """archive, record_id, record_type, url, payload_bytes, payload_digest, refers_to of each record, each inflated at
    its index entry.

    The digest of a response is computed from the payload that was read; it must be the one in its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, rows = batch.column(1)[i].as_py(), []
                for entry in batch.column(2)[i].as_py():
                    headers, block, _ = parse(
                        zlib.decompress(data[entry["offset"] : entry["offset"] + entry["length"]], 31)
                    )
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(
                        next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    )
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if headers["warc-type"] == "response" and (
                        hashlib.sha1(payload).hexdigest() != digest or len(payload) != size
                    ):
                        raise ValueError(f"the payload of {headers['warc-record-id']} isn't what was written")
                    rows.append(
                        (
                            headers["warc-record-id"],
                            headers["warc-type"],
                            headers["warc-target-uri"],
                            size,
                            digest,
                            headers.get("warc-refers-to"),
                        )
                    )
                columns = list(zip(*rows)) or [[]] * 6
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * len(rows), pa.string()),
                        *(pa.array(c, k) for c, k in zip(columns, kinds)),
                    ],
                    ["archive", "record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to"],
                )

    return normalised.mapInArrow(
        run,
        "archive string, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string",
    )


def page_id(column: str, kind: str) -> Column:
    """The id in <urn:page:id-...>, null for `none`."""
    found = F.regexp_extract(column, "^<urn:page:id-(.*)>$", 1)
    return F.when(F.rlike(column, F.lit("^<urn:page:id-")), F.url_decode(found).try_cast(kind))


def archive_pages(pages: DataFrame, id_col: str, url_col: str, body_col: str, least: int = 1000) -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to as the archives have them after normalising."""
    archives = cut(write_archives(with_roles(pages, id_col, url_col, body_col, least)), "archives")
    records = read_records(cut(normalise(archives), "normalised"))
    kind = pages.schema[id_col].dataType.simpleString()
    return records.select(
        page_id("record_id", kind).alias(id_col),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_id("refers_to", kind).alias("refers_to"),
    )


def export_files(normalised: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as <folder>/<archive>-<n>.warc.gz with an .idx of that name beside it; n is the row's number, so archives
    of equal records are files of their own. folder: a URI that all executors can write to; normalised: a written table, whose rows keep
    their numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths = []
            for i in range(batch.num_rows):
                name = f"{batch.column(0)[i].as_py()}-{batch.column('n')[i].as_py()}"
                lines = "".join(
                    f"{e['record_id']} {e['type']} {e['offset']} {e['length']}\n" for e in batch.column(2)[i].as_py()
                )
                for path, data in (
                    (f"{base}/{name}.warc.gz", batch.column(1)[i].as_py()), (f"{base}/{name}.idx", lines.encode())
                ):
                    with store.open_output_stream(path) as out:
                        out.write(data)
                paths.append(f"{base}/{name}.warc.gz")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["archive", "path"])

    return normalised.withColumn("n", F.monotonically_increasing_id()).mapInArrow(run, "archive string, path string")
