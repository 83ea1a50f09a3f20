"""Operator 4: media columns, typed and carved by signature sniffing.

An Aho-Corasick automaton finds every magic number of a blob in one pass. At each hit the format's validator follows
the structure (chunk lengths, checksums, block chains, header fields) to the medium's true end, so a magic number that
stands in other data by chance is rejected. What is valid corrects the declared type and gives the medium's place; media
inside another medium or behind foreign bytes are carved out.

Defined cases: a null blob has no media; a null declared type is never right; a truncated medium is not valid; media
that
end at the same place are reported outermost first. A null or empty text is stored as 192 blanks with n_bytes 0; a text
of any length is one medium;
null and repeated ids are rows of their own, and equal texts are stored alike. The stored form that op4 tells of is the
medium, which a cell holds behind foreign bytes.
Only the named columns are read, so extra ones can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm import kernels as K
from stowage.llm.common import cut, text_bytes

UNIT = 192
HELD = 4 << 20  # about how many bytes of blobs or texts are held with what is made of them

# -- validators: the end of the medium that starts at `at`, or 0


def _wav_end(b: bytes, at: int) -> int:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end, place, kinds = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    if end > len(b):
        return 0
    while place + 8 <= end:
        kinds.add(b[place : place + 4])
        size = struct.unpack_from("<I", b, place + 4)[0]
        place += 8 + size + (size & 1)
    return end if place == end and {b"fmt ", b"data"} <= kinds else 0


def _png_end(b: bytes, at: int) -> int:
    place, first = at + 8, True
    while place + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, place)
        if place + 12 + size > len(b) or first != (kind == b"IHDR"):
            return 0
        if zlib.crc32(memoryview(b)[place + 4 : place + 8 + size]) != struct.unpack_from(">I", b, place + 8 + size)[0]:
            return 0
        place, first = place + 12 + size, False
        if kind == b"IEND":
            return place
    return 0


def _bmp_end(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    size, reserved, start, header, width, height, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if reserved or header != 40 or planes != 1 or depth not in (1, 4, 8, 24, 32) or packed or width <= 0 or not height:
        return 0
    row = (width * depth + 31) // 32 * 4
    return at + size if size >= start + row * abs(height) and start >= 54 and at + size <= len(b) else 0


def _gif_end(b: bytes, at: int) -> int:
    if len(b) < at + 13:
        return 0
    place = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while place < len(b):
        mark, place = b[place], place + 1
        if mark == 0x3B:
            return place
        if mark == 0x2C:
            if place + 9 >= len(b):
                return 0
            place += 10 + (3 << (b[place + 8] & 7) + 1 if b[place + 8] & 0x80 else 0)
        elif mark == 0x21:
            place += 1
        else:
            return 0
        while place < len(b) and b[place]:
            place += 1 + b[place]
        place += 1
    return 0


def _jpeg_end(b: bytes, at: int) -> int:
    place, scans = at + 2, 0
    while place + 4 <= len(b):
        if b[place] != 0xFF:
            return 0
        mark = b[place + 1]
        if mark == 0xD9:
            return place + 2 if scans else 0
        if mark in (0x00, 0xFF) or 0xD0 <= mark <= 0xD8:
            return 0
        place += 2 + struct.unpack_from(">H", b, place + 2)[0]
        if mark == 0xDA:
            scans += 1
            while (place := b.find(b"\xff", place)) >= 0 and place + 1 < len(b) and (
                b[place + 1] == 0 or 0xD0 <= b[place + 1] <= 0xD7
            ):
                place += 2
            if place < 0:
                return 0
    return place + 2 if scans and b[place : place + 2] == b"\xff\xd9" else 0


#: Fixed values of the formats: type, magic number, validator.
FORMATS: list[tuple[str, bytes, Callable[[bytes, int], int]]] = [
    ("wav", b"RIFF", _wav_end),
    ("png", b"\x89PNG\r\n\x1a\n", _png_end),
    ("bmp", b"BM", _bmp_end),
    ("gif", b"GIF87a", _gif_end),
    ("gif", b"GIF89a", _gif_end),
    ("jpeg", b"\xff\xd8\xff", _jpeg_end),
]
_AUTOMATON: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    if not _AUTOMATON:
        made = ahocorasick.Automaton()
        for k, (_, magic, _) in enumerate(FORMATS):
            made.add_word(magic.decode("latin-1"), k)
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def find_media(blob: bytes) -> list[tuple[int, int, str, int]]:
    """(start, end, type, depth) of each valid medium; depth: in how many other media it lies."""
    found: list[tuple[int, int, str, int]] = []
    inside: list[int] = []
    hits = sorted((last - len(FORMATS[k][1]) + 1, k) for last, k in automaton().iter(blob.decode("latin-1")))
    for at, k in hits:
        end = FORMATS[k][2](blob, at)
        if end:
            inside = [e for e in inside if e > at]
            found.append((at, end, FORMATS[k][0], len(inside)))
            inside.append(end)
    return found


def sniff(df: DataFrame, id_col: str, blob_col: str, declared_col: str) -> DataFrame:
    """id, declared, type, start, length, depth, declared_right, media for each medium found in a blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.parts(K.flat(batch.column(1))[1], HELD):  # media are held for a few rows at a time
                some, row, out = batch.slice(lo, hi - lo), [], []
                for i in range(some.num_rows):
                    blob, declared = some.column(1)[i].as_py(), some.column(2)[i].as_py()
                    for at, end, kind, depth in find_media(blob) if blob else []:
                        row.append(i)
                        out.append((declared, kind, at, end - at, depth, kind == declared, blob[at:end]))
                columns = list(zip(*out)) or [[]] * 7
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    ["id", "declared", "type", "start", "length", "depth", "declared_right", "media"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(
        F.col(id_col).alias("id"), F.col(blob_col).alias("blob"), F.col(declared_col).alias("declared")
    ).mapInArrow(run, f"id {kind}, declared string, type string, start long, length long, depth int, declared_right boolean, media binary")


# -- payloads as 8-bit samples


def encode(payload: bytes, kind: str) -> bytes:
    """The payload (a multiple of 192 bytes) as 8-bit samples: mono sound, or rows of 64 pixels of three samples."""
    rows = len(payload) // UNIT
    if kind == "wav":
        fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 16_000, 16_000, 1, 8)
        return struct.pack(
            "<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE"
        ) + fmt + struct.pack("<4sI", b"data", len(payload)) + payload
    if kind == "bmp":
        return struct.pack(
            "<2sIIIIiiHHIIiiII",
            b"BM",
            54 + len(payload),
            0,
            54,
            40,
            64,
            -rows,
            1,
            24,
            0,
            len(payload),
            2835,
            2835,
            0,
            0,
        ) + payload
    if kind == "png":
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        lines = np.zeros((rows, UNIT + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
        return b"\x89PNG\r\n\x1a\n" + chunk(
            b"IHDR", struct.pack(">IIBBBBB", 64, rows, 8, 2, 0, 0, 0)
        ) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
    raise ValueError(kind)


def decode(media: bytes, kind: str) -> bytes:
    """The samples of a medium that encode() wrote, found by its own headers."""
    if kind == "wav":
        place = 12
        while media[place : place + 4] != b"data":
            size = struct.unpack_from("<I", media, place + 4)[0]
            place += 8 + size + (size & 1)
        return media[place + 8 : place + 8 + struct.unpack_from("<I", media, place + 4)[0]]
    if kind == "bmp":
        start, width, height = struct.unpack_from("<I", media, 10)[0], *struct.unpack_from("<ii", media, 18)
        rows = np.frombuffer(
            media, np.uint8, (width * 3 + 3) // 4 * 4 * abs(height), start
        ).reshape(abs(height), -1)[:, : width * 3]
        return (rows if height < 0 else rows[::-1]).tobytes()
    if kind == "png":
        place, packed, width = 8, [], struct.unpack_from(">I", media, 16)[0]
        while place < len(media):
            size, name = struct.unpack_from(">I4s", media, place)
            if name == b"IDAT":
                packed.append(media[place + 8 : place + 8 + size])
            place += 12 + size
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width * 3 + 1)
        if lines[:, 0].any():
            raise ValueError("filtered lines")
        return lines[:, 1:].tobytes()
    raise ValueError(kind)


def features(samples: bytes, kind: str) -> str:
    """What a training set would index of the samples: level and texture."""
    x = np.frombuffer(samples, np.uint8)
    if kind == "wav":
        crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
        return f"wav;seconds={len(x) / 16_000:.3f};mean={x.mean(dtype=np.float64):.3f};crossings={crossings}"
    image = x.reshape(-1, 64, 3)
    edges = int(np.abs(np.diff(image.astype(np.int16), axis=1)).sum(dtype=np.int64))
    return f"{kind};64x{len(image)};rgb=" + ",".join(
        f"{m:.3f}" for m in image.mean(axis=(0, 1), dtype=np.float64)
    ) + f";edges={edges}"


def _stored(payload: bytes) -> tuple[str, bytes]:
    """The declared type and the cell of a payload; both follow from its bytes, so equal texts are stored alike.

    A third of the cells declare a type that is wrong, and media stand behind up to 63 foreign bytes.
    """
    seed = hashlib.sha256(payload).digest()
    kind = ("wav", "png", "bmp")[seed[0] % 3]
    return (kind, "wav", "png")[seed[1] % 3], seed[3:4] * (seed[2] % 64) + encode(payload, kind)


def store_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_bytes, declared, cell: each text as a medium in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in K.parts(K.flat(batch.column(1))[1], HELD):
                some = batch.slice(lo, hi - lo)
                n, declared, cells = [], [], []
                for text in some.column(1).to_pylist():
                    kind, cell = _stored(text + b" " * (-len(text) % UNIT if text else UNIT))
                    n.append(len(text)), declared.append(kind), cells.append(cell)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(n, pa.int64()), pa.array(declared), pa.array(cells, pa.binary())],
                    ["id", "n_bytes", "declared", "cell"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(
        F.col(id_col).alias("id"), text_bytes(text_col).alias("text")
    ).mapInArrow(run, f"id {kind}, n_bytes long, declared string, cell binary")


def read_back(stored: DataFrame, id_col: str) -> DataFrame:
    """What op4 asks for, from the carved media of the written table `stored`."""
    plain = stored.select(F.struct("id", "n_bytes").alias("id"), "cell", "declared")
    media = sniff(plain, "id", "cell", "declared").filter("depth = 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, medium in zip(batch.column(1).to_pylist(), batch.column(2)):
                medium = medium.as_py()
                payload = decode(medium, kind)
                out.append(
                    (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-16:]),
                        len(medium),
                        hashlib.sha256(medium).hexdigest(),
                        features(payload, kind),
                    )
                )
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            ident = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    ident.field(0),
                    ident.field(1),
                    *(pa.array(c, k) for c, k in zip(columns, kinds)),
                    batch.column(1),
                    batch.column(3),
                ],
                [
                    id_col,
                    "n_bytes",
                    "payload_bytes",
                    "payload_sha256",
                    "tail_crc32",
                    "media_bytes",
                    "media_sha256",
                    "feature",
                    "media_type",
                    "declared_right",
                ],
            )

    kind = stored.schema["id"].dataType.simpleString()
    return media.select("id", "type", "media", "declared_right").mapInArrow(
        run,
        f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, declared_right boolean",
    )


def texts_as_media(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return read_back(cut(store_texts(df, id_col, text_col), "media"), id_col)
