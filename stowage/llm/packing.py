"""Operator 3: best-fit packing with certified bin counts.

1. Texts become token ids and an end id; only longer documents are cut, and only the first piece of one is shorter
   than the capacity.
2. Pieces are dealt by hash to groups of bounded size. Each group packs by best-fit decreasing.
3. Dual-feasible functions give each group a lower bound on its bins. A group that meets it is done: no packing is
   better.
4. Bins that are full are done too. The other bins of groups with a gap go, whole, to new groups, which pack what
   they got anew and keep the result only if it has fewer bins. Rounds go on until all groups meet their bounds or a
   round saves less than `least_gain` of the bins it looked at.

No group is larger than `group_rows` on average, so no task grows with the table. A piece is in one place only, and
rounds move bins, never drop them. Defined cases: a null or empty text is the end id alone; a null id and repeated
ids are kept as rows of their own, dealt by row and not by what is in it; a text of any length is encoded whole, long runs
of blanks too; pieces of equal length are interchangeable; only id and text are read, so extra columns can't clash; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut, text_bytes

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def encoder(ranks_file: bytes, end_of_text: str = "<|endoftext|>") -> tiktoken.Encoding:
    """The byte-level BPE of a rank file; the id after the last rank is the end-of-text mark, which a text may hold."""
    key = hashlib.md5(ranks_file).hexdigest()
    if key not in _ENCODERS:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding(
            key, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={end_of_text: len(ranks)}
        )
    return _ENCODERS[key]


#: Blanks as the pattern's \s has them, and how many in a row are taken out of the text before the pattern sees it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{BLANKS}]{{{10_000},}}")


def token_ids(encode: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of a text. Of a long run of blanks the pattern's engine would keep a way back for each; by its rule such a run
    is one piece but for its last blank, which goes with the word after it, and whole at the end of the text or before a mark.
    """
    out, at = [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end()
        if end < len(text) and not text.startswith(tuple(encode.special_tokens_set), end):
            end -= 1
        out.append(encode.encode_to_numpy(text[at : run.start()], allowed_special="all"))
        out.append(np.array(_blanks(encode, text[run.start() : end]), np.uint32))
        at = end
    out.append(encode.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(out)


def _blanks(encode: tiktoken.Encoding, run: str) -> list[int]:
    return encode._encode_single_piece(run)


def pieces(
    df: DataFrame,
    id_col: str,
    text_col: str,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the pieces of each document.

    vocabulary: a rank file on the driver; its bytes go to the executors.
    """
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = np.append(token_ids(encode, text.as_py().decode("utf-8", "replace")), end_id).astype("<u4")
                head = len(tokens) % capacity
                for k, lo in enumerate(([0] if head else []) + list(range(head, len(tokens), capacity))):
                    part = tokens[lo : lo + (head if head and not lo else capacity)]
                    row.append(i), piece.append(k), start.append(lo), length.append(len(part)), crc.append(
                        zlib.crc32(part.tobytes())
                    )
                    if with_ids:
                        ids.append(part.astype(np.int64))
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    )


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound on the number of bins from three families of dual-feasible functions.

    With f dual feasible, no bin holds items whose f sums to over 1, so the rounded-up sum of f is a bound. For a
    threshold k:
    sizes over capacity - k count as a whole bin and sizes under k as nothing (k up to half the capacity); the
    same with sizes over half the capacity counted as a bin each; and x -> floor((n + 1) x) / n for small n, where (n +
    1) x is no whole number.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    mass = count * np.arange(capacity + 1)
    n_upto, m_upto = np.cumsum(count), np.cumsum(mass)
    total, half = int(n_upto[-1]), capacity // 2
    best = -(-int(m_upto[-1]) // capacity)
    k = np.arange(0, half + 1)
    below = np.where(k > 0, k - 1, 0)
    whole = total - n_upto[capacity - k]
    kept = m_upto[capacity - k] - np.where(k > 0, m_upto[below], 0)
    best = max(best, int((whole + -(-kept // capacity)).max()))
    large = n_upto[capacity - k] - n_upto[half]
    room = large * capacity - (m_upto[capacity - k] - m_upto[half])
    small = m_upto[half] - np.where(k > 0, m_upto[below], 0)
    best = max(best, int((whole + large + np.maximum(0, -(-(small - room) // capacity))).max()))
    x = np.arange(capacity + 1)
    for n in range(1, 40):
        exact = (n + 1) * x % capacity == 0
        value = np.where(exact, x * n, (n + 1) * x // capacity * capacity)  # times capacity * n
        best = max(best, -(-int((value * count).sum()) // (capacity * n)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item by best-fit decreasing. Bins with room lie by their room; a bit mask finds the least
    that is enough.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    mask = used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        enough = mask >> need
        if enough:
            room = need + (enough & -enough).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - need:
            by_room.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins, offsets


_PLACED = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, sealed boolean"


def _packer(capacity: int, round_no: int):
    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable", na_position="first")
        lengths = g["length"].to_numpy(np.int64)
        bins, offsets = best_fit(lengths, capacity)
        n_bins, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        old = g["sequence_id"].to_numpy(np.int64)
        if round_no and n_bins >= len(np.unique(old)):
            names, offsets, n_bins = old, g["offset"].to_numpy(np.int64), len(np.unique(old))
        else:
            names = (round_no << 56) | (int(key[0]) << 28) | bins
        _, inverse = np.unique(names, return_inverse=True)
        full = np.bincount(inverse, weights=lengths)[inverse] == capacity
        return g.assign(sequence_id=names, offset=offsets, sealed=full | (n_bins == bound))[
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sealed"]
        ]

    return pack


def group_count(rows: int, group_rows: int, least_rows: int = 512, groups: int = 48) -> int:
    """As many groups as keep a cluster busy, but none of under least_rows, and more if a group would exceed
    group_rows.
    """
    return max(1, min(groups, rows // least_rows), -(-rows // group_rows))


def pack(
    parts: DataFrame, capacity: int = 2048, group_rows: int = 32_768, rounds: int = 8, least_gain: float = 0.0001
) -> DataFrame:
    """The written table `parts` (see pieces) with sequence_id and offset."""
    kind = parts.schema["doc_id"].dataType.simpleString()
    schema = _PLACED.format(kind=kind)
    open_rows, done, was = parts.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.lit(0).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    ), [], None
    for r in range(rounds):
        n = open_rows.count()
        if not n:
            break
        # a written table's rows keep their order, so a row's number in it deals equal rows to different groups
        by = F.xxhash64(F.monotonically_increasing_id()) if not r else F.xxhash64("sequence_id", F.lit(r))
        groups = group_count(n, group_rows)
        placed = cut(
            open_rows.withColumn(
                "g", F.pmod(by, F.lit(groups))
            ).groupBy("g").applyInPandas(_packer(capacity, r), schema),
            "packed",
        )
        bins, done_bins = placed.agg(
            F.count_distinct("sequence_id"), F.count_distinct(F.when(F.col("sealed"), F.col("sequence_id")))
        ).first()
        done.append(placed.filter("sealed"))
        open_rows = placed.filter("not sealed").drop("sealed")
        if groups == 1 or was is not None and was - bins <= least_gain * bins:
            break
        was = bins - done_bins
    out = [x.drop("sealed") for x in done] + [open_rows]
    first = out[0]
    for x in out[1:]:
        first = first.unionByName(x)
    return first


def pack_documents(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int = 2048) -> DataFrame:
    return pack(cut(pieces(df, id_col, text_col, vocabulary, capacity), "pieces"), capacity)
