"""Vectorised text kernels: words, n-gram hashes and per-document sums over whole Arrow batches.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. Every kernel works on one flat byte array that holds
many documents one after another, so its cost doesn't depend on how the bytes are dealt to documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 20
_C = 0xC2B2AE3D27D4EB4F
WORD = np.ones(256, np.uint8)
WORD[[9, 10, 11, 12, 13, 32]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array, and where each value starts (one more entry than values)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_string(array.type) or pa.types.is_large_string(array.type):
        array = array.cast(pa.binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    wide = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    at = np.frombuffer(offsets, wide)[
        array.offset : array.offset + len(array) + 1
    ].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def parts(offsets: np.ndarray, size: int = 4 * CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of documents of about size bytes; a longer document is alone in its run."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans(raw: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of one kind of byte (kind 0 separates), and the number of the first run of
    each document (one more entry)."""
    kind = kinds[raw]
    change = np.ones(len(raw) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets[offsets < len(raw)]] = True
    starts = np.flatnonzero(change[:-1] & (kind > 0))
    ends = np.flatnonzero(change[1:] & (kind > 0)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_array(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes from starts to ends, which don't overlap, as a binary array."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    kept = np.ascontiguousarray(raw[np.cumsum(inside[:-1], dtype=np.int8) > 0])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def word_hash_pairs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit XXH3 of each word; each distinct word is hashed once."""
    coded = word_array(raw, starts, ends).dictionary_encode()
    digests = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
    both = np.frombuffer(digests, "<u8").reshape(-1, 2)
    of = coded.indices.to_numpy()
    return both[of, 0], both[of, 1]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return word_hash_pairs(raw, starts, ends)[0]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 entries are not meaningful.

    Built by doubling: the value at twice a length is mixed from two values at that length, so no sums of words cancel.
    """
    total, length, level, step = words.copy(), 0, words, 1
    rest = n
    while rest:
        if rest & 1:
            if length:
                kept = max(0, len(words) - length)
                total[:kept] = mix(total[:kept] * np.uint64(_C) + level[length:])
            else:
                total = level.copy()
            length += step
        rest >>= 1
        if rest:
            wider = level.copy()
            wider[:-step] = mix(level[:-step] * np.uint64(_C) + level[step:])
            level, step = wider, step * 2
    return mix(total)


def sliding(x: np.ndarray, width: int, combine: np.ufunc, fill: int) -> np.ndarray:
    """combine over x[i : i + width] for each i; past the end there is fill."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        moved = np.full_like(out, fill)
        moved[:-step] = out[step:]
        out = combine(out, moved)
        have += step
    return out


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the least of x[i : i + width] stands, for each i; of equals the first. Past the end nothing is looked
    at.
    """
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        moved = at.copy()
        moved[: max(0, len(x) - step)] = at[step:]
        at = np.where(x[moved] < x[at], moved, at)
        have += step
    return at


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def doc_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values (rows) by document; first has one more entry than documents."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
