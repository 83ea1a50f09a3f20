"""Operator 5: substring dedup by level-wise doubling.

A window is `length` consecutive words of one document. A word goes if a window that covers it also starts in a
document with a smaller id.

Levels have lengths from about 7 words on, each at most twice the one before, up to `length` (7, 13; or 7, 13, 25, 50).
A window of the
full length stands for one window of each level in it: at the first level the one with the least hash, at later levels
the one that starts there, or ends
where the full window ends if it would go beyond. The choice depends on the full window's words alone, so wherever
those repeat, what it stands for
repeats too. The first level has one row for a few words only, and windows found in one document only go. Each next
level forms only windows of those
full windows whose window of the level before repeats elsewhere, twice as long; the loop ends when no candidates are
left, or with windows of the full
length, of which those are kept that a smaller id has too. Those are told apart by 128 bits, made from the 128-bit XXH3 of
each word; shorter ones by 64, where a false equal only costs work.
Last, each document drops the words under its surviving windows.

A document whose whole text a smaller id has too loses all its words (if it has a window at all) and takes part in no
level, so a group of copies is one document.
Texts are shuffled once, to buckets by id; levels exchange (id, hash) only. A window in a large share of all documents
would bring all its rows to one task. A
sample of documents names such keys (at most HOT_KEYS, broadcast). They repeat, so they survive without being gathered:
their rows are salted. At
the last level their least id is pre-aggregated. What the sample misses only makes a larger group; results don't depend
on it.

Defined cases: null and empty texts have no words; a null id is kept whole and counts as no earlier document; rows with
one id are one document for the comparison of ids, so they don't take words from each other; a repeat inside a document
stays; a text of any length is taken whole. Only id and text are read, so extra columns can't clash. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from stowage.llm import kernels as K
from stowage.llm.common import cut, drop, text_bytes

#: A key is hot if so many documents of the sample have it; the sample is one in 64 of the documents, SAMPLE_DOCS at
#: least.
SAMPLE_DOCS, HOT_IN_SAMPLE, HOT_KEYS = 8_192, 12, 200_000
LEAST = 7
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 50_000


def levels(length: int) -> list[int]:
    """The lengths of all levels: halves of the asked length, rounded up, as long as they have LEAST words."""
    out = [length]
    while out[0] > LEAST:
        out.insert(0, (out[0] + 1) // 2)
    return out if len(out) == 1 or out[0] >= LEAST // 2 else out[1:]


class Words:
    """The words of a run of documents, and their windows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int) -> None:
        self.length = length
        self.starts, self.ends, self.first = K.spans(raw, offsets)
        self.hash, self.other = K.word_hash_pairs(raw, self.starts, self.ends)
        n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(n)), n)
        left = np.repeat(self.first[1:], n) - np.arange(len(self.hash))  # words from here to the document's end
        self.rows = np.flatnonzero(left >= length)  # where full windows start

    def standing_for(self, sizes: list[int], level: int) -> np.ndarray:
        """For each full window the hash of the window of a level that it stands for."""
        size = sizes[level]
        hashes = K.ngram_hashes(self.hash, size)
        if size == self.length:
            return hashes[self.rows]
        least = K.leftmost_least(
            hashes if not level else K.ngram_hashes(self.hash, sizes[0]), self.length - sizes[0] + 1
        )[self.rows]
        return hashes[np.minimum(least, self.rows + self.length - size)]

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each full window, one from each half of its words' hashes."""
        one, two = (K.ngram_hashes(h, self.length) for h in (self.hash, self.other))
        return one[self.rows], two[self.rows]


def _distinct(doc: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """(document, values) each once."""
    order = np.lexsort((*values[::-1], doc))
    columns = [x[order] for x in (doc, *values)]
    new = np.ones(len(doc), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [c[new] for c in columns]


def _among(values: np.ndarray, doc: np.ndarray, sets: pa.ListArray) -> np.ndarray:
    """Whether each value is in its document's set."""
    hit = np.zeros(len(values), bool)
    bounds = np.searchsorted(doc, np.arange(len(sets) + 1))
    for d in range(len(sets)):
        lo, hi = bounds[d], bounds[d + 1]
        if hi > lo and sets[d].is_valid:
            hit[lo:hi] = np.isin(values[lo:hi], sets[d].values.to_numpy().view(np.uint64))
    return hit


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Words]]:
    for batch in batches:
        raw, at = K.flat(batch.column(1))
        for lo, hi in K.parts(at):
            part = raw[at[lo] : at[hi]]
            yield batch.slice(lo, hi - lo), part, Words(part, at[lo : hi + 1] - at[lo], length)


def _windows(joined: DataFrame, length: int, level: int) -> DataFrame:
    """(id, h), and g at the last level: the windows that documents (id, text, and from the second level on the
    surviving set of the level before) stand for.
    """
    sizes = levels(length)
    last = level == len(sizes) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, words in _runs(batches, length):
            keep = np.ones(len(words.rows), bool)
            if level:
                keep = _among(words.standing_for(sizes, level - 1), words.doc[words.rows], batch.column(2))
            values = words.full() if last else (words.standing_for(sizes, level),)
            doc, *found = _distinct(words.doc[words.rows][keep], *(v[keep] for v in values))
            columns = [batch.column(0).take(pa.array(doc)), *(pa.array(v.view(np.int64)) for v in found)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "g"][: len(columns)])

    return joined.mapInArrow(run, f"id {joined.schema['id'].dataType.simpleString()}, h long" + ", g long" * last)


def _covered(words: Words, sets: pa.ListArray) -> np.ndarray:
    """Which words lie under a window that is in its document's set of hash pairs."""
    gone = np.zeros(len(words.hash) + 1, np.int64)
    if len(words.rows):
        one, two = words.full()
        bounds = np.searchsorted(words.doc[words.rows], np.arange(len(sets) + 1))
        for d in range(len(sets)):
            lo, hi = bounds[d], bounds[d + 1]
            if hi > lo and sets[d].is_valid:
                h, g = (sets[d].values.field(k).to_numpy().view(np.uint64) for k in ("h", "g"))
                order = np.argsort(h)
                at = order[np.minimum(np.searchsorted(h, one[lo:hi], sorter=order), len(h) - 1)]
                rows = words.rows[lo:hi][(h[at] == one[lo:hi]) & (g[at] == two[lo:hi])]
                np.add.at(gone, rows, 1)
                np.add.at(gone, rows + words.length, -1)
    return np.cumsum(gone[:-1]) > 0


def _hot(sample: DataFrame, key: list[str]) -> DataFrame:
    """At most HOT_KEYS keys that many documents of the sample have, as a written table."""
    counts = sample.groupBy(*key).count().filter(F.col("count") >= HOT_IN_SAMPLE)
    return cut(
        counts.orderBy(F.col("count").desc(), *key).limit(HOT_KEYS).select(*key, F.lit(True).alias("hot")),
        "hot-windows",
    )


def _in_several(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(id, h) of the windows that several documents have."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(8192))).otherwise(F.lit(-1))
    key = Window.partitionBy("h", "salt")
    salted = rows.join(F.broadcast(hot), "h", "left").withColumn("salt", salt)
    return salted.withColumn(
        "a", F.min("id").over(key)
    ).withColumn("b", F.max("id").over(key)).filter("hot or a < b").select("id", "h")


def _in_smaller(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(id, h, g) of the windows that a document with a smaller id has too."""
    key = ["h", "g"]
    least = rows.join(F.broadcast(hot), key, "left_semi").groupBy(*key).agg(F.min("id").alias("a"))
    common = rows.join(F.broadcast(least), key).filter("id > a").select("id", *key)
    rare = rows.join(F.broadcast(hot), key, "left_anti").withColumn("a", F.min("id").over(Window.partitionBy(*key)))
    return common.unionByName(rare.filter("id > a").select("id", *key))


def bucketed(docs: DataFrame) -> DataFrame:
    """docs (id, text as bytes, and others) with ids, in buckets by id, and copy: whether a smaller id has the same
    text. Texts are shuffled here and nowhere else.
    """
    known = docs.filter("id is not null").withColumn("digest", F.md5("text"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_BUCKETS, max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))
    digests = cut(known.select("id", "digest"), "digests")
    first = cut(
        digests.groupBy("digest").agg(
            F.min("id").alias("first"), F.max("id").alias("last")
        ).filter("first < last").select("digest", "first"),
        "firsts",
    )
    later = digests.join(first, "digest").filter("id > first").groupBy("id").agg(
        F.collect_set("digest").alias("copied")
    )
    copies = cut(later, "copies")
    copy = F.coalesce(F.array_contains("copied", F.col("digest")), F.lit(False)).alias("copy")
    marked = known.repartition(parts, "id").join(
        copies.repartition(parts, "id"), "id", "left"
    ).select(*docs.columns, copy)
    table = cut(marked, "texts", (parts, "id"))
    drop(digests, first, copies)
    return table


def repeated_windows(texts: DataFrame, length: int) -> DataFrame | None:
    """(id, set of hash pairs) for the documents of texts (see bucketed) that repeat full windows of smaller ids; None
    if none does.
    """
    sizes, own = levels(length), texts.filter("not copy").select("id", "text")
    total = texts.count()
    in_sample = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(1, total // max(SAMPLE_DOCS, total >> 6)))) == 0
    found = None
    for level in range(len(sizes)):
        last, key = level == len(sizes) - 1, ["h", "g"] if level == len(sizes) - 1 else ["h"]
        if level:
            rows = cut(
                _windows(own.join(found.hint("shuffle_hash"), "id").select("id", "text", "windows"), length, level),
                "windows",
            )
            hot = _hot(rows.filter(in_sample), key)
        else:
            rows = _windows(own, length, level)
            hot = _hot(_windows(own.filter(in_sample), length, level), key)
        kept = _in_smaller(rows, hot) if last else _in_several(rows, hot)
        now = cut(
            kept.groupBy("id").agg(F.collect_set(F.struct(*key) if last else F.col("h")).alias("windows")), "repeated"
        )
        drop(rows, hot, found)
        found = now
        if found.isEmpty():
            drop(found)
            return None
    return found


def _with_gone(docs: DataFrame, length: int) -> DataFrame:
    """docs (id, text as bytes, and others) with copy and gone, the full windows to drop."""
    texts = bucketed(docs)
    found = repeated_windows(texts, length)
    none = F.lit(None).cast("array<struct<h:bigint,g:bigint>>").alias("gone")
    if found is None:
        joined = texts.select(*docs.columns, "copy", none)
    else:
        joined = texts.join(found.hint("shuffle_hash"), "id", "left").select(
            *docs.columns, "copy", F.col("windows").alias("gone")
        )
    return joined.unionByName(docs.filter("id is null").select(*docs.columns, F.lit(False).alias("copy"), none))


def _bare(words: Words, copy: pa.Array, gone: pa.ListArray) -> np.ndarray:
    """Which words go: those under repeated windows, and all of a copy that has a window."""
    bare = _covered(words, gone)
    copied = np.asarray(copy.to_numpy(zero_copy_only=False), bool) & (np.diff(words.first) >= words.length)
    return bare | np.repeat(copied, np.diff(words.first))


def dedup_words(df: DataFrame, id_col: str, text_col: str, length: int = 13) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 for each row of df."""
    docs = df.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, words in _runs(batches, length):
            gone = _bare(words, batch.column(2), batch.column(3))
            total, removed = np.diff(words.first), np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            data, sha = raw.tobytes(), []
            for d in range(batch.num_rows):
                lo, hi = words.first[d], words.first[d + 1]
                if removed[d]:
                    keep = np.flatnonzero(~gone[lo:hi]) + lo
                    text = b" ".join(data[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist()))
                else:
                    text = b" ".join(data[words.starts[lo] : words.ends[hi - 1]].split()) if hi > lo else b""
                sha.append(hashlib.sha256(text).hexdigest())
            columns = [
                batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_removed", "kept_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return _with_gone(docs, length).mapInArrow(
        run, f"{id_col} {kind}, n_words long, n_removed long, kept_sha256 string"
    )


def cut_repeats(df: DataFrame, id_col: str, text_col: str, length: int = 50) -> DataFrame:
    """df with the repeated spans taken out of its text; white space between kept words stays as it was.

    The other columns, whatever their names, go with their row through the one shuffle of texts. A null text stays null.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    row = F.struct(F.col(f"`{text_col}`").isNull().alias("_null"), *others).alias("row")
    docs = df.select(F.col(f"`{id_col}`").alias("id"), text_bytes(text_col).alias("text"), row)
    schema = StructType([docs.schema["row"], StructField("text", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, words in _runs(batches, length):
            bare, data, texts = _bare(
                words, batch.column(3), batch.column(4)
            ), raw.tobytes(), batch.column(1).to_pylist()
            changed = np.unique(words.doc[bare])
            for d in changed.tolist():
                lo, hi = words.first[d], words.first[d + 1]
                keep = np.flatnonzero(~bare[lo:hi]) + lo
                breaks = np.flatnonzero(np.diff(keep) != 1) + 1
                texts[d] = b" ".join(
                    data[words.starts[r[0]] : words.ends[r[-1]]] for r in np.split(keep, breaks) if len(r)
                )
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(texts, pa.binary())], ["row", "text"])

    made = _with_gone(docs, length).mapInArrow(run, schema)
    text = F.when(~F.col("row._null"), F.col("text").cast("string")).alias(text_col)
    return made.select(*[text if c == text_col else F.col(f"row.`{c}`") for c in df.columns])
