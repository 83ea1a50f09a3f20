"""Operator 11: ranked lexical search by presence masks.

A document's score for an item is the sum over the item's terms, repeats included, of w * ((10^9 * tf) div (1000 * tf + 8 * m)).
w is a term's weight, floor(1000 * ln((2N + 2) / (2df + 1))); m is the document's share of length, 25 + (75 * n * N) div L.
N counts the documents with a term, L all terms, n a document's terms. Terms are told apart by their bytes.

1. The items' terms, in blocks of at most about `entries` (item, term) pairs, are the vocabulary; a block is broadcast.
2. Documents are read once a block: each shard of at most SHARD documents becomes a row of postings of the vocabulary's
   terms, a written table. N, L and df are sums over its rows, so they are those of all documents.
3. In each shard an item's bitmaps of its terms, one bit a document, are turned by documents into masks of matched
   terms, and documents are grouped by mask. A mask's maximum score is what its terms give at their highest counts in
   the shard and at the least m of the group. Groups are evaluated in descending order of it, until the next one is under
   the item's k-th best score so far in the task: then no document left can enter.
4. The k best of each task are ranked by item.

Defined cases: rows with one item id, null included, are one item of all their terms; null and empty texts have no terms;
an item without a match has no rows; a document with a null id counts and is ranked like others, before equal scores; rows
with one id are documents of their own; a text of any length is taken whole; only ids and texts are read, so extra columns
can't clash; no documents or no items, no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm import kernels as K
from stowage.llm.common import cut, drop, text_bytes

SHARD, SHARD_BYTES = 4_096, 8 << 20
#: Documents that are scored at a time.
STEP = 128
TERM = np.zeros(256, np.uint8)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = 1
INDEX = "n_docs long, n_terms long, ids binary, known binary, lengths binary, terms binary, first binary, doc binary, tf binary"
CELLS = ("ids", "known", "lengths", "terms", "first", "doc", "tf")


def _terms(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array, np.ndarray]]:
    """(rows, document of each term, terms, number of terms of each document) of up to SHARD documents at a time."""
    raw, at = K.flat(batch.column(1))
    for lo, hi in K.parts(at, SHARD_BYTES):
        for a in range(lo, hi, SHARD):
            b = min(hi, a + SHARD)
            part, offsets = K.LOWER[raw[at[a] : at[b]]], at[a : b + 1] - at[a]
            starts, ends, first = K.spans(part, offsets, TERM)
            n = np.diff(first)
            yield batch.slice(a, b - a), np.repeat(np.arange(b - a), n), K.word_array(part, starts, ends), n


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, times): the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, doc, terms, _ in _terms(batch):
                table = pa.table({"doc": pa.array(doc), "term": terms}).group_by(["doc", "term"]).aggregate([([], "count_all")])
                columns = [rows.column(0).take(table["doc"].combine_chunks()), table["term"].combine_chunks(), table["count_all"].combine_chunks()]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "term", "times"])

    kind = items.schema[id_col].dataType.simpleString()
    own = items.select(F.col(id_col).alias("item_id"), text_bytes(text_col).alias("text"))
    found = own.mapInArrow(run, f"item_id {kind}, term binary, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def postings(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """A row for each shard of docs (id long, text as bytes): its documents, and the postings of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, doc, terms, n in _terms(batch):
                place = pc.index_in(terms, value_set=shared.value).fill_null(-1).to_numpy()
                hit = np.flatnonzero(place >= 0)
                key, tf = np.unique(place[hit].astype(np.int64) * len(n) + doc[hit], return_counts=True)
                term, d = key // max(1, len(n)), key % max(1, len(n))
                first = np.flatnonzero(np.diff(term, prepend=-1))
                ids = rows.column(0)
                arrays = (
                    ids.fill_null(0).to_numpy().astype("<i8"),
                    ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8),
                    n.astype("<i8"), term[first].astype("<i4"), np.append(first, len(term)).astype("<i4"), d.astype("<u2"), tf.astype("<u4"),
                )
                cells = [pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)]
                yield pa.RecordBatch.from_arrays(cells, ["n_docs", "n_terms", *CELLS])

    return docs.mapInArrow(run, INDEX)


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term of the vocabulary is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, first in zip(batch.column(0), batch.column(1)):
                n = np.diff(np.frombuffer(first.as_buffer(), "<i4")).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_buffer(), "<i4")), pa.array(n)], ["term", "n"])

    return index.select("terms", "first").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("df"))


class Items:
    """A block of items: the sorted term numbers of each, how often it has them, and the weights of all terms."""

    def __init__(self, item: np.ndarray, term: np.ndarray, times: np.ndarray, df: np.ndarray, n_docs: int, n_terms: int) -> None:
        order = np.lexsort((term, item))
        self.term, self.times = term[order], times[order]
        self.begin = np.searchsorted(item[order], np.arange(int(item.max()) + 2))
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        self.n_docs, self.n_terms = n_docs, n_terms


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Search:
    """The k best documents so far of each item."""

    def __init__(self, items: Items, k: int) -> None:
        self.items, self.k = items, k
        n = len(items.begin) - 1
        self.score, self.id, self.known = ([np.zeros(0, np.int64)] * n for _ in range(3))
        self.evaluated = 0

    def shard(self, row: dict[str, memoryview]) -> None:
        get = lambda name, kind: np.frombuffer(row[name], kind)
        terms, first, doc, tf = get("terms", "<i4"), get("first", "<i4"), get("doc", "<u2"), get("tf", "<u4").astype(np.int64)
        ids, known, n = get("ids", "<i8"), get("known", np.uint8).astype(np.int64), get("lengths", "<i8")
        if not len(terms):
            return
        m = 25 + 75 * n * self.items.n_docs // self.items.n_terms
        place_of = np.full(len(self.items.weight), -1, np.int64)
        place_of[terms] = np.arange(len(terms))
        for q in range(len(self.items.begin) - 1):
            own = slice(self.items.begin[q], self.items.begin[q + 1])
            place = place_of[self.items.term[own]]
            here = place >= 0
            lists = place[here]
            if not len(lists):
                continue
            weight = self.items.weight[terms[lists]] * self.items.times[own][here]
            size = first[lists + 1] - first[lists]
            entry = K.ranges(first[lists], size)
            counts = np.zeros((len(lists), len(n)), np.int64)
            counts[np.repeat(np.arange(len(lists)), size), doc[entry]] = tf[entry]
            self._item(q, counts, weight, m, ids, known)

    def _item(self, q: int, counts: np.ndarray, weight: np.ndarray, m: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        masks, group = _by_mask(counts > 0)
        least = np.full(len(masks), np.iinfo(np.int64).max >> 8)
        np.minimum.at(least, group, m)
        bound = (masks * share(counts.max(axis=1)[None, :], least[:, None])) @ weight
        order = np.argsort(-bound, kind="stable")
        docs = np.argsort(_inverse(order)[group], kind="stable")  # documents by their group's bound
        bounds = bound[group[docs]]
        lo, end = 0, int(np.searchsorted(-bounds, 0))  # a group that can't score is left out
        while lo < end:
            if len(self.score[q]) == self.k:
                end = min(end, int(np.searchsorted(-bounds, -self.score[q][-1], "right")))
            some = docs[lo : min(lo + STEP, end)]
            lo += STEP
            if not len(some):
                break
            self.evaluated += len(some)
            got = weight @ share(counts[:, some], m[some][None, :])
            self._add(q, got, ids[some], known[some])

    def _add(self, q: int, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        keep = score > 0
        score, ids, known = (np.concatenate([old, new[keep]]) for old, new in ((self.score[q], score), (self.id[q], ids), (self.known[q], known)))
        order = np.lexsort((ids, known, -score))[: self.k]
        self.score[q], self.id[q], self.known[q] = score[order], ids[order], known[order]

    def rows(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(item, doc_id, score)."""
        item = np.repeat(np.arange(len(self.score)), [len(s) for s in self.score])
        score, ids, known = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (self.score, self.id, self.known))
        return item, pa.array(ids, pa.int64(), mask=known == 0), score


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _by_mask(bitmaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of bitmaps (term, document) as rows of bits, and which of them each document has."""
    n_terms, n_docs = bitmaps.shape
    packed = np.packbits(bitmaps, axis=0, bitorder="little")
    width = -(-len(packed) // 8)
    words = np.zeros((n_docs, width * 8), np.uint8)
    words[:, : len(packed)] = packed.T
    words = words.view("<u8")
    group = np.zeros(n_docs, np.int64)
    for w in range(width):  # a mask of several words is grouped word by word
        _, part = np.unique(words[:, w], return_inverse=True)
        _, group = np.unique(group * (n_docs + 1) + part, return_inverse=True)
    at = np.zeros(int(group.max()) + 1, np.int64)
    at[group] = np.arange(n_docs)
    return bitmaps[:, at].T.astype(np.int64), group


def _search(index: DataFrame, items: Items, ids: pa.Array, kind: str, k: int) -> DataFrame:
    """(item_id, doc_id, score) of the best documents of each task's shards, as a written table."""
    shared = index.sparkSession.sparkContext.broadcast((items, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ids = shared.value
        search = Search(items, k)
        for batch in batches:
            for i in range(batch.num_rows):
                search.shard({name: batch.column(name)[i].as_buffer() for name in CELLS})
        item, doc, score = search.rows()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(item)), doc, pa.array(score)], ["item_id", "doc_id", "score"])

    found = cut(index.select(*CELLS).mapInArrow(run, f"item_id {kind}, doc_id long, score long"), "found")
    shared.destroy()
    return found


def ranked(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, k: int = 10, entries: int = 500_000
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each item. Ids of documents are whole numbers.

    entries: about how many (item, term) pairs a block has; a block's pairs pass through the driver.
    """
    kind = items.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    asked = cut(item_terms(items, item_col, item_text), "item-terms")
    blocks = max(1, -(-asked.count() // entries))
    found = docs.sparkSession.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for b in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        item, term = (got[c].combine_chunks().dictionary_encode("encode") for c in ("item_id", "term"))
        index = cut(postings(rows, term.dictionary), "postings")
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if n_terms:
            known, df = document_frequencies(index).toArrow(), np.zeros(len(term.dictionary), np.int64)
            df[known["term"].to_numpy()] = known["df"].to_numpy()
            block = Items(item.indices.to_numpy(), term.indices.to_numpy(), got["times"].to_numpy(), df, n_docs, n_terms)
            found = found.unionByName(_search(index, block, item.dictionary, kind, k))
        drop(index)
    drop(asked)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
