"""Operator 13: phrase collocations by dynamic itemset counting.

Texts, A-Z lower-cased, are split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at blanks and tabs into words. f(phrase) counts
a phrase's occurrences within pieces of one language. Frequent are phrases of 1 to 5 words with f >= least.

1. The corpus is tokenised once and dealt to shards, folders of one table. A step scans one shard, and steps go round the
   shards.
2. Words are counted from step 0 on. When a phrase has reached `least` in what was scanned of it so far, it is marked;
   a longer phrase becomes active in the step after both its subphrases, all but its last word and all but its first, are
   marked. So lengths interleave: pairs of common words are counted from the second shard on.
3. A phrase is active for as many steps as there are shards, which sees each shard once, so its count is exact. Then it is
   closed: kept if frequent, else forgotten. Steps go on until no phrase is active and none can become so.

Marks are a table of 2^bits bytes, whatever the corpus, broadcast packed: a phrase's hash gives a place, the byte the first
step that its extensions may be counted in. A place that two phrases share only makes extensions active that needn't be; when a
phrase is active still depends on its words alone and it is still counted for one full round. Nothing else is hashed:
phrases are grouped and kept by their words. Counts are summed in each batch, then in each task, then shuffled.

score_phrases() scores the frequent phrases of two words and more at their weakest cut and drops those inside an
equally frequent longer one.

Defined cases: a null language is `und`; null and empty texts have no words; rows are documents whether or not ids
repeat (ids aren't read); equal scores go by count, then by the phrase's bytes; a text of any length is taken whole;
only text and language are read, so extra columns can't clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm import kernels as K
from stowage.llm.common import cut, drop, text_bytes

SHARDS, LONGEST, BITS = 4, 5, 25
PART_BYTES = 8 << 20
NEVER = 255
WORDS = np.ones(256, np.uint8)
WORDS[[9, 10, 11, 12, 13, 32, 33, 44, 46, 58, 59, 63]] = 0
SPLITS = np.zeros(256, np.uint8)
SPLITS[[10, 11, 12, 13, 33, 44, 46, 58, 59, 63]] = 1


TOKENS = "shard int, words binary, ends binary, hashes binary, langs binary, lang_ends binary, word binary, lang binary, left binary"


def _packed(raw: np.ndarray, offsets: np.ndarray, langs: pa.Array) -> list[bytes]:
    """Documents as their distinct words and languages, and for each word occurrence the number of both and how many words
    the piece has from there on, LONGEST at most."""
    part = K.LOWER[raw]
    starts, ends, first = K.spans(part, offsets, WORDS)
    coded, names = K.word_array(part, starts, ends).dictionary_encode(), langs.dictionary_encode()
    flat, at = K.flat(coded.dictionary)
    name_bytes, name_at = K.flat(names.dictionary.cast(pa.binary()))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    piece = np.cumsum(SPLITS[part])[starts] + doc if len(starts) else doc
    left = np.zeros(len(piece), np.uint8)
    for k in range(LONGEST, 0, -1):
        same = piece[k - 1 :] == piece[: max(0, len(piece) - k + 1)]
        left[: len(same)] = np.maximum(left[: len(same)], same * np.uint8(k))
    lang = names.indices.to_numpy()[doc]
    cells = flat, at[1:].astype("<i4"), K.word_hashes(flat, at[:-1], at[1:]), name_bytes, name_at[1:].astype("<i4"), coded.indices.to_numpy().astype("<i4"), lang.astype("<i4"), left
    return [np.ascontiguousarray(c).tobytes() for c in cells]


def tokenised(rows: DataFrame, shards: int) -> DataFrame:
    """rows (lang, text as bytes), packed: documents that come together are dealt to the shards in turn, a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            _, at = K.flat(batch.column(1))
            for lo, hi in K.parts(at, PART_BYTES):
                for shard in range(shards):
                    some = batch.slice(lo, hi - lo).take(pa.array(np.arange((shard - turn) % shards, hi - lo, shards)))
                    if some.num_rows:
                        raw, offsets = K.flat(some.column(1))
                        cells = _packed(raw, offsets, some.column(0))
                        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names)
                turn += hi - lo

    names = [f.strip().split(" ")[0] for f in TOKENS.split(",")]
    return rows.mapInArrow(run, TOKENS)


def _binary(cell: pa.Scalar, ends: pa.Scalar) -> pa.Array:
    """The values that lie one after another in a cell."""
    offsets = np.concatenate([[0], np.frombuffer(ends.as_buffer(), "<i4")]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), cell.as_buffer()])


class Words:
    """The words of packed documents: numbers for (language, word), hashes, and how many words follow in the piece."""

    def __init__(self, row: dict[str, pa.Scalar]) -> None:
        get = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        self.words, self.langs = _binary(row["words"], row["ends"]), _binary(row["langs"], row["lang_ends"])
        self.word, self.lang, self.left = get("word", "<i4").astype(np.int64), get("lang", "<i4"), get("left", np.uint8)
        self.width = len(self.words) * max(1, len(self.langs))
        seeds = np.array([xxhash.xxh64_intdigest(x.as_py()) for x in self.langs], np.uint64)
        self.seed = seeds[self.lang] if len(seeds) else np.zeros(0, np.uint64)
        self.hash = get("hashes", "<u8")[self.word]

    def number(self, at: np.ndarray) -> np.ndarray:
        return self.word[at] * max(1, len(self.langs)) + self.lang[at]

    def counts(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the phrases of k words from the positions at on, each once: which position, and how often."""
        rank = self.number(at)
        for j in range(1, k):
            if j > 1:
                rank = np.unique(rank, return_inverse=True)[1]
            rank = rank * self.width + self.number(at + j)
        _, one, n = np.unique(rank, return_index=True, return_counts=True)
        return one, n

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases at these positions, a line feed, and the language."""
        columns = [self.words.take(pa.array(self.word[at + j])) for j in range(k)]
        text = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())) if k > 1 else columns[0]
        names = self.langs.take(pa.array(self.lang[at]))
        return pc.binary_join_element_wise(text, names, pa.scalar(b"\n", pa.binary())).view(pa.string())


_OPENED: list = [None, None]


def _opened(packed: bytes, size: int) -> np.ndarray:
    """The table of marks, unpacked once in a worker for all tasks of a step."""
    if _OPENED[0] != packed:
        _OPENED[:] = packed, np.frombuffer(pa.decompress(packed, size, "zstd"), np.uint8)
    return _OPENED[1]


def _scan(shard: DataFrame, marks: Broadcast, bits: int, step: int, shards: int) -> DataFrame:
    """(phrase, tag, n): what a step counts. tag holds the phrase's place, the step it became active in and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _opened(marks.value, 1 << bits)
        for batch in batches:
            for i in range(batch.num_rows):
                words = Words({name: batch.column(name)[i] for name in batch.schema.names})
                yield from _active(words, table, bits, step, shards)

    return shard.mapInArrow(run, "phrase string, tag long, n long")


def _active(words: Words, table: np.ndarray, bits: int, step: int, shards: int) -> Iterator[pa.RecordBatch]:
    """The counts of the active phrases. A phrase can only be active, or begin a longer one that is, where both its subphrases
    are marked, so each length looks at the positions only that the one before has left."""
    at, state = np.arange(len(words.word)), words.hash + words.seed
    start = np.zeros(len(at), np.uint8)
    for k in range(1, LONGEST + 1):
        if not len(at):
            return
        place = np.zeros(len(at), np.int64)
        if k < LONGEST:
            place = (K.mix(state + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)
        active = np.flatnonzero((start <= step) & (step < start.astype(np.int64) + shards))
        if len(active):
            one, n = words.counts(at[active], k)
            which = active[one]
            tag = place[which] | start[which].astype(np.int64) << 40 | np.int64(k) << 48
            yield pa.RecordBatch.from_arrays([words.phrases(at[which], k), pa.array(tag), pa.array(n)], ["phrase", "tag", "n"])
        if k == LONGEST:
            return
        # a place that is marked for another phrase may be so before this one's own parts are
        since = np.maximum(table[place], start)
        there = np.flatnonzero(since != NEVER)
        mark = np.full(len(words.word) + 1, NEVER, np.uint8)
        mark[at[there]] = since[there]
        there = there[(words.left[at[there]] > k) & (mark[at[there] + 1] != NEVER)]
        at, state = at[there], state[there]
        start = np.maximum(since[there], mark[at + 1])
        state = K.mix(state * np.uint64(0xC2B2AE3D27D4EB4F) + words.hash[at + k])


def _set_places(phrases: DataFrame) -> np.ndarray:
    """The places of the tags of phrases, as bitmaps of 32,768 places that Spark makes."""
    place = (F.col("tag").bitwiseAND(F.lit((1 << 40) - 1)) + 1).alias("place")
    maps = phrases.select(place).groupBy(F.bitmap_bucket_number("place").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("m"))
    got = maps.toArrow()
    found = [np.zeros(0, np.int64)]
    for b, m in zip(got["b"].to_pylist(), got["m"].to_pylist()):
        found.append((b - 1) * 32_768 + np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little")))
    return np.concatenate(found)


def frequent_phrases(
    docs: DataFrame, text_col: str, lang_col: str, least: int = 100, shards: int = SHARDS, bits: int = BITS
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of the frequent phrases of 1 to 5 words, and (lang, n) with all word occurrences."""
    text = text_bytes(text_col)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    dealt = cut(tokenised(rows.filter(F.octet_length("text") > 0), shards), "shards", folders="shard")
    length, start = F.shiftright("tag", 48), F.shiftright("tag", 40).bitwiseAND(F.lit(255))
    marks, latest, step = np.full(1 << bits, NEVER, np.uint8), 0, 0
    counted, kept, totals = None, [], None
    while step < latest + shards:
        if latest + shards >= NEVER:
            raise ValueError(f"{shards} shards are too many")
        shared = docs.sparkSession.sparkContext.broadcast(pa.compress(marks, "zstd", asbytes=True))
        found = _scan(dealt.filter(F.col("shard") == step % shards).drop("shard"), shared, bits, step, shards)
        found = found.select("phrase", "tag", "n", F.lit(0).cast("long").alias("was"))
        if counted is not None:
            still = counted.filter(start + (shards - 1) >= step)
            found = found.unionByName(still.select("phrase", "tag", "n", F.col("n").alias("was")))
        now = cut(found.groupBy("phrase", "tag").agg(F.sum("n").alias("n"), F.sum("was").alias("was")), "counted")
        drop(counted)
        shared.destroy()
        counted = now
        places = _set_places(counted.filter((F.col("n") >= least) & (F.col("was") < least) & (length < LONGEST)))
        places = places[marks[places] == NEVER]
        marks[places] = step + 1
        latest = step + 1 if len(places) else latest
        closed = counted.filter(start + (shards - 1) == step)
        lang, phrase = F.expr("substr(phrase, instr(phrase, '\\n') + 1)"), F.substring_index("phrase", "\n", 1)
        kept.append(cut(closed.filter(F.col("n") >= least).select(lang.alias("lang"), phrase.alias("phrase"), length.cast("int").alias("k"), "n"), "frequent"))
        if step == shards - 1:  # words are closed
            totals = cut(closed.filter(length == 1).groupBy(lang.alias("lang")).agg(F.sum("n").alias("n")), "totals")
        step += 1
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    out = cut(out, "phrases")
    drop(counted, dealt, *kept)
    return out, totals


def score_phrases(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the frequent phrases of two words and more (see frequent_phrases): the cut with
    the lowest score counts, of equal ones the first; without those that lie inside an equally frequent longer one.
    """
    words, k = F.split("phrase", " "), F.col("k")
    inner = frequent.filter("k > 2").select("lang", F.explode(F.array(
        F.array_join(F.slice(words, F.lit(1), k - 1), " "), F.array_join(F.slice(words, F.lit(2), k - 1), " ")
    )).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    own = frequent.filter("k > 1").withColumnRenamed("n", "a").join(inner, ["lang", "phrase"], "left")
    own = own.filter(F.col("around").isNull() | (F.col("around") < F.col("a"))).drop("around")
    cuts = own.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), k - 1)).alias("at"), k, words.alias("w")).select(
        "lang", "phrase", "a", "at",
        F.array_join(F.slice("w", F.lit(1), F.col("at")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("at") + 1, k - F.col("at")), " ").alias("right"),
    )
    left = frequent.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    wide = {c: f"cast({c} as decimal(18, 0))" for c in ("a", "n", "l", "r")}
    score = F.expr(f"(cast(1000 * {wide['a']} as decimal(20, 0)) * {wide['n']}) div ({wide['l']} * {wide['r']})")
    best = F.min(F.struct(score.alias("score"), "at", "l", "r", "n")).alias("best")
    return scored.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")


def top_collocations(docs: DataFrame, text_col: str, lang_col: str, least: int = 100, most: int = 2000, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first phrases by score, count and bytes."""
    scored = score_phrases(*frequent_phrases(docs, text_col, lang_col, least, shards, bits))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
