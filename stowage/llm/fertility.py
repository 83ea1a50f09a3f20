"""Operator 12: quality rules by tokeniser fertility.

A document's words are tokenised with public vocabularies, each word by itself after a space, and measured:

- chars_per_token: code points in words for each token of the first vocabulary, and of the second (a byte-level one);
- fallback_share: the share of tokens of the first that are single bytes;
- entropy: of the tokens in stretches of about STRETCH tokens, as a share of what the stretch could have; their mean.

Each measure has a band for each language, or for texts without one for each script, the one that most of their letters have. Bands come from all documents:
a measure's distance from the language's median is divided by its noise, sqrt(1/tokens + 1/STEADY), and the quartiles of
that, FENCE times as far out again, are the band. Measures are whole 1/GRAIN steps here, so quartiles are exact and
what is summed is bounded. Characters a token may be neither too few nor too many, fallback may not be too high, entropy
not too low. A document with a measure outside its band is rejected.

Base rules come first: a document fails with under 10 words, or with over a fifth of its words in 5-word windows
that it has twice or more.

Defined cases: null and empty texts have no words and fail; rows are documents, whether or not ids repeat; equal
texts of one language get equal verdicts; a null language counts as the text's script, `script:none` without letters; a
text of any length is measured whole; only id, text and language are read, so extra columns can't clash; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm import kernels as K
from stowage.llm.common import cut, text_bytes
from stowage.llm.packing import PATTERN

WINDOW = 5
STRETCH, STEADY = 64, 256
GRAIN, FENCE = 1000, 3.0
KEEP_WORDS = 400_000  # words whose tokens a worker remembers
SMALL_BANDS = 100_000  # groups of bands, of some hundred bytes, that are broadcast
SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
LINE = np.ones(256, np.uint8)
LINE[10] = 0
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["chars_per_token", "chars_per_byte_token", "fallback_share", "entropy"]
#: Which ends of its band a measure may not be beyond.
ENDS = {"chars_per_token": "both", "chars_per_byte_token": "both", "fallback_share": "high", "entropy": "low"}
SCRIPTS = ["none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other"]


def _script_of_lead() -> np.ndarray:
    """The script of letters by their first UTF-8 byte; three-byte letters of e3 and e1 count as their commonest script."""
    out = np.zeros(256, np.int64)
    out[65:91] = out[97:123] = 1
    for lo, hi, script in ((0xC3, 0xCA, 1), (0xCD, 0xD0, 2), (0xD0, 0xD5, 3), (0xD6, 0xD8, 4), (0xD8, 0xDC, 5), (0xE0, 0xE1, 6), (0xE3, 0xE4, 7), (0xE4, 0xEA, 8), (0xEA, 0xEE, 9), (0xF0, 0xF5, 10)):
        out[lo:hi] = script
    return out


LEAD = _script_of_lead()


class Vocabularies:
    """Tokens of words: of a SentencePiece model, and how many of a rank file."""

    def __init__(self, model: bytes, ranks: bytes) -> None:
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.n)])
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.bytewise = tiktoken.Encoding(hashlib.md5(ranks).hexdigest(), pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.known: dict[bytes, tuple[list[int], int]] = {}

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words one after another, the number of ids of each, and the number of byte-level tokens of each."""
        if len(self.known) > KEEP_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for lo in range(0, len(new), 10_000):
            texts = [w.decode("utf-8", "replace") for w in new[lo : lo + 10_000]]
            ids = self.pieces.encode(texts, num_threads=1)
            bytewise = [len(self.bytewise.encode_ordinary(f" {t}")) for t in texts]
            self.known.update(zip(new[lo : lo + 10_000], zip(ids, bytewise)))
        found = [self.known[w] for w in words]
        size = np.fromiter((len(x) for x, _ in found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(x for x, _ in found), np.int32, int(size.sum()))
        return flat, size, np.fromiter((n for _, n in found), np.int64, len(found))


_VOCABULARIES: dict[str, Vocabularies] = {}


def vocabularies(model: bytes, ranks: bytes) -> Vocabularies:
    key = hashlib.md5(model + ranks).hexdigest()
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabularies(model, ranks)
    return _VOCABULARIES[key]


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def repeated_words(word: np.ndarray, doc: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Which words are in a window of `size` words that their document has twice or more.

    Level by level: a window repeats only if its first words do, so each length looks at the positions only that are left.
    """
    out = np.zeros(len(word) + 1, np.int64)
    if len(word) < size:
        return out[:-1] > 0
    number = np.unique(doc * (int(word.max()) + 1) + word, return_inverse=True)[1]
    at = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :])
    rank, width = number[at], int(number.max()) + 1
    for j in range(1, size):
        _, rank, n = np.unique(rank * width + number[at + j], return_inverse=True, return_counts=True)
        left = n[rank] > 1
        at, rank = at[left], rank[left]
    np.add.at(out, at, 1)
    np.add.at(out, at + size, -1)
    return np.cumsum(out[:-1]) > 0


def _measure(raw: np.ndarray, offsets: np.ndarray, tokens: Vocabularies) -> dict[str, np.ndarray]:
    """The base counts, the measures and the number of tokens of each document."""
    n_docs = len(offsets) - 1
    starts, ends, first = K.spans(raw, offsets)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n_docs), n_words)
    coded = K.word_array(raw, starts, ends).dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    chars = pc.utf8_length(coded.dictionary.view(pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {"n_words": n_words, "word_chars": _per_doc(chars[word], first), "n_symbols": _per_doc(SYMBOL[raw], offsets)}
    lines, line_ends, line_first = K.spans(raw, offsets, LINE)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, lines)
    line_doc = np.repeat(np.arange(n_docs), np.diff(line_first))
    line = K.word_array(raw, lines, line_ends).dictionary_encode().indices.to_numpy().astype(np.int64)
    key = np.unique((line_doc * (len(lines) + 1) + line)[worded])
    out["n_dup_lines"] = np.bincount(line_doc[worded], minlength=n_docs) - np.bincount(key // (len(lines) + 1), minlength=n_docs)
    out["n_repeat_words"] = _per_doc(repeated_words(word, doc), first)
    ids, size, by_bytes = tokens.of(coded.dictionary.to_pylist())
    begin = np.cumsum(size) - size
    stream = ids[K.ranges(begin[word], size[word])] if len(word) else np.zeros(0, np.int32)
    n = np.bincount(doc, weights=size[word], minlength=n_docs).astype(np.int64)
    n_bytes = np.bincount(doc, weights=by_bytes[word], minlength=n_docs)
    at = np.concatenate([[0], np.cumsum(n)])
    out["n_tokens"] = n
    out["chars_per_token"] = out["word_chars"] / np.maximum(1, n)
    out["chars_per_byte_token"] = out["word_chars"] / np.maximum(1, n_bytes)
    out["fallback_share"] = _per_doc(tokens.is_byte[stream], at) / np.maximum(1, n)
    out["entropy"] = _entropy(stream.astype(np.int64), n, at, tokens.n)
    return out


def scripts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of the script that most letters of each document have, the first of equals; 0 without letters."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = np.bincount(doc * len(SCRIPTS) + LEAD[raw], minlength=(len(offsets) - 1) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
    n[:, 0] = 0
    return np.where(n.any(axis=1), n.argmax(axis=1), 0)


def _entropy(stream: np.ndarray, n: np.ndarray, at: np.ndarray, n_ids: int) -> np.ndarray:
    """The mean over a document's stretches of their entropy, as a share of the logarithm of their length; 1 for one token."""
    stretches = np.maximum(1, (n + STRETCH // 2) // STRETCH)
    owner = np.repeat(np.arange(len(n)), n)
    before = np.cumsum(stretches) - stretches
    stretch = before[owner] + (np.arange(len(stream)) - at[owner]) * stretches[owner] // n[owner]
    key, count = np.unique(stretch * n_ids + stream, return_counts=True)
    total = int(stretches.sum())
    size = np.bincount(stretch, minlength=total)
    spread = np.bincount(key // n_ids, weights=count * np.log2(count), minlength=total)
    share = np.ones(total)
    long = size > 1
    share[long] = 1 - spread[long] / (size[long] * np.log2(size[long]))
    sums = np.concatenate([[0], np.cumsum(share)])
    return (sums[before + stretches] - sums[before]) / stretches


def measures(df: DataFrame, id_col: str, text_col: str, lang_col: str, model_file: str, ranks_file: str) -> DataFrame:
    """doc_id, key (language or script), the base counts, n_tokens and the measures of each row."""
    context = df.sparkSession.sparkContext
    files = []
    for path in (model_file, ranks_file):
        with open(path, "rb") as f:
            files.append(context.broadcast(f.read()))
    names = pa.array([f"script:{s}" for s in SCRIPTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabularies(*(f.value for f in files))
        for batch in batches:
            raw, at = K.flat(batch.column(2))
            for lo, hi in K.parts(at):
                part, offsets = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                got, key = _measure(part, offsets, tokens), batch.column(1).slice(lo, hi - lo)
                if key.null_count:
                    key = pc.coalesce(key, names.take(pa.array(scripts(part, offsets))))
                whole = [pa.array(got[c].astype(np.int64)) for c in (*BASE, "n_tokens")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), key, *whole, *(pa.array(got[c].astype(np.float64)) for c in MEASURES)], ["doc_id", "key", *BASE, "n_tokens", *MEASURES])

    kind = df.schema[id_col].dataType.simpleString()
    own = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("key"), text_bytes(text_col).alias("text"))
    return own.mapInArrow(run, ", ".join([f"doc_id {kind}, key string", *(f"{c} long" for c in (*BASE, "n_tokens")), *(f"{c} double" for c in MEASURES)]))


def bands(measured: DataFrame) -> DataFrame:
    """key, and for each measure its median (x_mid) and the band of its distance from it (x_low, x_high)."""
    told = measured.filter("n_tokens > 0")
    middle = told.groupBy("key").agg(*(F.percentile(F.floor(F.col(c) * GRAIN), F.lit(0.5)).alias(f"{c}_mid") for c in MEASURES))
    middle = cut(middle.select("key", *((F.col(f"{c}_mid") / GRAIN).alias(f"{c}_mid") for c in MEASURES)), "middle")
    far = _with(told, middle)
    quarters = far.groupBy("key").agg(*(F.percentile(F.floor(_distance(c) * GRAIN), F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in MEASURES))
    ends = []
    for c in MEASURES:
        low, high = F.col(c)[0] / GRAIN, F.col(c)[1] / GRAIN
        ends += [(low - FENCE * (high - low)).alias(f"{c}_low"), (high + FENCE * (high - low)).alias(f"{c}_high")]
    return cut(quarters.select("key", *ends).join(middle, "key"), "bands")


def _distance(c: str):
    """How far a measure is from its middle, in units of what is usual for so many tokens."""
    return (F.col(c) - F.col(f"{c}_mid")) / F.sqrt(1 / F.col("n_tokens") + F.lit(1 / STEADY))


def _with(measured: DataFrame, by_key: DataFrame) -> DataFrame:
    small = by_key.count() <= SMALL_BANDS
    return measured.join(F.broadcast(by_key) if small else by_key, "key", "left")


def judge(df: DataFrame, id_col: str, text_col: str, lang_col: str, model_file: str, ranks_file: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, key, n_tokens, and the measures with `outside`, those outside their bands."""
    measured = cut(measures(df, id_col, text_col, lang_col, model_file, ranks_file), "measured")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    beyond = []
    for c in MEASURES:
        low, high = _distance(c) < F.col(f"{c}_low"), _distance(c) > F.col(f"{c}_high")
        beyond.append(F.when({"both": low | high, "low": low, "high": high}[ENDS[c]], F.lit(c)))
    outside = F.when(F.col("n_tokens") > 0, F.array_compact(F.array(*beyond))).otherwise(F.array().cast("array<string>"))
    return _with(measured, bands(measured)).withColumn("outside", outside).select(
        "doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.size("outside") == 0)).alias("kept"), "key", "n_tokens", *MEASURES, "outside"
    )
