"""Operator 10: a quality classifier, logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader.

A text is cut into runs of letters and digits and runs of signs. Features are the hashed n-grams of one and two runs,
of one to
three run shapes (capitals, lower case, digits, the signs themselves), and of whether a run repeats the one before. A
feature's value is
its count over the number of runs. Training is FTRL-Proximal (per-coordinate rates, L1 and L2) over at most `sample`
labelled
texts of at most `sample_bytes` in all, documented bounds, in an order set by hash; each text is taken whole. A score
is one sparse dot product, taken on the executors in vectorised runs.

Defined cases: null and empty texts have only the constant feature, hence a fixed score; rows without a label train
nothing; with no labels at all
every score is 0.5; repeated labels of one id count once, the smaller; of several texts of one labelled id the smallest
trains. For scores repeated rows and ids
are rows of their own, a text of any length is read whole, and only id and text are read, so extra columns can't clash.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm import kernels as K
from stowage.llm.common import cut, drop, text_bytes

BITS = 18
CONSTANT = 1 << BITS
SCALE = 8.0

_KIND = np.full(256, 1, np.uint8)  # 1 letters and digits, 2 signs, 0 white space
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
_SHAPE = np.full(256, 1, np.uint8)  # bits: lower case or other letter, capital, digit
_SHAPE[65:91] = 2
_SHAPE[48:58] = 4


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, document, runs of each document)."""
    starts, ends, first = K.spans(raw, offsets, _KIND)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    words = K.word_hashes(raw, starts, ends)
    shape_bits = np.zeros(0, np.int64)
    if len(starts):
        marks = np.zeros((len(raw) + 1, 3), np.int32)
        for k in range(3):
            np.cumsum(_SHAPE[raw] == 1 << k, out=marks[1:, k])
        have = (marks[ends] - marks[starts]) > 0
        first_capital = _SHAPE[raw[starts]] == 2
        rest_capital = (marks[ends, 1] - marks[starts, 1]) > 1
        shape_bits = have @ np.array([1, 2, 4]) + 8 * first_capital + 16 * rest_capital
    signs = _KIND[raw[starts]] == 2 if len(starts) else np.zeros(0, bool)
    size = np.minimum(ends - starts, 4)
    shapes = K.mix(
        np.where(signs, words, (shape_bits * 8 + np.where(signs, size, 0)).astype(np.uint64)) + np.uint64(77)
    )
    left = np.repeat(first[1:], n) - np.arange(len(words))
    same = np.zeros(len(words), np.uint64)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    found = []
    for kind, values, longest in ((0, words, 2), (1, shapes, 3)):
        for m in range(1, longest + 1):
            ok = left >= m
            found.append((K.ngram_hashes(values, m)[ok] + np.uint64(1000 * kind + m), doc[ok]))
    found.append((same + np.uint64(5000), doc))
    mask = np.uint64((1 << BITS) - 1)
    return np.concatenate(
        [K.mix(h) & mask for h, _ in found]
    ).astype(np.int64), np.concatenate([d for _, d in found]), n


class Ftrl:
    """FTRL-Proximal for sparse examples."""

    def __init__(self, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(CONSTANT + 1), np.zeros(CONSTANT + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(
            np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        )

    def learn(self, at: np.ndarray, value: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value * weight
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    sample: int = 6_000,
    epochs: int = 4,
    sample_bytes: int = 64 << 20,
) -> np.ndarray | None:
    """Weights from at most `sample` texts of df that have a label 0 or 1, and no more than fill `sample_bytes`, the
    first whatever its size.
    """
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("_mark"))
    n = marks.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(id_col, F.lit(13)), F.lit(1_000_000))
    few = marks.withColumn("_draw", draw).filter(F.col("_draw") < int(min(1.0, 1.2 * sample / n) * 1_000_000))
    drawn = few.orderBy("_draw", id_col).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = K.flat(batch.column(2))
            for lo, hi in K.parts(at, K.CHUNK):
                feature, doc, runs = features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                order = np.argsort(doc, kind="stable")
                feature, bounds = feature[order], np.searchsorted(doc[order], np.arange(hi - lo + 1))
                ids, counts = [], []
                for a, b, r in zip(bounds, bounds[1:], runs.tolist()):
                    i, c = np.unique(feature[a:b], return_counts=True)
                    ids.append(i.astype("<i4").tobytes())
                    counts.append((c / max(1, r)).astype("<f4").tobytes())
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                    ["draw", "mark", "feature", "value"],
                )

    # the broadcast side has at most `sample` rows of an id and two numbers
    labelled = df.join(F.broadcast(drawn), id_col).select(
        "_draw", F.col(id_col).alias("id"), F.col("_mark").cast("int").alias("mark"), text_bytes(text_col).alias("text")
    )
    texts = cut(labelled.groupBy("_draw", "id", "mark").agg(F.min("text").alias("text")), "labelled")
    upto = F.sum(F.octet_length("text")).over(Window.orderBy("_draw", "id"))  # over at most `sample` rows
    within = texts.select(
        "id", (upto - F.octet_length("text")).alias("before"), upto.alias("upto")
    ).filter((F.col("upto") <= sample_bytes) | (F.col("before") == 0))
    rows = texts.join(F.broadcast(within.select("id")), "id", "left_semi").select("_draw", "mark", "text")
    got = rows.mapInArrow(run, "draw long, mark int, feature binary, value binary").toArrow()
    drop(texts)
    draws, marks_of = got.column("draw").to_pylist(), got.column("mark").to_pylist()
    at, values = got.column("feature"), got.column("value")
    order = sorted(range(len(draws)), key=lambda i: (draws[i], marks_of[i], at[i].as_py(), values[i].as_py()))
    examples = [(marks_of[i], at[i].as_buffer(), values[i].as_buffer()) for i in order]
    if not examples:
        return None
    good = sum(m for m, _, _ in examples)
    weight = {1: len(examples) / (2 * max(1, good)), 0: len(examples) / (2 * max(1, len(examples) - good))}
    model, shuffle = Ftrl(), np.random.default_rng(17)
    for _ in range(epochs):
        for k in shuffle.permutation(len(examples)):
            mark, at, value = examples[k]
            model.learn(
                np.append(np.frombuffer(at, "<i4"), CONSTANT),
                np.append(np.frombuffer(value, "<f4") * SCALE, 1.0),
                mark,
                weight[mark],
            )
    return model.weights().astype(np.float32)


def score(df: DataFrame, weights: np.ndarray | None, id_col: str, text_col: str) -> DataFrame:
    """id, score: how likely label 1 is."""
    shared = df.sparkSession.sparkContext.broadcast(np.zeros(CONSTANT + 1, np.float32) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = K.flat(batch.column(1))
            w, out = shared.value, []
            for lo, hi in K.parts(at, K.CHUNK):
                feature, doc, runs = features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                total = np.bincount(doc, weights=w[feature], minlength=hi - lo)
                out.append(SCALE * total / np.maximum(1, runs) + w[CONSTANT])
            margin = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))), pa.float64())],
                [id_col, "score"],
            )

    return df.select(id_col, text_bytes(text_col).alias("_text")).mapInArrow(
        run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, score double"
    )
