"""Operator 6: language identification, family first, then one-versus-one linear support vector machines inside it.

A text is a bag of byte trigrams over lower-cased letters (all else is one blank), hashed and taken relative to its
number. A one-versus-one vote of linear SVMs chooses the family; within a family of several languages another
one-versus-one vote chooses the language, so machines only ever separate what is close. Languages of no known family
are one family together.

The machines are fitted on at most `sample` labelled texts (a documented bound, chosen by hash within each language) of
at most `languages`
languages, those with most texts (a documented bound too, since machines grow with its square), with the squared hinge
loss and a fixed number of
accelerated gradient steps. All machines are one weight matrix, so scoring reads
each byte of a text once, on the executors.

Defined cases: a null text, or one without a letter (a character of Unicode's letter categories), is `und` with score
0; with no labelled text everything
is `und`; with a single language everything else is that language. Names with equal votes are told apart by the sum of
their margins, then by
order. Repeated rows and ids are rows of their own, and a text of any length is read whole. An empty table gives no
rows. Only id, text and label columns are read,
so extra columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm import kernels as K
from stowage.llm.common import text_bytes

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BUCKETS = 8_192
ASCII_LETTER = re.compile(rb"[A-Za-z]")
SCALE = 100.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of the trigrams of all documents that have a letter in the middle; documents begin and end in
    a blank.
    """
    x = _FOLD[raw]
    upper = np.zeros(len(x), bool)
    upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)  # accented capitals of Latin-1
    x = x + 32 * upper.astype(np.uint8)
    before, after = np.full(len(x), 32, np.uint32), np.full(len(x), 32, np.uint32)
    before[1:], after[:-1] = x[:-1], x[1:]
    edge = offsets[offsets < len(x)]
    before[edge] = 32
    after[edge[edge > 0] - 1] = 32
    at = np.flatnonzero(x != 32)
    code = ((before[at] << 16) | (x[at].astype(np.uint32) << 8) | after[at]) * np.uint32(2_654_435_761)
    return (code >> np.uint32(19)).astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def has_letter(text: bytes) -> bool:
    return ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace")))


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Weights of a linear SVM: squared hinge loss, accelerated gradient descent. The last column of x is the constant
    one.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.random.default_rng(3).random(x.shape[1]).astype(np.float32)
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        top = float(np.linalg.norm(v))
        v /= top or 1
    rate = np.float32(1 / (2 * top + penalty))
    w = np.zeros(x.shape[1], np.float32)
    last = w
    for t in range(steps):
        z = w + np.float32(t / (t + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ z))
        last, w = w, z - rate * (-2 * (x.T @ (weight * y * slack)) + np.float32(penalty) * z)
    return w


def _packed(bag: np.ndarray) -> bytes:
    """A bag without its empty buckets: their numbers, then as many values of two bytes."""
    at = np.flatnonzero(bag)
    return at.astype("<u2").tobytes() + bag[at].astype("<f2").tobytes()


def _dense(bags: list[bytes], rows: np.ndarray) -> np.ndarray:
    """Some of the bags as rows of a matrix, with the constant one."""
    x = np.zeros((len(rows), BUCKETS + 1), np.float32)
    for k, i in enumerate(rows.tolist()):
        half = len(bags[i]) // 2
        x[k, np.frombuffer(bags[i][:half], "<u2")] = np.frombuffer(bags[i][half:], "<f2")
    x *= np.float32(SCALE)
    x[:, -1] = 1
    return x


class Model:
    """All machines as one matrix (buckets x machines) with constants, and what each decides between."""

    def __init__(self, bags: list[bytes], labels: list[str]) -> None:
        self.languages = sorted(set(labels))
        family = lambda code: FAMILY_OF.get(code, "other")
        self.families = {
            f: [c for c in self.languages if family(c) == f] for f in sorted({family(c) for c in self.languages})
        }
        self.machines: list[tuple[str, str, str]] = [("", a, b) for a, b in combinations(self.families, 2)]
        self.machines += [(f, a, b) for f, codes in self.families.items() for a, b in combinations(codes, 2)]
        own = np.array(labels)
        kin = np.array([family(c) for c in labels])
        columns = []
        for group, a, b in self.machines:
            of = own if group else kin
            rows = np.flatnonzero((of == a) | (of == b))
            columns.append(_svm(_dense(bags, rows), np.where(of[rows] == a, 1, -1).astype(np.float32)))
        self.weights = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros(
            (BUCKETS + 1, 0), np.float32
        )

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[str, float]]:
        n = len(offsets) - 1
        bucket, doc = trigrams(raw, offsets)
        bounds = np.searchsorted(doc, np.arange(n + 1))
        margins = np.stack(
            [K.doc_sums(self.weights[bucket, m], bounds) for m in range(len(self.machines))], axis=1
        ) if self.machines else np.zeros((n, 0))
        margins = SCALE * margins / np.maximum(1, np.diff(bounds))[:, None] + self.weights[-1]
        return [self._decide(row) for row in margins]

    def _decide(self, margins: np.ndarray) -> tuple[str, float]:
        name, sure = self._vote("", list(self.families), margins)
        if len(self.families[name]) > 1:
            language, inner = self._vote(name, self.families[name], margins)
            return language, min(sure, inner)
        return self.families[name][0], sure

    def _vote(self, group: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The name with most votes, then the largest sum of margins; and how sure its weakest win is."""
        votes, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        weakest = dict.fromkeys(names, np.inf)
        for (g, a, b), m in zip(self.machines, margins.tolist()):
            if g == group:
                votes[a if m >= 0 else b] += 1
                for name, own in ((a, m), (b, -m)):
                    total[name] += own
                    weakest[name] = min(weakest[name], own)
        best = max(names, key=lambda c: (votes[c], total[c]))
        return best, float(1 / (1 + np.exp(-3 * min(weakest[best], 20.0))))


def fit(
    df: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = 2_400, languages: int = 200
) -> Model | None:
    """A model of at most `sample` labelled rows of the `languages` commonest languages, as many of each where there
    are enough. None without labels.
    """
    known = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {
        r[0]: r[1] for r in known.groupBy(label_col).count().orderBy(
            F.col("count").desc(), label_col
        ).limit(min(languages, sample)).collect()
    }
    if not counts:
        return None
    each = max(1, sample // len(counts))
    draw = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1_000_000))
    share = F.create_map(*[F.lit(v) for label, n in counts.items() for v in (label, min(1.0, 1.5 * each / n))])
    rows = known.withColumn("_draw", draw).filter(
        F.col("_draw") < F.lit(1_000_000) * F.coalesce(share[F.col(label_col)], F.lit(0.0))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = K.flat(batch.column(2))
            for lo, hi in K.parts(at, K.CHUNK):
                bucket, doc = trigrams(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                bags = [np.bincount(bucket[a:b], minlength=BUCKETS).astype(np.float32) / max(1, b - a) for a, b in zip(bounds, bounds[1:])]
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        some.column(1),
                        pa.array([_packed(b) if b.any() else None for b in bags], pa.binary()),
                    ],
                    ["draw", "label", "bag"],
                )

    bags = rows.select(
        "_draw", F.col(label_col).alias("label"), text_bytes(text_col).alias("text")
    ).mapInArrow(run, "draw long, label string, bag binary").filter("bag is not null")
    taken = bags.withColumn(
        "r", F.row_number().over(Window.partitionBy("label").orderBy("draw", F.xxhash64("bag")))
    ).filter(F.col("r") <= each)
    got = taken.select("label", "draw", "bag").toArrow()
    if not got.num_rows:
        return None
    # bags stay packed; only what one machine is fitted on is a matrix
    labels, draws, bag = got.column("label").to_pylist(), got.column("draw").to_pylist(), got.column("bag").to_pylist()
    del got
    order = sorted(range(len(labels)), key=lambda i: (labels[i], draws[i], bag[i]))
    return Model([bag[i] for i in order], [labels[i] for i in order])


def predict(df: DataFrame, model: Model | None, id_col: str, text_col: str) -> DataFrame:
    """id, lang_pred, score for each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = K.flat(batch.column(1))
            for lo, hi in K.parts(at, K.CHUNK):
                part = raw[at[lo] : at[hi]]
                offsets = at[lo : hi + 1] - at[lo]
                data = part.tobytes()
                lettered = [has_letter(data[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                said = shared.value.predict(part, offsets) if shared.value else [("und", 0.0)] * (hi - lo)
                said = [s if ok else ("und", 0.0) for s, ok in zip(said, lettered)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([s[0] for s in said], pa.string()),
                        pa.array([s[1] for s in said], pa.float64()),
                    ],
                    [id_col, "lang_pred", "score"],
                )

    return df.select(id_col, text_bytes(text_col).alias("_text")).mapInArrow(
        run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double"
    )
