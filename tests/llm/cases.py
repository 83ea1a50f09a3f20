"""Tables that every operator must handle, and plain versions of what they compute."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SMALL = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
PASSAGE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"),
    (3, None),
    (4, ""),
    (5, " \t\r\n\x0b\x0c "),
    (6, "word"),
    (7, f"before {PASSAGE} after"),
    (8, f"other start {PASSAGE} other end"),
    (9, LONG),
    (None, PASSAGE),
    (10, None),
    (11, "naïve café – “quoted” 日本語 \U0001f600 ÀÉ"),
    (12, "BM RIFF GIF89a \x89PNG <|endoftext|> </s> <0x41> ▁▁ x"),
    (13, "a" * 5000),
]


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, and columns whose names clash with the operators'
    own.
    """
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    from pyspark.sql import functions as F

    clash = [
        "id",
        "key",
        "h",
        "fingerprint",
        "component_id",
        "n_bytes",
        "root",
        "cell",
        "a",
        "b",
        "gone",
        "score",
        "sequence_id",
        "_text",
        "word",
    ]
    return df.withColumns({c: F.lit("clash") for c in clash}).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text, size=4):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(w)
    if not w:
        return 0
    h = np.array(
        [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))],
        "<u8",
    )
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def groups(points, linked):
    """The smallest reachable of each point, by comparing all."""
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(points)):
        for j in range(i):
            if linked(points[i], points[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]
