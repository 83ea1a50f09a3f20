"""Operators 11 to 13 on awkward rows and on the smallest tables, against plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from stowage.llm import collocations, fertility, lexical
from stowage.llm.queries import QUERIES
from tests.llm.cases import LONG, PASSAGE, SMALL, TEXTS, awkward, words

PIECES, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- 11


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text))


def plain_search(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(terms(text))
    out = []
    for item, bag in asked.items():
        found = []
        for doc, b in bags:
            m = 100 - 75 + (75 * b.total() * n_docs) // max(1, n_terms)
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, times in bag.items() if b[t])
            if score > 0:
                found.append((-score, doc is not None, doc or 0))
        out += [(item, r, doc if known else None, -s) for r, (s, known, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [
    (1, "Alpha beta beta, gamma! w1 w2 w3 w59"), (2, None), (3, "no-such-term"), (4, "naïve CAFÉ 日本語 alpha"), (None, "lorem ipsum word"),
    (5, PASSAGE + " alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (1, "delta"),
]


def got_rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_search_of_awkward_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit("clash"))
    docs = awkward(spark)
    want = plain_search(TEXTS, ITEMS, 10)
    assert got_rows(lexical.ranked(docs, items, "doc_id", "text", "item_id", "text")) == want
    assert got_rows(lexical.ranked(docs, items, "doc_id", "text", "item_id", "text", entries=20)) == want  # in several blocks
    assert lexical.ranked(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert lexical.ranked(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_search_skips_documents_and_stays_exact(monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(90)]
    weights = [1 / (i + 1) for i in range(90)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(900)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 80)))) for i in range(12)]
    monkeypatch.setattr(lexical, "STEP", 16)
    bags = [Counter(terms(t)) for _, t in docs]
    names = sorted({t for _, x in items for t in terms(x)})
    df = np.array([sum(t in b for b in bags) for t in names])
    asked = [(i, names.index(t), n) for i, (_, x) in enumerate(items) for t, n in Counter(terms(x)).items()]
    block = lexical.Items(*(np.array(x) for x in zip(*asked)), df, len(docs), sum(b.total() for b in bags))
    search = lexical.Search(block, 10)
    for lo in range(0, 900, 300):
        rows = [(names.index(t), d, n) for d in range(300) for t, n in bags[lo + d].items() if t in names]
        rows.sort()
        term, doc, tf = (np.array(x) for x in zip(*rows))
        first = np.flatnonzero(np.diff(term, prepend=-1))
        cells = {
            "ids": np.arange(lo, lo + 300), "known": np.ones(300, np.uint8), "lengths": np.array([b.total() for b in bags[lo : lo + 300]]),
            "terms": term[first].astype("<i4"), "first": np.append(first, len(term)).astype("<i4"), "doc": doc.astype("<u2"), "tf": tf.astype("<u4"),
        }
        search.shard({k: memoryview(v.tobytes()) for k, v in cells.items()})
    item, ids, score = search.rows()
    want = [(i, d, s) for i, _, d, s in sorted(plain_search(docs, items, 10))]
    assert sorted(zip(item.tolist(), ids.to_pylist(), score.tolist())) == sorted(want)
    assert search.evaluated < 12 * 900 / 2


# -- 12


def plain_base(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, inside = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def plain_measures(text, pieces, ranks):
    """(tokens, the four measures) of a text with a word."""
    ids, n_bytes, chars = [], 0, 0
    for w in words(text):
        ids += pieces.encode(w)
        n_bytes += len(ranks.encode_ordinary(" " + w))
        chars += len(w)
    n = len(ids)
    s = max(1, (n + 32) // 64)
    stretches = defaultdict(Counter)
    for i, t in enumerate(ids):
        stretches[i * s // n][t] += 1
    shares = []
    for c in stretches.values():
        size = c.total()
        shares.append(1.0 if size < 2 else -sum(x / size * math.log2(x / size) for x in c.values()) / math.log2(size))
    return n, (chars / n, chars / n_bytes, sum(pieces.is_byte(i) for i in ids) / n, sum(shares) / len(shares))


def judge(df):
    return fertility.judge(df, "doc_id", "text", "lang", PIECES, RANKS)


def test_base_rules_of_awkward_rows(spark):
    rng = random.Random(2)
    more = [(100 + i, " ".join(rng.choices("abcdef", k=rng.randrange(4, 60))) + "\n" + rng.choice(["x y\nx y", "\n\n", "| a <b>"])) for i in range(60)]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    both = awkward(spark).select("doc_id", "text").unionByName(extra)
    got = judge(both.withColumn("lang", F.lit(None).cast("string")).withColumn("key", F.lit("clash")).repartition(3)).collect()
    want = Counter((i, *plain_base(t)) for i, t in TEXTS + more)
    assert Counter((r.doc_id, *(r[c] for c in fertility.BASE), r.base_failed) for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)
    assert {r.key for r in got if r.doc_id == 3} == {"script:none"} and {r.key for r in got if r.doc_id == 6} == {"script:latin"}
    assert judge(both.limit(0).withColumn("lang", F.lit("x"))).count() == 0


def test_measures_and_bands_are_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    strange = [(9001, "Ω≈ç√∫ 東京 ﷽ 𓀀𓀁 " * 9, "en"), (9002, "kxqz vvvw jjkq zzxw qqqk " + " ".join(f"{i:x}zq" for i in range(40)), "en"), (9003, "東京 日本 " * 3 + "x", None)]
    extra = spark.createDataFrame(strange, "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").unionByName(extra)
    got = {r.doc_id: r for r in judge(rows).collect()}
    pieces, ranks = sentencepiece.SentencePieceProcessor(model_file=PIECES), fertility.vocabularies(open(PIECES, "rb").read(), open(RANKS, "rb").read()).bytewise
    told = {}
    for r in rows.collect():
        if words(r.text):
            n, measured = plain_measures(r.text, pieces, ranks)
            assert got[r.doc_id].n_tokens == n and np.allclose([got[r.doc_id][c] for c in fertility.MEASURES], measured)
            told[r.doc_id] = (got[r.doc_id].key, n, [got[r.doc_id][c] for c in fertility.MEASURES])
    grain, outside = fertility.GRAIN, defaultdict(set)
    for key in {k for k, _, _ in told.values()}:
        own = [d for d in told if told[d][0] == key]
        for c, name in enumerate(fertility.MEASURES):
            middle = np.percentile([math.floor(told[d][2][c] * grain) for d in own], 50) / grain
            far = {d: (told[d][2][c] - middle) / math.sqrt(1 / told[d][1] + 1 / fertility.STEADY) for d in own}
            low, high = (np.percentile([math.floor(x * grain) for x in far.values()], p) / grain for p in (25, 75))
            room = fertility.FENCE * (high - low)
            for d, x in far.items():
                if x < low - room and fertility.ENDS[name] != "high" or x > high + room and fertility.ENDS[name] != "low":
                    outside[d].add(name)
    assert {d: set(r.outside) for d, r in got.items() if r.outside} == dict(outside)
    assert all(r.kept == (not r.base_failed and not r.outside) for r in got.values())
    assert not got[9002].kept and "fallback_share" in got[9001].outside


def test_good_documents_stay_and_symbol_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    told = QUERIES["op12_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("not base_failed").toPandas()
    good, bad = told[told.quality == 1], told[told.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.4
    assert docs.count() == 1000


def test_long_runs_are_measured_whole():
    vocabularies = fertility.vocabularies(open(PIECES, "rb").read(), open(RANKS, "rb").read())
    for text in (" " * 1_200_000 + "x", "\n" * 1_200_000, "a" * 300_000, LONG):
        raw = np.frombuffer(text.encode(), np.uint8)
        got = fertility._measure(raw, np.array([0, len(raw)]), vocabularies)
        assert [int(got[c][0]) for c in fertility.BASE] == list(plain_base(text))[:5]


# -- 13


def plain_collocations(docs, least, most):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    often = {p: c for p, c in f.items() if c >= least}
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        inside = any(q[0] == lang and len(q[1]) > len(p) and c >= a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]) - len(p) + 1)) for q, c in often.items())
        if not inside:
            score, cut = min((1000 * a * n[lang] // (f[lang, p[:j]] * f[lang, p[j:]]), j) for j in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    return {lang: [(r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1)] for lang, rows in out.items() if rows}


@pytest.mark.parametrize(("shards", "bits"), [(1, 25), (2, 4), (5, 12)])
def test_collocations_are_those_of_a_plain_count(spark, shards, bits):
    rng = random.Random(shards)
    stock = ["in the end", "New York city", "a b c d e f", "so it goes", "naïve é", "x", "y", "z", "to be or not to be"]
    docs = [("".join(f"{rng.choice(stock)}{rng.choice([' ', ' ', '  ', chr(9), ', ', chr(10)])}" for _ in range(rng.randrange(0, 40))), rng.choice(["en", "en", "fr", None])) for _ in range(120)]
    docs += [(None, "en"), ("", "de"), (" . ,; ", "de"), (LONG[:40_000], "la"), ("w " * 3000, "w"), ("tab\x0bsplit\x0ctoo", "en")]
    df = spark.createDataFrame(docs, "text string, lang string").withColumn("phrase", F.lit("clash")).withColumn("shard", F.lit(9)).repartition(3)
    got = defaultdict(list)
    for r in collocations.top_collocations(df, "text", "lang", least=12, most=25, shards=shards, bits=bits).orderBy("lang", "rank").collect():
        got[r.lang].append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert dict(got) == plain_collocations(docs, 12, 25)


def test_collocations_of_an_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.top_collocations(df, "text", "lang").count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**13
    frequent = spark.createDataFrame([("x", "a", 1, big + 7), ("x", "b", 1, big + 3), ("x", "a b", 2, big - 11)], "lang string, phrase string, k int, n long")
    totals = spark.createDataFrame([("x", 10**16 + 1)], "lang string, n long")
    row = collocations.score_phrases(frequent, totals).first()
    assert row.score == 1000 * (big - 11) * (10**16 + 1) // ((big + 7) * (big + 3))
