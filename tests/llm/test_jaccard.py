"""Jaccard groups against a comparison of all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import jaccard, simhash
from stowage.llm.common import cut
from tests.llm.cases import TEXTS, groups, words


def shingles(text, size=5):
    w = words((text or "").lower())
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b):
    return not a and not b or 5 * len(a & b) >= 4 * len(a | b)


def texts():
    """Copies with 0 to 16 of 200 words changed: pairs on both sides of 4/5, many of them near it; and what is
    awkward.
    """
    rng = np.random.default_rng(4)
    out = [t for _, t in TEXTS]
    for d in range(40):
        base = [f"t{x}" for x in rng.integers(0, 4000, 200)]
        for changes in (0, 2, 3, 4, 5, 6, 8, 12, 16):
            near = list(base)
            for at in rng.choice(200, changes, replace=False):
                near[at] = f"new{rng.integers(0, 10**6)}"
            out.append(" ".join(near))
    return out


@pytest.mark.parametrize("common", [8, 2])
def test_every_pair_of_four_fifths_is_linked_and_no_other(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    given = texts()
    rows = spark.createDataFrame(list(enumerate(given)), "n long, text string").repartition(3)
    got = {r["n"]: r["root"] for r in jaccard.groups(rows).collect()}
    assert [got[i] for i in range(len(given))] == list(groups([shingles(t) for t in given], alike))


def test_dense_groups_make_few_pairs(spark, monkeypatch, tmp_path):
    """2,000 copies of one text with a word changed are one group, from pairs in proportion to them."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[: i % 120] + [f"x{i}"] + base[i % 120 + 1 :])) for i in range(2_000)]
    made, verify = [], jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda pairs, *rest: made.append(pairs.count()) or verify(pairs, *rest))
    got = jaccard.groups(spark.createDataFrame(rows, "n long, text string"))
    assert got.filter(F.col("root") != 0).count() == 0
    assert sum(made) < 60_000


def test_sketches_lose_no_pair_and_long_texts_pass(spark, monkeypatch):
    """A text whose bins overflow a byte has no sketch; links given from outside are tested like others."""
    long = [f"w{i}" for i in range(70_000)]
    given = [
        " ".join(long), " ".join(long[:60_000]), " ".join(long[:30_000]), "a b c d e f", "a b c d e f g", "z y x w v u"
    ]
    rows = spark.createDataFrame(list(enumerate(given)), "n long, text string")
    known = spark.createDataFrame([(0, 1), (3, 5), (0, 2)], "a long, b long")
    got = {r["n"]: r["root"] for r in jaccard.groups(rows, known=known).collect()}
    assert [got[i] for i in range(len(given))] == list(groups([shingles(t) for t in given], alike))


def test_a_shared_passage_makes_few_buckets_and_no_pair_is_missed(spark, monkeypatch):
    """Texts of 130 words share passages of 50 two by two: many buckets of the same two texts become few."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    shared = [word(50) for _ in range(300)]
    rows = [(i, " ".join(word(40) + shared[i // 2] + word(40))) for i in range(600)]
    rows += [(600 + i, " ".join(shared[i] + word(3))) for i in range(40)]  # 46 of 49 shingles are a passage's
    rows += [(640 + i, " ".join(word(2) + shared[i])) for i in range(40)]  # 46 of 51
    buckets, merged = [], jaccard._buckets
    monkeypatch.setattr(jaccard, "_buckets", lambda tokens: buckets.append((tokens.groupBy("h").count().filter("count > 1").count(), (out := merged(tokens)).select("h").distinct().count())) or out)
    given = spark.createDataFrame(rows, "n long, text string")
    got = {r["n"]: r["root"] for r in jaccard.groups(given).collect()}
    assert [got[i] for i in range(680)] == list(groups([shingles(t) for _, t in rows], alike))
    assert buckets[0][1] * 2 < buckets[0][0]


def test_near_copies_that_are_not_alike_meet_by_their_differences(spark, monkeypatch):
    """Copies of one text, alike from three changed words on or fewer: most are alike to it, many to nobody, and some only to one copy,
    with which they share changes. They have buckets in common, but few pairs are made, and none is missed.
    """
    rng = np.random.default_rng(5)
    base, given = [f"w{i}" for i in range(150)], []
    changed = lambda text, n: [f"new{rng.integers(0, 10**9)}" if i in at else w for at in [set(rng.choice(150, n, replace=False))] for i, w in enumerate(text)]
    for k in range(200):
        given.append(changed(base, k % 4))
    for k in range(60):
        given.append(changed(base, 6))
    given += [changed(given[k], 1) for k in (3, 7, 11, 210, 211, 212, 250)]
    rows = [(i, " ".join(t)) for i, t in enumerate(given)]
    made, crossed = [], jaccard._crossed
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "_crossed", lambda buckets: made.append((out := crossed(buckets)).count()) or out)
    got = {r["n"]: r["root"] for r in jaccard.groups(spark.createDataFrame(rows, "n long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(groups([shingles(t) for _, t in rows], alike))
    assert sum(made) < 5_000  # of 35,511


def test_fingerprints_alone_link_what_sets_tell_apart(spark):
    """A sentence 200 times over with two tails: nearly all words are the same, and fewer than half of the different shingles."""
    tails = [" ".join(f"{c}{i}" for i in range(12)) for c in "xy"]
    given = ["one sentence that is said again and again today " * 200 + t for t in tails] + ["quite another text of a few words"]
    assert not alike(shingles(given[0]), shingles(given[1]))
    rows = cut(spark.createDataFrame(list(enumerate(given)), "n long, text string"), "rows")
    assert {r["n"]: r["root"] for r in simhash.near_copies(rows).collect()} == {0: 0, 1: 0, 2: 2}


def joined(spark, since):
    """The largest number of rows that a join has made in executions after the one of this number, and the last one's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    ids = [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]
    most = 0
    for k in (k for k in ids if k > since):
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size()) if "Join" in node.name()):
                if m.name() == "number of output rows" and (got := values.get(m.accumulatorId())).isDefined():
                    most = max(most, int(got.get().replace(",", "")))
    return most, max(ids)


def test_a_large_component_is_not_laid_out_for_each_point_it_meets(spark):
    """A bucket has a component of 600 points, and 300 points for themselves that only a few of them may be alike to. The bounds of the
    component let it meet each point; no join makes more rows than there are pairs that may be alike.
    """
    rng = np.random.default_rng(6)
    draw = lambda n, c, rest, need: [(1, c or n + i, n + i, int(s), int(r), need) for i, (s, r) in enumerate(zip(rng.integers(90, 111, len(rest)), rest))]
    rows = draw(1000, 1000, rng.integers(5, 20, 600), 34) + draw(2000, 2000, [60, 8], 400) + draw(3000, 0, rng.integers(25, 42, 300), 520)
    rows[7] = (*rows[7][:4], 40, 34)
    rows += [(2, *r[1:]) for r in rows[590:640]]
    buckets = cut(spark.createDataFrame(rows, "h long, c long, p long, size long, rest long, need long"), "still")
    want, made = set(), 0
    for i, (h, c, p, size, rest, need) in enumerate(rows):
        for h2, c2, p2, size2, rest2, need2 in rows[:i]:
            if h == h2 and c != c2 and 5 * min(size, size2) >= 4 * max(size, size2) and 18 * min(rest, rest2) >= need + need2:
                want.add((min(p, p2), max(p, p2)))
                made += 1
    _, before = joined(spark, 10**9)
    got = {(r["a"], r["b"]) for r in jaccard._crossed(buckets).collect()}
    assert got == want and 100 < len(want) < 1_000
    assert joined(spark, before)[0] <= 2 * made
