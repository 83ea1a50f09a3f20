"""The corpus pipeline, stage by stage, against plain versions of what each stage must do."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import LONG, words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the output of each stage, with planted documents."""
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passage = " ".join(f"plant{i}ed" for i in range(70))
    base = docs.filter("doc_id = 31").first()["text"]
    planted = [
        (100_001, base),
        (100_002, base.replace(" the ", " the extra ", 1)),
        (100_003, f"Erinst resh. {passage} Thorou the ind."),
        (100_004, f"Of and the with. {passage} To onin."),
        (100_005, "12345 67890"),
        (100_006, None),
        (100_007, ""),
    ]
    extra = spark.createDataFrame([(i, t, "en", "plant", len(t or "")) for i, t in planted], docs.schema)
    given, out = docs.unionByName(extra), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(root / str(k))
        stage(spark, given, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, given.toPandas(), after.toPandas()))
        given = after
    return out, passage


def test_columns_and_rows(stages):
    for name, before, after in stages[0][:-1]:
        assert list(after.columns) == corpus_pipeline.COLUMNS, name
        assert set(after.doc_id) <= set(before.doc_id), name


def test_quality_keeps_what_is_labelled_good(spark, stages):
    _, before, after = stages[0][0]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    kept = labels[labels.doc_id.isin(before.doc_id)].assign(kept=lambda d: d.doc_id.isin(after.doc_id))
    assert kept[kept.quality == 1].kept.mean() > 0.98
    assert kept[kept.quality == 0].kept.mean() < 0.05


def test_language_rejects_what_has_no_letter(stages):
    _, before, after = stages[0][1]
    assert not {100_005, 100_006, 100_007} & set(after.doc_id)
    lettered = before[before.text.fillna("").str.contains("[a-zA-Z]")]
    assert set(lettered.doc_id) == set(after.doc_id)


def test_one_of_each_group_of_copies_stays(stages):
    """By a comparison of all pairs that share a shingle: the smallest id of each group of 4/5 stays, and nothing else."""
    _, before, after = stages[0][2]
    sets = {}
    for r in before.itertuples():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holders = defaultdict(list)
    for ident, own in sets.items():
        for x in own:
            holders[x].append(ident)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[:k]}
    for a, b in pairs:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {100_001, 100_002}.isdisjoint(after.doc_id) and sorted(after.doc_id) == sorted({find(i) for i in sets})


def test_repeated_passages_are_cut_and_nothing_else(stages):
    out, passage = stages
    _, before, after = out[3]
    was, now = dict(zip(before.doc_id, before.text)), dict(zip(after.doc_id, after.text))
    assert set(was) == set(now)
    first = {}
    for ident in sorted(was):
        w = words(was[ident])
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), ident)
    for ident, text in was.items():
        w, gone = words(text), set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < ident:
                gone.update(range(i, i + 50))
        assert words(now[ident]) == [x for i, x in enumerate(w) if i not in gone]
        if not gone:
            assert now[ident] == text
    if 100_003 in was and 100_004 in was:
        assert passage in now[100_003]
        assert "plant5ed" not in now[100_004]
    assert (after.n_chars == after.text.str.len()).all()


def test_all_that_is_left_is_packed(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    _, before, after = stages[0][4]
    tokens = after.groupby("doc_id").length.sum()
    assert {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in zip(before.doc_id, before.text)} == tokens.to_dict()
    assert after.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_take_empty_and_awkward_tables(spark):
    """Nulls in every column, repeated rows, an empty and a very long text, and extra columns; each stage on its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = "Of and the with, to onin thorou."
    odd = spark.createDataFrame(
        [
            (None, None, None, None, None),
            (1, short, "en", "s", 3),
            (1, short, "en", "s", 3),
            (2, LONG, None, None, None),
            (3, "", "en", "s", 0),
        ],
        docs.schema,
    )
    clash = {
        "score": F.lit(1),
        "row": F.lit(2),
        "n": F.lit(3),
        "id": F.lit("x"),
        "a": F.lit(4),
        "copy": F.lit(True),
        "gone": F.lit(5),
        "_null": F.lit(6),
    }
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0).withColumns(clash), SF).count() == 0, name
    got = {name: stage(spark, odd.withColumns(clash), SF).toPandas() for name, stage in stages.items()}
    ids = {name: Counter("null" if x != x or x is None else int(x) for x in df.doc_id) for name, df in got.items()}
    given = Counter(["null", 1, 1, 2, 3])
    assert not ids["quality classifier"] - given
    assert not ids["language id"] - Counter([1, 1, 2])
    assert ids["simhash near-dedup"] == Counter([1, 2, 3])  # null and empty texts are alike, and an id is preferred to none
    assert ids["substring dedup"] == given
    assert set(ids["best-fit packing"]) == set(given)
    cut = got["substring dedup"]
    assert sorted(cut.text.fillna("(null)")) == sorted(["(null)", short, short, LONG, ""])
    for name in list(stages)[:-1]:
        assert list(got[name].columns) == corpus_pipeline.COLUMNS, name


def test_near_copies_are_those_of_four_fifths_and_one_row_of_a_shared_id_stays(spark):
    base = [f"w{i}" for i in range(204)]  # 200 shingles; a word changed inside takes five of them
    changed = lambda n, tag: " ".join(f"{tag}{i}" if i % 10 == 5 and i // 10 < n else w for i, w in enumerate(base))
    texts = [
        (7, changed(0, "a")),
        (9, changed(4, "b")),
        (20, changed(0, "a").replace("w", "v")),
        (21, changed(5, "c").replace("w", "v")),
        (30, "one and the same text of a shared id"),
        (30, "one and the same text of a shared id"),
        (None, "a text without an id, told twice over"),
        (None, "a text without an id, told twice over"),
    ]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in texts],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    got = sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert got == ["20", "21", "30", "7", "None"]  # 180 of 220 shingles are 0.82, 175 of 225 are 0.78


def test_language_rejects_gibberish_and_unlearned_languages(spark):
    rng = random.Random(1)
    noise = [
        " ".join(
            "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(150)
        ) for _ in range(5)
    ]
    foreign = [
        "Привет мир это русский текст о погоде и природе. " * 10,
        "<div class='x'><span id='q1'></span></div><td><tr> " * 40,
    ]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    extra = spark.createDataFrame(
        [(10_000_000 + i, t, None, "plant", len(t)) for i, t in enumerate(noise + foreign)], docs.schema
    )
    stay = {r[0] for r in corpus_pipeline.keep_languages(spark, docs.unionByName(extra), SF).select("doc_id").collect()}
    assert not [i for i in range(len(noise + foreign)) if 10_000_000 + i in stay]
    assert len(stay) > 0.99 * docs.filter("text rlike '[a-zA-Z]'").count()
