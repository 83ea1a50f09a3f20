"""Each operator on awkward rows and on the smallest tables, against plain versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stowage.llm import bm25, components, langid, media, packing, piece_bpe, quality, sharding, simhash, substring, warc
from stowage.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import values
from tests.llm.cases import SMALL, TEXTS, awkward, groups, simhash as plain_simhash, words

RANKS, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    said = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in said.description]
    assert values(got.collect(), got.columns) == values(said.fetchall(), columns)


def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# -- 1


@pytest.mark.parametrize("bits", [3, 20])
def test_shards_fit(spark, bits):
    rows = [(1, "x" * 50)] * 60 + [(2, f"{i:050d}") for i in range(60)] + [(i, "y" * 30) for i in range(10, 80)] + [
        (None, None), (None, "z"), (500, "g" * 5000), (501, "")
    ]
    df = spark.createDataFrame(
        rows, "doc_id long, text string"
    ).withColumn("root", F.lit("clash")).withColumn("h", F.lit("clash"))
    got = sharding.assign_shards(df, "doc_id", "text", 400, bits).toPandas()
    assert Counter(got.n_bytes) == Counter(len(t or "") for _, t in rows)
    for _, g in got.groupby(["shard_prefix", "shard_part"]):
        assert g.n_bytes.sum() <= 400 or len(g) == 1
        assert g.n_bytes.sum() == g.shard_bytes.iloc[0]
        assert len(g) == g.shard_rows.iloc[0]
    assert sharding.assign_shards(df.limit(0), "doc_id", "text", 400).count() == 0


# -- 2


def test_near_duplicates_are_exact(spark):
    got = simhash.near_duplicates(awkward(spark), "doc_id", "text").toPandas()
    prints = {f"{plain_simhash(t):016x}" for _, t in TEXTS}
    assert set(got.fingerprint) == prints
    points = sorted(prints)
    root = groups(points, lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1") <= 4)
    least = {}
    for ident, text in TEXTS:
        r = root[points.index(f"{plain_simhash(text):016x}")]
        if ident is not None:
            least[r] = min(ident, least.get(r, ident))
    for row in got.itertuples():
        expected = least.get(root[points.index(row.fingerprint)])
        assert row.component_id == expected or (expected is None and np.isnan(row.component_id))
    assert simhash.near_duplicates(awkward(spark).limit(0), "doc_id", "text").count() == 0


def test_trees_find_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    points = set(base.tolist())
    for x in base[:120].tolist():
        for flips in (1, 3, 4, 5):
            for b in rng.choice(64, flips, replace=False):
                x ^= 1 << int(b)
            points.add(x)
    points = sorted(points)
    df = spark.createDataFrame([(bytearray(p.to_bytes(8, "big")),) for p in points], "fingerprint binary")
    edges = simhash.link(df, simhash.block_masks(1, 3), 1, 4, leaf=16)
    got = components.components(edges).collect()
    root = groups(points, lambda a, b: bin(a ^ b).count("1") <= 4)
    label = {bytes(r["node"]): bytes(r["root"]) for r in got}
    mine = [label.get(p.to_bytes(8, "big"), p.to_bytes(8, "big")) for p in points]
    pairs = lambda x: {frozenset(i for i, y in enumerate(x) if y == z) for z in set(x)}
    assert pairs(mine) == pairs(root)


@pytest.mark.parametrize("same", [21, 35, 60])
def test_dense_blocks_are_split_by_other_bits_and_in_the_end_dealt(spark, same):
    """Points that agree in the bits of one block, of two, or nearly all: the links are still exact, and no group holds
    all of them.
    """
    rng = np.random.default_rng(same)
    order = [b for k in range(3) for b in range(k, 64, 3)]  # the first block's bits first
    free = sum(1 << b for b in order[same:])
    base = rng.integers(0, 2**63, 500, dtype=np.uint64) & np.uint64(free)
    near = base[:250] ^ np.array(
        [sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(250)], np.uint64
    )
    points = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(bytearray(int(p).to_bytes(8, "big")),) for p in points], "fingerprint binary")
    edges = simhash.link(df, simhash.block_masks(1, 3), 1, 4, leaf=8)
    label = {bytes(r["node"]): bytes(r["root"]) for r in components.components(edges).collect()}
    mine = [label.get(int(p).to_bytes(8, "big"), int(p).to_bytes(8, "big")) for p in points]
    root = groups([int(p) for p in points], lambda a, b: (a ^ b).bit_count() <= 4)
    pairs = lambda x: {frozenset(i for i, y in enumerate(x) if y == z) for z in set(x)}
    assert pairs(mine) == pairs(root)
    tree = simhash.Tree(points.reshape(-1, 1), simhash.block_masks(1, 3)[0], 1, 8, 1.0)
    row, leaf, home = tree.route(points.reshape(-1, 1))
    assert same == 60 or np.bincount(leaf).max() < len(points) / 2
    assert (np.bincount(row[home], minlength=len(points)) >= 1).all()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 500), (None, 3)]
    got = {
        r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    }
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {500: 500}


def test_near_copies_are_caught_and_others_left(spark):
    """Pairs from 0.8 up, by how many of 300 words are changed, against a comparison of all pairs; SimHash alone misses
    many of them.
    """
    rng = np.random.default_rng(2)
    rows = []
    for d in range(60):
        base = [f"t{x}" for x in rng.integers(0, 5000, 300)]
        for changes in (0, d % 8 + 1):
            near = list(base)
            for at in rng.choice(300, changes, replace=False):
                near[at] = f"changed{d}"
            rows.append((len(rows), " ".join(near)))
        rows.append((len(rows), " ".join(f"u{x}" for x in rng.integers(0, 5000, 300))))
    df = spark.createDataFrame(rows, "n long, text string")
    got = {r["n"]: r["root"] for r in simhash.near_copies(df).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    assert [got[i] for i in range(len(rows))] == groups(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    by_print = {(r["a"], r["b"]) for r in simhash.candidate_links(df).collect()}
    assert by_print
    assert sum(got[a] == got[b] for a, b in by_print) > 0.9 * len(by_print)


# -- 3


def test_pieces_and_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    parts = packing.pieces(awkward(spark), "doc_id", "text", RANKS, capacity=256, with_ids=True).toPandas()
    expected = Counter()
    for ident, text in TEXTS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[(ident, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = Counter(
        (
            None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32
        ) for r in parts.itertuples()
    )
    assert got == expected
    placed = packing.pack_documents(awkward(spark), "doc_id", "text", RANKS, 256).toPandas()
    assert Counter(
        zip(placed.piece, placed.start, placed.ids_crc32)
    ) == Counter(zip(parts.piece, parts.start, parts.ids_crc32))
    for _, g in placed.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()
        assert g.length.sum() <= 256
    assert packing.pack_documents(awkward(spark).limit(0), "doc_id", "text", RANKS).count() == 0


def test_groups_exchange_bins_and_come_close_to_the_bound(spark):
    """Many groups: every piece is placed once, later rounds save bins, and the whole is near the bound of all pieces
    together.
    """
    rng = np.random.default_rng(3)
    lengths = np.concatenate([rng.integers(1, 2049, 6_000), rng.integers(300, 420, 3_000)])
    parts = spark.createDataFrame(
        [(i, 0, 0, int(x), i) for i, x in enumerate(lengths)],
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )
    bins = {}
    for rounds in (1, 8):
        got = packing.pack(parts, 2048, group_rows=600, rounds=rounds).toPandas()
        assert sorted(got.doc_id) == list(range(len(lengths)))
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert (g.offset == g.length.cumsum() - g.length).all()
            assert g.length.sum() <= 2048
        bins[rounds] = got.sequence_id.nunique()
    bound = packing.lower_bound(lengths, 2048)
    assert bound <= bins[8] <= bins[1]
    assert bins[8] <= 1.02 * bound


def test_bounds_hold_and_packing_meets_them():
    rng = np.random.default_rng(1)
    for capacity, sizes in ((10, [6, 6, 6, 4, 4, 4]), (10, [4, 4, 4, 3, 3, 3]), (12, [7, 7, 5, 5, 6]), (10, [])):
        lengths = np.array(sizes, np.int64)
        assert packing.lower_bound(lengths, capacity) <= (
            packing.best_fit(lengths, capacity)[0].max() + 1 if sizes else 0
        )
    assert packing.lower_bound(np.array([6] * 5), 10) == 5
    assert packing.lower_bound(np.array([4] * 6), 10) == 3
    lengths = rng.integers(1, 2049, 20_000)
    bins, offsets = packing.best_fit(lengths, 2048)
    assert np.bincount(bins, weights=lengths).max() <= 2048
    assert bins.max() + 1 <= 1.01 * packing.lower_bound(lengths, 2048)


# -- 4


def test_media_round_trip(spark):
    got = media.texts_as_media(awkward(spark), "doc_id", "text").toPandas()
    expected = Counter()
    for _, text in TEXTS:
        data = (text or "").encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        expected[(len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))] += 1
    assert Counter(zip(got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32)) == expected
    assert (got.groupby("payload_sha256")[["media_sha256", "feature"]].nunique() == 1).all().all()
    assert media.texts_as_media(awkward(spark).limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("kind", ["wav", "png", "bmp"])
def test_sniffing_corrects_carves_and_rejects(spark, kind):
    payload = bytes(range(192)) * 3
    medium = media.encode(payload, kind)
    assert media.decode(medium, kind) == payload
    assert media.find_media(b"junkBM" + medium + b"RIFFtail") == [(6, 6 + len(medium), kind, 0)]
    assert media.find_media(medium[:-1]) == []
    outer = media.encode(medium + b"\0" * (-len(medium) % 192), "wav")
    assert [m[2:] for m in media.find_media(outer)] == [("wav", 0), (kind, 1)]
    rows = spark.createDataFrame(
        [(1, "gif", bytearray(b"??" + medium)), (2, None, None), (3, kind, bytearray(medium))],
        "id long, declared string, blob binary",
    )
    assert sorted(
        (
            r["id"], r["type"], r["start"], r["declared_right"]
        ) for r in media.sniff(rows, "id", "blob", "declared").collect()
    ) == [(1, kind, 2, False), (3, kind, 0, True)]


def test_gif_and_jpeg_are_followed_to_their_ends():
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + b"\0" * 6 + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x01\x02\xff\x00\x03\xff\xd9"
    assert media.find_media(b"x" + gif + jpeg) == [
        (1, 1 + len(gif), "gif", 0), (1 + len(gif), 1 + len(gif) + len(jpeg), "jpeg", 0)
    ]


# -- 5


def _plain_dedup(rows, length):
    first = {}
    for ident, text in rows:
        w = words(text)
        for i in range(len(w) - length + 1):
            if ident is not None:
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, ident), ident)
    out = Counter()
    for ident, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - length + 1):
            if ident is not None and first[tuple(w[i : i + length])] < ident:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(ident, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length", [2, 5, 7, 13, 50, 100])
def test_repeated_words_go(spark, length):
    got = substring.dedup_words(awkward(spark), "doc_id", "text", length).toPandas()
    assert Counter(
        (None if np.isnan(r.doc_id) else int(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.itertuples()
    ) == _plain_dedup(TEXTS, length)
    assert substring.dedup_words(awkward(spark).limit(0), "doc_id", "text").count() == 0


def test_tables_of_few_words_keep_them(spark):
    """Fewer words than a window, in all of a table."""
    rows = [(1, "a b"), (2, "a b"), (3, "c d e f g h i"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for length in (13, 50):
        got = substring.dedup_words(df, "doc_id", "text", length).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == _plain_dedup(
            rows, length
        )


def test_levels_double():
    for length in range(1, 200):
        sizes = substring.levels(length)
        assert sizes[-1] == length
        assert all(a < b <= 2 * a for a, b in zip(sizes, sizes[1:]))
    assert substring.levels(13) == [7, 13]
    assert substring.levels(50) == [7, 13, 25, 50]


@pytest.mark.parametrize("length", [8, 13, 30])
def test_windows_at_every_place_and_of_every_length(spark, length):
    """Passages of 1 to 60 words of a small vocabulary, at all places of documents, with repeats inside them; and
    copies of whole documents.
    """
    rng = np.random.default_rng(length)
    pool = [[f"p{k}w{x}" for x in rng.integers(0, 12, size)] for k, size in enumerate(range(1, 61))]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.integers(1, 5)):
            chosen = pool[rng.integers(0, len(pool))]
            text += chosen[: rng.integers(1, len(chosen) + 1)] + [
                f"x{rng.integers(0, 40)}" for _ in range(rng.integers(0, 9))
            ]
        rows.append((int(rng.integers(0, 120)), " ".join(text)))
    rows += [(i + 200, rows[i][1]) for i in range(0, 60, 3)] + [(None, rows[5][1])]
    got = substring.dedup_words(
        spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", length
    ).toPandas()
    assert Counter(
        (None if np.isnan(r.doc_id) else int(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.itertuples()
    ) == _plain_dedup(rows, length)


def test_a_passage_of_a_third_of_all_documents(spark, monkeypatch):
    """Sampled hot keys are salted and pre-aggregated; the result is the plain one."""
    monkeypatch.setattr(substring, "SAMPLE_DOCS", 100)
    monkeypatch.setattr(substring, "HOT_IN_SAMPLE", 3)
    common = " ".join(f"c{i}" for i in range(20))
    rows = [
        (
            i,
            f"{common} own{i} text{i}" if i % 3 == 0 else " ".join(f"r{i}x{j}" for j in range(30)) + (
                " " + common if i % 7 == 0 else ""
            ),
        ) for i in range(400)
    ]
    got = substring.dedup_words(
        spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 13
    ).toPandas()
    assert Counter(
        (int(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.itertuples()
    ) == _plain_dedup(rows, 13)


def test_cutting_keeps_the_rest_as_it_was(spark):
    df = awkward(spark)
    got = substring.cut_repeats(df, "doc_id", "text", 50)
    assert got.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] is not None}
    assert texts[7] == dict(TEXTS)[7]
    assert texts[8] == "other start other end"
    assert texts[3] is None
    assert texts[5] == dict(TEXTS)[5]
    assert got.count() == len(TEXTS)


# -- 6, 10


def test_language_of_held_out_documents(spark):
    d = docs(spark)
    got = QUERIES["op6_language_id"](spark, SMALL).toPandas().merge(d.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()



def test_language_bags_are_packed_without_loss_and_a_machine_takes_its_own():
    rng = np.random.default_rng(6)
    bags = [np.where(rng.random(langid.BUCKETS) < 0.1, rng.random(langid.BUCKETS), 0).astype(np.float16).astype(np.float32) for _ in range(5)]
    packed = [langid._packed(b) for b in bags]
    assert max(map(len, packed)) < langid.BUCKETS
    got = langid._dense(packed, np.array([3, 1]))
    assert (got[:, :-1] == np.stack([bags[3], bags[1]]) * np.float32(langid.SCALE)).all() and (got[:, -1] == 1).all()


def test_language_edge_cases(spark):
    d = docs(spark)
    model = langid.fit(d, "doc_id", "text", "lang")
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(awkward(spark), model, "doc_id", "text").collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= got
    assert langid.fit(d.withColumn("lang", F.lit(None).cast("string")), "doc_id", "text", "lang") is None
    assert {r["lang_pred"] for r in langid.predict(awkward(spark), None, "doc_id", "text").collect()} == {"und"}
    single = langid.fit(d.filter("lang = 'en'"), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in langid.predict(d, single, "doc_id", "text").collect()} == {"en"}
    assert langid.predict(d.limit(0), model, "doc_id", "text").count() == 0
    unknown = langid.fit(
        d.filter("lang in ('en', 'fr')").withColumn("lang", F.when(F.col("lang") == "en", "x1").otherwise("x2")),
        "doc_id",
        "text",
        "lang",
    )
    assert unknown.families == {"other": ["x1", "x2"]}


def test_letters_are_those_of_unicode():
    assert [
        langid.has_letter(t.encode()) for t in ("½ ² ①", "12 _", "", "日", "ª", "ß1", "a", "\u0301", "!")
    ] == [False, False, False, True, True, True, True, False, False]


def test_languages_are_predicted_as_a_plain_loop_does(spark):
    """Every margin as the sum over a text's trigrams, one by one, and the votes counted by hand."""
    d = docs(spark)
    model = langid.fit(d, "doc_id", "text", "lang")
    rows = [(i, t) for i, (_, t) in enumerate(TEXTS)] + [(100 + i, r["text"]) for i, r in enumerate(d.limit(40).collect())]
    got = {
        r["n"]: (r["lang_pred"], r["score"]) for r in langid.predict(
            spark.createDataFrame(rows, "n long, text string"), model, "n", "text"
        ).collect()
    }

    def fold(text):
        out = []
        raw = text.encode()
        for k, b in enumerate(raw):
            if 65 <= b <= 90:
                b += 32
            elif k and raw[k - 1] == 0xC3 and 0x80 <= b <= 0x9E:
                b += 32
            out.append(b if 97 <= b <= 122 or b >= 128 else 32)
        return out

    for n, text in rows:
        x = fold(text or "")
        if not any(c.isalpha() for c in text or ""):
            assert got[n] == ("und", 0.0)
            continue
        margins, count = np.zeros(len(model.machines)), 0
        for k, b in enumerate(x):
            if b != 32:
                code = (
                    (x[k - 1] if k else 32) << 16 | b << 8 | (x[k + 1] if k + 1 < len(x) else 32)
                ) * 2_654_435_761 & 0xFFFFFFFF
                margins += model.weights[code >> 19]
                count += 1
        margins = langid.SCALE * margins / max(1, count) + model.weights[-1]
        said = {}
        for group, names in (("", list(model.families)), *model.families.items()):
            duels = [(a, b, m) for (g, a, b), m in zip(model.machines, margins) if g == group]
            votes = {c: sum((a == c and m >= 0) or (b == c and m < 0) for a, b, m in duels) for c in names}
            total = {c: sum(m if a == c else -m for a, b, m in duels if c in (a, b)) for c in names}
            best = max(names, key=lambda c: (votes[c], total[c]))
            said[group] = best, min((m if a == best else -m for a, b, m in duels if best in (a, b)), default=20.0)
        family, sure = said[""]
        language, inner = said[family]
        assert got[n][0] == language
        assert got[n][1] == pytest.approx(1 / (1 + np.exp(-3 * min(sure, inner, 20.0))), abs=2e-3)


def test_only_the_bounded_number_of_languages_trains(spark):
    d = docs(spark).withColumn("lang", F.concat(F.lit("x"), (F.col("doc_id") % 7).cast("string")))
    assert len(langid.fit(d, "doc_id", "text", "lang", sample=50, languages=3).languages) == 3


def test_scores_are_plain_sums_and_training_a_plain_loop(spark, monkeypatch):
    rows = [(i, t) for i, (_, t) in enumerate(TEXTS) if i != 9]
    rng = np.random.default_rng(1)
    weights = rng.normal(size=quality.CONSTANT + 1).astype(np.float32)
    got = {
        r["n"]: r["score"] for r in quality.score(
            spark.createDataFrame(rows, "n long, text string"), weights, "n", "text"
        ).collect()
    }
    for n, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        feature, _, runs = quality.features(raw, np.array([0, len(raw)]))
        margin = sum(
            quality.SCALE * float(weights[f]) for f in feature.tolist()
        ) / max(1, int(runs[0])) + float(weights[quality.CONSTANT])
        assert got[n] == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -30, 30))), rel=1e-4)
    model, z, s = quality.Ftrl(), {}, {}
    for _ in range(50):
        at, value, label = rng.choice(40, 5, replace=False), rng.random(5), int(rng.integers(0, 2))
        model.learn(at, value, label, 1.0)
        w = {}
        for i in at.tolist():
            zi, ni = z.get(i, 0.0), s.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= model.l1 else -(zi - np.sign(zi) * model.l1) / (
                (model.beta + ni**0.5) / model.alpha + model.l2
            )
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at.tolist(), value))))
        for i, v in zip(at.tolist(), value):
            g = (p - label) * v
            z[i] = z.get(i, 0.0) + g - ((s.get(i, 0.0) + g * g) ** 0.5 - s.get(i, 0.0) ** 0.5) / model.alpha * w[i]
            s[i] = s.get(i, 0.0) + g * g
    for i in z:
        assert model.z[i] == pytest.approx(z[i])
        assert model.n[i] == pytest.approx(s[i])


def test_training_keeps_its_bounds(spark, monkeypatch):
    """No more texts and bytes than asked for, and one text of an id that is repeated."""
    learned = []
    monkeypatch.setattr(quality.Ftrl, "learn", lambda self, at, value, label, weight: learned.append(at.tobytes()))
    df = spark.createDataFrame([(i % 50, f"text {i} of {i % 50}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    for sample, size, most in ((20, 1 << 20, 20), (50, 40, 4), (50, 1, 1)):
        learned.clear()
        quality.fit(df, labels, "doc_id", "text", "quality", sample=sample, epochs=1, sample_bytes=size)
        assert 0 < len(learned) <= most


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    got = QUERIES["op10_quality_classifier"](spark, sf).toPandas().merge(labels, on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_quality_edge_cases(spark):
    d = docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (5, 7)], "doc_id long, quality int")
    weights = quality.fit(d, labels, "doc_id", "text", "quality")
    scored = quality.score(awkward(spark), weights, "doc_id", "text").toPandas()
    assert len(scored) == len(TEXTS)
    assert scored.score.between(0, 1).all()
    assert quality.fit(d, labels.limit(0), "doc_id", "text", "quality") is None
    assert {r["score"] for r in quality.score(d, None, "doc_id", "text").collect()} == {0.5}
    assert quality.score(d.limit(0), weights, "doc_id", "text").count() == 0


# -- 7


def test_archives(spark, tmp_path):
    body = "p" * 1500
    rows = [
        (1, "u1", body),
        (2, "u2", body),
        (3, "u3", body),
        (4, None, "short"),
        (5, "u5", "short"),
        (6, "u6", None),
        (None, "u7", "é" * 700),
        (8, "u8", "é" * 700),
        (9, "bad\r\nurl", "\r\n\r\nWARC/1.0\r\n"),
    ]
    pages = spark.createDataFrame(
        rows, "page_id long, url string, html string"
    ).withColumn("digest", F.lit("clash")).withColumn("payload", F.lit("clash"))
    got = {
        (
            r["page_id"], r["record_type"], r["refers_to"]
        ): r for r in warc.archive_pages(pages, "page_id", "url", "html").collect()
    }
    assert set(got) == {
        (1, "revisit", 3),
        (2, "revisit", 3),
        (3, "response", None),
        (4, "response", None),
        (5, "response", None),
        (6, "response", None),
        (None, "revisit", 8),
        (8, "response", None),
        (9, "response", None),
    }
    for (ident, _, _), r in got.items():
        data = (next(b for i, _, b in rows if i == ident) or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert warc.archive_pages(pages.limit(0), "page_id", "url", "html").count() == 0
    made = warc.normalise(warc.write_archives(warc.with_roles(pages, "page_id", "url", "html", 1000)))
    paths = [r["path"] for r in warc.export_files(made, tmp_path.as_uri()).collect()]
    members = sum(len(open(p.replace(".warc.gz", ".idx")).readlines()) for p in paths)
    assert members == len(rows)


def test_streams_of_several_members_and_odd_headers_are_read_whole(spark):
    import gzip

    made = [
        warc.record(
            f"id-{i}", f"http://x/{i}", f"body {i}".encode(), hashlib.sha1(f"body {i}".encode()).hexdigest(), None
        ) for i in range(3)
    ]
    made[1] = made[1].replace(b"WARC-Date:", b"X-Odd: caf\xe9\r\nWARC-Date:")
    streams = [
        b"".join(map(gzip.compress, made)) + b"\0" * 7,
        gzip.compress(b"".join(made)),
        gzip.compress(made[0] + made[1]) + gzip.compress(made[2]),
    ]
    archives = spark.createDataFrame(
        [(str(k), bytearray(x)) for k, x in enumerate(streams)], "archive string, stream binary"
    )
    found = warc.read_records(warc.normalise(archives)).collect()
    assert Counter((r["archive"], r["record_id"]) for r in found) == Counter(
        (str(k), f"<urn:page:id-{i}>") for k in range(3) for i in range(3)
    )
    with pytest.raises(ValueError, match="cut off"):
        warc.inflate(gzip.compress(made[0])[:-3])


def test_ids_of_other_types_come_back(spark):
    body = "q" * 1200
    for kind, ids in (
        ("string", ["a>b", "none", "x y+%", "é", None]), ("int", [1, 2, -3, None]), ("decimal(12,2)", ["1.50", "2.00"])
    ):
        pages = spark.createDataFrame([(i, body) for i in ids], "page_id string, html string").select(
            F.col("page_id").cast(kind), "html", F.lit("u").alias("url")
        )
        got = warc.archive_pages(pages, "page_id", "url", "html").collect()
        assert Counter(r["page_id"] for r in got) == Counter(r["page_id"] for r in pages.collect())
        top = max(r["page_id"] for r in got if r["page_id"] is not None)
        assert {r["refers_to"] for r in got if r["page_id"] != top} == {top}


# -- 8


def test_search_is_exact(spark):
    texts = [(i, t) for i, t in TEXTS if i is not None]
    got = bm25.top_k(
        awkward(spark),
        awkward(spark).filter("doc_id % 2 = 0").dropDuplicates(["doc_id"]),
        "doc_id",
        "text",
        k=3,
        entries=40,
    ).collect()
    bags = [(i, Counter(words((t or "").lower()))) for i, t in texts]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    for q in {i for i, _ in texts if i % 2 == 0}:
        asked = set(next(b for i, b in bags if i == q))
        scored = []
        for i, b in bags:
            s = sum(
                int(
                    np.rint(
                        1e6 * (
                            np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (
                                b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)
                            )
                        )
                    )
                ) for w in asked & b.keys()
            )
            if s:
                scored.append((-s, i))
        assert [
            (-r["score"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q
        ] == sorted(scored)[:3]
    assert bm25.top_k(awkward(spark).limit(0), awkward(spark).limit(0), "doc_id", "text").count() == 0


def test_search_skips_blocks_and_shards_share_thresholds(spark, monkeypatch):
    """Shards of 512 documents, several blocks of queries, two waves: equal to a search that scores everything, and
    most blocks are skipped.
    """
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(40)]
    texts = []
    for i in range(3_000):
        topic = [f"t{i // 15}w{x}" for x in rng.integers(0, 30, 12)]
        texts.append(" ".join(list(rng.choice(common, 25)) + topic))
    bags = [Counter(t.split()) for t in texts]
    df = Counter(w for b in bags for w in b)
    n, mean = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    weight = [
        {w: int(np.rint(1e6 * (np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean))))) for w, c in b.items()} for b in bags
    ]
    monkeypatch.setattr(bm25, "SHARD", 512)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in bm25.top_k(rows, rows.filter("doc_id % 20 = 0"), "doc_id", "text", k=10, entries=2_000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["doc_id"]))
    for q in range(0, 3_000, 20):
        scored = sorted((-s, i) for i, w in enumerate(weight) if (s := sum(w.get(x, 0) for x in bags[q])))[:10]
        assert [x[1:] for x in sorted(got[q])] == scored
    docs = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], ["id", "text"]
    )
    lists = [bm25._distinct(d, w) for _, d, w, _ in bm25._bags(docs)]
    assert len(lists) == 6  # the same shards, here by hand
    word = np.unique(np.concatenate([w for _, w, _ in lists]))
    counts = np.bincount(np.searchsorted(word, np.concatenate([w for _, w, _ in lists])))
    own = [bm25._distinct(d, w)[1] for _, d, w, _ in bm25._bags(docs.slice(700, 1))][0]
    block = bm25.Queries(np.zeros(len(own), np.int64), own.view(np.int64), counts[np.searchsorted(word, own)], n, mean)
    scored, plain = [], bm25.Search._score
    monkeypatch.setattr(
        bm25.Search,
        "_score",
        lambda self,
        shard,
        a,
        w,
        s,
        wanted: scored.append(wanted.sum()) or plain(self, shard, a, w, s, wanted),
    )
    search = bm25.Search(block, 10)
    for made in _index_rows(docs):
        search.shard(bm25.Shard(made, block))
    assert sum(scored) < 30  # of 48
    assert len(search.score[0]) == 10


def _index_rows(docs):
    """What build_index makes of a batch, without Spark."""
    held = []

    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            held.extend(run(iter([docs])))

    bm25.build_index(Frame())
    return [{c: b.column(c)[0].as_buffer() for c in ("ids", "lengths", "words", "first", "doc", "tf")} for b in held]


# -- 9


def test_pieces_as_the_library_makes_them(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = piece_bpe.encode_documents(awkward(spark), "doc_id", "text", PIECES, with_ids=True).collect()
    by_text = Counter()
    for _, text in TEXTS:
        ids = library.encode(text or "", add_eos=True)
        by_text[(tuple(ids), library.decode(ids))] += 1
    assert Counter((tuple(r["ids"]), r["decoded"]) for r in got) == by_text
    assert all(
        r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(
            " ".join(map(str, r["ids"])).encode()
        ).hexdigest() for r in got
    )
    assert piece_bpe.encode_documents(awkward(spark).limit(0), "doc_id", "text", PIECES).count() == 0


def test_pieces_of_odd_texts():
    """Runs of spaces of every length, every piece of the model, and 50,000 mixtures, as the library encodes and
    decodes them.
    """
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = piece_bpe.codec(open(PIECES, "rb").read())
    rng, known = random.Random(9), list(codec.id_of)
    signs = list("  \n\t▁abcdeTh.,'!1290-_é日²½①ⅷ/\\(){}[]<>=+*&^%$#@~`|:;\"?\u00a0\u200b\u0301\ufb01\U0001f600\0\x7f\ufffd\ufeff")
    code = [
        "    ",
        "\n",
        "        ",
        "if x:",
        "return ",
        "²",
        "².",
        "//",
        "--",
        "self._x",
        "foo(bar)",
        "== ",
        " " * 15,
        " " * 31,
    ]
    texts = [
        t for k in range(1, 101) for t in (
            " " * k, "a" + " " * k + "b", " " * k + "b", "a" + " " * k, "\n" + " " * k + "²x", "▁" * k + "a"
        )
    ]
    texts += [t for p in known for t in (p, "x" + p + ".")]
    for n in range(50_000):
        from_, longest = (signs, 40) if n % 3 == 0 else (known, 12) if n % 3 == 1 else (code, 12)
        texts.append("".join(rng.choice(from_) for _ in range(rng.randint(0, longest))))
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert codec.encode(text) == ids, repr(text)
        assert codec.encode_text(text)[2] == library.decode(ids), repr(text)


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    codec = piece_bpe.Codec(open(PIECES, "rb").read())
    monkeypatch.setattr(piece_bpe, "KEPT", 5)
    same = [codec.encode(f"word{i} otherword{i} the end") for i in range(20)]
    assert max(len(codec.words), len(codec.segments), len(codec.compatible)) <= 5
    assert same == [codec.encode(f"word{i} otherword{i} the end") for i in range(20)]


# -- words and blanks that once broke operators

MORSE = ["".join("ab"[bin(i).count("1") & 1 ^ flip] for i in range(1024)) for flip in (0, 1)]


def test_words_that_sums_confuse_are_told_apart_by_windows_search_and_near_copies(spark):
    from stowage.llm import jaccard

    shared = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join([*shared, MORSE[i]])) for i in (0, 1)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.dedup_words(docs, "doc_id", "text", length=13).collect()] == [0, 0]
    own = spark.createDataFrame([(0, MORSE[0]), (1, MORSE[1])], "doc_id long, text string")
    found = bm25.top_k(own, own.filter("doc_id = 0"), "doc_id", "text").collect()
    assert [r["doc_id"] for r in found] == [0]
    pair = own.withColumnRenamed("doc_id", "n")
    assert len({r["root"] for r in jaccard.groups(pair).collect()}) == 2


@pytest.mark.parametrize("blank", [" ", "\n", " \n\t", "\u3000"])
def test_long_runs_of_blanks_are_encoded_as_the_library_does(blank):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = packing.encoder(open(RANKS, "rb").read())
    run = blank * (1_010_000 // len(blank))
    for text in (run, f"{run}word", f"word{run}", f"word{run}word", f"a{run}'s<|endoftext|>{run}"):
        assert packing.token_ids(encode, text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_equal_rows_without_ids_are_dealt_to_all_groups(spark, monkeypatch):
    parts = packing.pieces(spark.createDataFrame([(None, "same text")] * 4000, "doc_id long, text string").repartition(2), "doc_id", "text", RANKS)
    sizes, packer = [], packing._packer

    def counted(capacity, r):
        inner = packer(capacity, r)
        return lambda key, g: inner(key, g).assign(ids_crc32=len(g)) if not r else inner(key, g)

    monkeypatch.setattr(packing, "_packer", counted)
    sizes = [r["ids_crc32"] for r in packing.pack(packing.cut(parts, "pieces"), group_rows=500, rounds=1).collect()]
    assert len(sizes) == 4000 and max(sizes) < 1000
