"""Patterns and prefixes as rows, pages, and published versions, against plain loops."""

from __future__ import annotations

import fnmatch
import random


from stowage.operators import catalog, mutations, patterns, reports


def test_ten_thousand_patterns_as_a_loop_over_them(spark):
    rng = random.Random(8)
    words = ["cache", "tmp", "photo", "Ünï", "a.b", "x[1]", "new folder", "2024", "v", "日本"]
    name = lambda n: "/".join("".join(rng.choices(words, k=rng.randrange(1, 3))) for _ in range(n))
    files = [(i, i % 2, f"{name(rng.randrange(1, 4))}/f{rng.randrange(200)}.{rng.choice(['jpg', 'txt', 'TMP'])}") for i in range(300)] + [(900, 1, ""), (901, 1, None)]

    def pattern():
        kind = rng.randrange(8)
        if kind == 0:
            return rng.choice(["*", "?", "??*q", "[ab]*", "*[!a-y]", "", "[9-0]", "*[", None]) if rng.random() < 0.02 else f"*zz{rng.randrange(10**6)}*"
        if kind == 1:
            return f"*/f{rng.randrange(10**5)}.*"
        if kind == 2:
            return f"{rng.choice(words)}{rng.randrange(10**4)}/*"
        if kind == 3:
            return f"*{rng.choice(words)}?f{rng.randrange(10**4)}.[jt][pm]?"
        if kind == 4:
            return f"*{rng.randrange(10**5)}.TMP"
        if kind == 5:
            return f"*x[[]1]*f{rng.randrange(10**4)}*"
        if kind == 6:
            return f"?{rng.randrange(10**4)}*.[!a-i]*"
        return f"{name(2)}*{rng.randrange(10**4)}*"

    rows = [(i % 2, i, pattern()) for i in range(10_000)]
    rng.shuffle(rows)
    got = patterns.first_glob(spark.createDataFrame(files, "id long, list int, path string"), spark.createDataFrame(rows, "list int, n long, pattern string"))
    lists = {k: sorted((n, p) for a, n, p in rows if a == k and p) for k in (0, 1)}
    want = {i: next(((n, p) for n, p in lists[a] if fnmatch.fnmatchcase(path, p)), None) for i, a, path in files if path is not None}
    assert {r.id: (r.n, r.pattern) for r in got.collect()} == {i: x for i, x in want.items() if x}
    assert sum(x is not None for x in want.values()) > 30
    none = spark.createDataFrame([], "list int, n long, pattern string")
    assert patterns.first_glob(spark.createDataFrame(files, "id long, list int, path string"), none).count() == 0


def test_prefixes_as_a_loop_over_them(spark):
    rng = random.Random(9)
    name = lambda n: "".join(rng.choices("ab/é", k=n))
    files = [(i, name(rng.randrange(0, 12))) for i in range(400)] + [(900, None)]
    rows = [(n, name(rng.randrange(0, 9)) if n < 2000 else "", f"name{n}") for n in range(1, 2001)] + [(0, None, "null")]
    rng.shuffle(rows)
    got = catalog.watch_library(spark.createDataFrame(files, "id long, path string"), spark.createDataFrame(rows, "n int, prefix string, name string"))
    order = sorted(r for r in rows if r[1] is not None)
    assert {r.id: r.library for r in got.collect()} == {i: None if p is None else next((x for _, q, x in order if p.startswith(q)), None) for i, p in files}


def test_pages_anywhere_are_those_of_the_whole_order(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice(["a", "b", None]), f"f{rng.randrange(50)}") for i in range(1003)]
    files = spark.createDataFrame(rows, "id long, genre string, filename string").repartition(7)
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[2], r[0]))
    ids = lambda page, size: [r.id for r in reports.page_of(files, page, size).collect()]
    for page, size in ((1, 20), (26, 20), (51, 20), (99, 20), (-3, 20), (2, 400)):
        k = min(max(page, 1), -(-1003 // size)) - 1
        assert ids(page, size) == [r[0] for r in order[k * size : (k + 1) * size]]
    assert ids(None, 20) == [r[0] for r in order[25 * 20 : 26 * 20]]
    assert reports.page_of(files.limit(0), 4).count() == 0


def test_a_reader_always_finds_a_version(spark, tmp_path):
    root = str(tmp_path)
    for v in (1, 2, 10):
        mutations.publish(spark, spark.range(v), root, "t", v)
        assert mutations.current_version(spark, root, "t") == v and mutations.read_current(spark, root, "t").count() == v
    spark.range(3).write.parquet(f"{root}/t/v=11")  # written, but never published
    assert mutations.read_current(spark, root, "t").count() == 10
    assert not [p for p in (tmp_path / "t/_versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_keyed_backfill_adds_what_is_missing_once(spark):
    import hashlib
    import hmac

    keys = spark.createDataFrame([(1, 5, bytes(32)), (2, None, b"k" * 32)], "id long, retired_at long, master_key binary")
    records = spark.createDataFrame([(1, "aa"), (2, None), (3, "cc")], "id long, sha256 string")
    none = spark.createDataFrame([], "record_id long, key_version_id long")
    got = mutations.backfill_keyed(records, keys, none)
    assert {(r[0], r[1], r[2]) for r in got.collect()} == {(i, 2, hmac.new(b"k" * 32, f"content-id:{s}".encode(), hashlib.sha256).hexdigest()) for i, s in ((1, "aa"), (3, "cc"))}
    assert mutations.backfill_keyed(records, keys, got.select("record_id", "key_version_id")).count() == 0
