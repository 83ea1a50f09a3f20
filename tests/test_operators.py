"""Operators on small tables with exact results."""

from __future__ import annotations

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from stowage.operators import backup, catalog, content, discovery, ledger, mutations, ordered, reports


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_ranges_bridges_small_gaps(spark):
    pieces = spark.createDataFrame(
        [(1, 0, 100), (1, 500, 100), (1, 1000, 100), (1, 3000, 100), (2, 0, 10), (2, 300_000, 10), (1, 50, 10)],
        "backup_archive_id long, offset long, length long",
    )
    assert rows(ledger.merge_ranges(pieces)) == [(1, 0, 3100), (2, 0, 10), (2, 300_000, 10)]


def test_stored_pieces_clip_to_parts(spark):
    links = spark.createDataFrame(
        [(1, 0, 10, 100, 50), (1, 1, 11, 0, 50), (1, 2, 12, 7, 50)],
        "backup_record_id long, part_index long, backup_archive_id long, archive_offset long, archive_length long",
    )
    assert rows(ledger.stored_pieces(links, F.lit(40), F.lit(70))) == [(1, 10, 140, 10), (1, 11, 0, 50), (1, 12, 7, 10)]


def _next_fit(costs, limit):
    out, at, filled = [], 0, 0
    for c in costs:
        if filled and filled + c > limit:
            at, filled = at + 1, 0
        filled += c
        out.append(at)
    return out


def test_next_fit_both_ways(spark):
    """Streams and pointer doubling, with rows of no cost, rows over the limit, and several groups in several
    partitions.
    """
    import random

    rng = random.Random(3)
    costs = {g: [rng.choice([0, 1, 5, 9, 40]) for _ in range(n)] for g, n in (("a", 300), ("b", 1), ("c", 40))}
    costs["d"] = [0, 0, 50, 0, 31, 0, 0, 30, 1]
    data = spark.createDataFrame(
        [(g, i, c) for g, cs in costs.items() for i, c in enumerate(cs)], "g string, i long, c long"
    ).repartition(7)
    expected = sorted((g, i, b) for g, cs in costs.items() for i, b in enumerate(_next_fit(cs, 30)))
    for group_rows in (1_000, 50, 0):
        got = ordered.next_fit(data, "g", ["i"], "c", 30, group_rows)
        assert rows(got.select("g", "i", "bin")) == expected, group_rows


def test_running_numbers_and_sums(spark):
    data = spark.createDataFrame(
        [("x" if i % 3 else "y", i, i % 5) for i in range(500)] + [(None, 1, 2), (None, 2, 3)],
        "g string, i long, c long",
    ).repartition(5)
    got = {(r["g"], r["i"]): (r["n"], r["to"]) for r in ordered.running(data, "g", ["i"], "c").collect()}
    assert got[(None, 2)] == (1, 5)
    for g in "xy":
        own = [i for i in range(500) if (i % 3 > 0) == (g == "x")]
        assert [got[(g, i)] for i in own] == [(k, sum(j % 5 for j in own[: k + 1])) for k in range(len(own))]


def test_records_of_many_archives_have_ids_of_their_own(spark):
    """A file at 20 archives: every record has its own id, after the largest."""
    members = spark.createDataFrame(
        [(a, f, d, f"h{f}", 0, 0, 5) for f in (1, 2) for d in range(20) for a in (100 + d,)],
        "archive_id long, media_file_id long, destination_id long, sha256 string, part_index long, offset long, length long",
    )
    records = spark.createDataFrame(
        [(7, 1, 3, "old", "failed"), (9, 5, 1, "x", "done")],
        "id long, media_file_id long, destination_id long, sha256 string, status string",
    )
    links = spark.createDataFrame(
        [(7, 50, 0, 1, 1), (9, 51, 0, 2, 2)],
        "backup_record_id long, backup_archive_id long, part_index long, archive_offset long, archive_length long",
    )
    after, linked = (df.collect() for df in backup.record_archives(members, records, links))
    assert sorted(r["id"] for r in after) == [7, 9, *range(10, 49)]
    assert {(r["sha256"], r["status"]) for r in after if r["id"] == 7} == {("h1", "done")}
    assert len({r["backup_record_id"] for r in linked}) == len(linked) == 41
    assert (9, 51) in {(r["backup_record_id"], r["backup_archive_id"]) for r in linked}
    assert (7, 50) not in {(r["backup_record_id"], r["backup_archive_id"]) for r in linked}


def test_archives_are_bounded_whatever_the_group(spark):
    members = spark.createDataFrame(
        [("hot", i, 40) for i in range(1000)] + [("cold", 5000, 10_000_000_000)], "source string, id long, n_bytes long"
    )
    got = content.deal_to_archives(members, "source", "id", 1000).groupBy("archive").agg(
        F.sum("n_bytes").alias("s"), F.count("id").alias("n")
    ).collect()
    assert max(r["s"] for r in got if r["archive"].startswith("hot")) <= 1040
    assert sum(r["n"] for r in got) == 1001


def test_inventory_case(spark):
    a, b, c = (f"{k}0000000-0000-0000-0000-000000000000" for k in "abc")
    listing = spark.createDataFrame(
        [
            (f"m/{a}.tar", 4, "ARCHIVE"),
            (f"m/{a}.json", 1, "STANDARD"),
            (f"m/archives/{b}.tar", 2, "STANDARD"),
            (f"m/index/{c}.json", 1, None),
            ("m/readme.txt", 9, None),
        ],
        "key string, size long, storage_class string",
    )
    known = spark.createDataFrame([(f"m/{a}.tar",), ("m/gone.tar",)], "path string")
    assert rows(ledger.inventory(listing, known)) == sorted(
        [
            (f"m/archives/{b}.tar", "untracked"),
            ("m/gone.tar", "missing"),
            (f"m/archives/{b}.tar", "no_index"),
            (f"m/index/{c}.json", "orphan_index"),
        ]
    )
    assert rows(reports.inventory_tiers(listing)) == [("ARCHIVE", 1, 4), ("STANDARD", 1, 2)]


def test_index_documents(spark):
    good = '{"v":1,"archive_id":"A","object":"o/A.tar","type":"clump","files":{"h1":{"size":3,"offset":5,"mtime":"2023-11-14T22:13:20Z","paths":["x"]}}}'
    again = '{"v":1,"archive_id":"B","object":"o/B.tar","files":{"h1":{"size":3,"offset":9,"mtime":"2023-11-14T22:13:20Z","part":2,"paths":["y"]},"h2":{"size":1,"mtime":"bad"}}}'
    other = '{"v":1,"archive_id":"C","object":"o/C.tar","files":{"h2":{"size":2,"mtime":"bad"}}}'
    docs = spark.createDataFrame(
        [
            ("1", good),
            ("2", again),
            ("3", other),
            ("4", "{broken"),
            ("5", '{"files":{}}'),
            ("6", good.replace("o/A.tar", "gone.tar")),
        ],
        "key string, body string",
    )
    parsed = discovery.parse_index(docs)
    assert [r["key"] for r in parsed.filter("bad").orderBy("key").collect()] == ["4", "5"]
    listing = spark.createDataFrame([("o/A.tar",), ("o/B.tar",), ("o/C.tar",)], "key string")
    each = discovery.entries(parsed).withColumn("sha256", F.col("key")).withColumn("paths", F.col("entry.paths"))
    told = discovery.discover(each, listing)
    found = told.files.collect()
    assert [
        (r["sha256"], r["size_bytes"], r["mtime_ns"], r["paths"], r["parts"], r["copies"]) for r in found
    ] == [("h1", 3, 1_700_000_000 * 10**9, ["x"], 2, 2)]
    assert rows(told.parts.select("sha256", "part", "archive_id", "offset")) == [("h1", 0, "A", 5), ("h1", 2, "B", 9)]


def _index_members(spark, rows):
    df = spark.createDataFrame(
        rows,
        "archive_id string, sha256 string, content_id string, sha256_enc string, paths_enc string, paths array<string>, part int, parts int",
    )
    same = {
        "object": F.lit("o"),
        "type": F.lit("clump"),
        "created_at": F.lit("t"),
        "archive_size": F.lit(9),
        "key_check": F.lit("kc"),
        "size": F.lit(3),
        "mtime": F.lit("m"),
        "member": F.lit("f"),
        "offset": F.lit(512),
        "compression": F.lit(None).cast("string"),
    }
    return df.withColumns(same)


def test_index_documents_of_both_kinds(spark):
    import json

    plain = _index_members(
        spark, [("A", "h1", None, None, None, ["p"], None, None), ("A", "h2", None, None, None, ["q"], 1, 2)]
    )
    doc = json.loads(backup.build_index(plain).first()["body"])
    assert doc["files"]["h2"] == {
        "size": 3, "mtime": "m", "member": "f", "offset": 512, "paths": ["q"], "part": 1, "parts": 2
    }
    assert "key_scheme" not in doc and "encrypted" not in doc
    keyed = _index_members(spark, [("B", "h1", "c1", "s1", "pe", None, None, None)])
    doc = json.loads(backup.build_index(keyed).first()["body"])
    assert doc["files"] == {
        "c1": {"size": 3, "mtime": "m", "member": "f", "offset": 512, "paths_enc": "pe", "sha256_enc": "s1"}
    }
    assert (doc["key_scheme"], doc["key_check"], doc["encrypted"]) == ("content_id_v1", "kc", True)


@pytest.mark.parametrize(
    ("rows", "said"),
    [
        (
            [("A", "h", None, None, None, ["p"], None, None), ("A", "h", None, None, None, ["q"], None, None)],
            "DUPLICATED_MAP_KEY",
        ),
        (
            [("A", "h", None, None, None, ["p"], None, None), ("A", "g", "c", "s", "e", None, None, None)],
            "with and without a content id",
        ),
        ([("A", "g", "c", None, "e", None, None, None)], "without its sealed hash"),
    ],
)
def test_bad_archives_have_no_index_document(spark, rows, said):
    with pytest.raises(Exception, match=said):
        backup.build_index(_index_members(spark, rows)).collect()


def test_folder_expand_is_by_component(spark):
    files = spark.createDataFrame(
        [(1, "/a/b/x"), (2, "/a/bc/x"), (3, "/a/b/c/d/x"), (4, "/a/b")], "id long, path string"
    )
    assert rows(catalog.folder_expand(files, spark.createDataFrame([("/a/b",)], "folder string"))) == [(1,), (3,)]


def test_nfo_cases(spark):
    cases = [
        (1, "<movie><title>T</title><year>1999</year><rating>7.5</rating><runtime>90</runtime></movie>"),
        (2, "<movie><title>T"),
        (3, "<show><title>T</title></show>"),
        (4, None),
        (5, "<movie><title>U</title><year>abc</year></movie>"),
    ]
    got = {
        r["id"]: (r["title"], r["year"], r["rating"], r["runtime_minutes"]) for r in catalog.nfo_fields(
            spark.createDataFrame(cases, "id long, xml string"), "xml"
        ).collect()
    }
    assert got == {1: ("T", 1999, 7.5, 90), 2: (None,) * 4, 3: (None,) * 4, 4: (None,) * 4, 5: ("U", None, None, None)}


def test_run_progress_cases(spark):
    kind = "id long, kind string, status string, phase string, phase_done long, phase_total long, phase_started_us long, heartbeat_us long, started_us long"
    s = 1_000_000
    runs = spark.createDataFrame(
        [
            (1, "backup", "running", "uploading", 50, 200, 0, 100 * s, 0),
            (2, "backup", "running", "hashing", 300, 200, 98 * s, None, 0),
            (3, "sync", "queued", None, None, None, None, None, None),
            (4, "restore", "running", "custom", 0, 0, None, -30 * s, 0),
        ],
        kind,
    )
    got = {r["id"]: r for r in reports.run_progress(runs, F.lit(100 * s)).collect()}
    assert (
        got[1]["percent"], got[1]["rate"], got[1]["eta_seconds"], got[1]["unit"], got[1]["stalled"]
    ) == (25.0, 0.5, 300.0, "bytes", False)
    assert (got[2]["percent"], got[2]["rate"], got[2]["heartbeat_age"]) == (100.0, None, 100.0)
    assert (got[3]["percent"], got[3]["heartbeat_age"], got[3]["stalled"]) == (None, None, False)
    assert (got[4]["label"], got[4]["heartbeat_age"], got[4]["stalled"]) == ("custom", 130.0, True)


def test_adoption_takes_complete_copies_only(spark):
    candidates = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, match_key string")
    records = spark.createDataFrame(
        [
            (10, "a", 1, "done"),
            (11, "a", 1, "done"),
            (12, "b", 1, "failed"),
            (13, "c", 1, "done"),
            (14, "d", 2, "done"),
        ],
        "id long, match_key string, destination_id long, status string",
    )
    links = spark.createDataFrame(
        [(10, 100), (13, 100), (13, 101), (14, 100)], "backup_record_id long, backup_archive_id long"
    )
    archives = spark.createDataFrame(
        [(100, "A", 5, False, None, "pA"), (101, "B", None, False, None, "pB")],
        "id long, archive_id string, indexed_at long, encrypted boolean, key_version_id long, path string",
    )
    listing = spark.createDataFrame([("pA",), ("pB",)], "key string")
    assert {
        r["id"]: r["record_id"] for r in backup.adopt_existing(
            candidates, records, links, archives, listing, 1, False, None
        ).collect()
    } == {1: 10, 2: None, 3: None, 4: None}


def test_seal_and_unseal(spark):
    key, nonce = F.lit(bytes(range(32))), F.lit(bytes(12))
    token = content.seal(F.lit("paths"), key, nonce, F.lit("ctx"))
    df = spark.range(1).select(
        content.unseal(token, key, F.lit("ctx")).alias("a"),
        content.unseal(token, key, F.lit("other")).alias("b"),
        content.unseal(F.lit("!!"), key, F.lit("ctx")).alias("c"),
    )
    assert tuple(df.first()) == ("paths", None, None)


def test_hashes_and_compression(spark):
    data = [
        (1, "txt", b"a" * 5000), (2, "mkv", b"a" * 5000), (3, "txt", hashlib.sha256(b"x").digest()), (4, "txt", b"")
    ]
    files = spark.createDataFrame(data, "id long, extension string, content binary")
    packed = {r["id"]: (bytes(r["stored"]), r["compressed"]) for r in content.gzip_plan(files).collect()}
    assert gzip.decompress(packed[1][0]) == b"a" * 5000
    assert [packed[k][1] for k in (1, 2, 3, 4)] == [True, False, False, False]
    crc = {r["id"]: r["c"] for r in files.select("id", content.crc32c("content").alias("c")).collect()}
    assert spark.createDataFrame(
        [(b"123456789",)], "content binary"
    ).select(content.crc32c("content")).first()[0] == "4waSgw=="
    assert crc[4] == "AAAAAA=="
    big = b"q" * ((1 << 20) + 10)
    expected = hashlib.blake2b(str(len(big)).encode() + big[: 1 << 20] + big[1 << 20 :], digest_size=32).hexdigest()
    assert spark.createDataFrame([(big,)], "content binary").select(
        content.fingerprint("content")
    ).first()[0] == expected


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    mutations.publish(spark, spark.range(3), root, "t", 1)
    mutations.publish(spark, spark.range(5), root, "t", 2)
    assert mutations.read_current(spark, root, "t").count() == 5
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        mutations.publish(spark, spark.range(1), root, "t", 2)


def test_rotating_to_the_same_key_changes_nothing(spark):
    keys = spark.createDataFrame(
        [(1, "p", "s", 5, None)], "id long, password string, kdf_salt string, created_at long, retired_at long"
    )
    assert rows(mutations.rotate_key(keys, "p", "s", 9)) == rows(keys)
    assert [r["retired_at"] for r in mutations.rotate_key(keys, "q", "s", 9).orderBy("id").collect()] == [9, None]
