"""Listing, event polls, objects, ranges, archives and streaming restores over real files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random
import tarfile
from pathlib import Path

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from stowage.operators import content, ledger
from stowage.sources import events, listing, objects


def put(root, key, data):
    path = root / key
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_listing_gives_every_file_and_only_looks_where_the_prefix_leads(spark, tmp_path):
    names = [f"a{i % 3}/b{i % 2}/f{i}.TXT" for i in range(40)] + ["top.tar.gz", ".hidden", "a1/mid", "a1/b0/deep/er/x.Md", "odd name/é%20.txt"]
    for n in names:
        put(tmp_path, n, n.encode())
    (tmp_path / "empty").mkdir()
    for options in ({}, {"page": 3, "partitions": 2}, {"partitions": 1}):
        got = {r.path: r for r in listing.list_files(spark, str(tmp_path), **options).collect()}
        assert sorted(got) == sorted(names)
    assert got["top.tar.gz"].suffix == "gz" and got[".hidden"].suffix == "" and got["a1/b0/deep/er/x.Md"].suffix == "md"
    assert all(r.size == len(r.path.encode()) and r.mtime_us > 0 and r.name == r.path.rpartition("/")[2] for r in got.values())
    some = listing.list_files(spark, str(tmp_path)).filter(F.col("path").startswith("a1/b") & (F.col("size") > 3))
    assert {r.path for r in some.collect()} == {n for n in names if n.startswith("a1/b")}
    assert "PushedFilters: [StringStartsWith(path,a1/b)]" in some._jdf.queryExecution().toString() or "StringStartsWith(path,a1/b)" in some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    reader = listing.ListingReader(str(tmp_path))
    list(reader.pushFilters([listing.StringStartsWith(("path",), "a1/b0")]))
    assert {p.path for p in reader.partitions()} == {"a1", "a1/b0", "a1/b0/deep", "a1/b0/deep/er"}
    assert listing.list_files(spark, str(tmp_path / "nowhere")).count() == 0


def test_polls_give_each_event_once_whatever_is_restarted(spark, tmp_path):
    table = spark.range(100).select(F.col("id"), F.lit("info").alias("level"), F.concat(F.lit("t"), "id").alias("title"), (F.col("id") * 2).alias("created_us"), F.lit(1).alias("other"))
    nulls = table.limit(1).withColumn("id", F.lit(None).cast("long"))
    table.unionByName(nulls).repartition(5).write.parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(4):
        polled = events.poll_stream(spark, f"{tmp_path}/in", after=30, page=20).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        polled.option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert seen == [list(range(31, 51)), list(range(31, 71)), list(range(31, 91)), list(range(31, 100))]
    reader = events.EventPoll(f"{tmp_path}/in", 0, 20)
    assert [r[0] for r in reader.readBetweenOffsets({"after": 30}, {"after": 50})] == list(range(31, 51))


class Counted:
    """A file system that counts reads."""

    def __init__(self, root):
        self.store, self.reads = fs.LocalFileSystem(), []

    def open_input_file(self, path):
        file, reads = self.store.open_input_file(path), self.reads

        class File:
            def read_at(self, n, at):
                reads.append((at, n))
                return file.read_at(n, at)

            def close(self):
                file.close()

        return File()


def test_ranges_are_merged_served_from_memory_and_fall_through(tmp_path):
    data = bytes(range(256)) * 4096
    put(tmp_path, "k", data)
    store = Counted(tmp_path)
    cache = objects.Ranges(store, str(tmp_path))
    cache.open("k")
    cache.prefetch([(0, 100), (1000, 100), (2000, 100), (3000, 100)])
    assert store.reads == [(0, 3100)]
    assert cache.read(2000, 100) == data[2000:2100] and len(store.reads) == 1
    assert cache.read(5000, 10) == data[5000:5010] and len(store.reads) == 2
    cache.prefetch([(0, 100), (3 * objects.MERGE_GAP, 100)])
    assert len(store.reads) == 4
    small = objects.Ranges(store, str(tmp_path), most=1000)
    small.open("k")
    small.prefetch([(0, 600), (700, 600)])
    assert [n for _, n in store.reads[4:]] == [600] and small.read(700, 600) == data[700:1300]


def test_ranges_of_many_readers_cost_few_requests(spark, tmp_path):
    rng = random.Random(3)
    blobs = {f"o/{i}": rng.randbytes(900_000) for i in range(3)}
    for k, b in blobs.items():
        put(tmp_path, k, b)
    wanted = [(k, rng.randrange(0, 800_000), rng.randrange(0, 2000), n) for k in blobs for n in range(60)] + [("o/0", 899_990, 100, 1), ("gone", 5, 5, 2)]
    df = spark.createDataFrame(wanted, "key string, offset long, length long, who int").repartition(5)
    got = objects.read_ranges(df, str(tmp_path)).collect()
    assert len(got) == len(wanted)
    assert all((r.data is None) if r.key == "gone" else bytes(r.data) == blobs[r.key][r.offset : r.offset + r.length] for r in got)
    assert sum(r.requests for r in got) <= 3 * len(blobs)


def test_tars_are_streamed_and_say_where_members_lie(spark, tmp_path):
    rng = random.Random(4)
    members = [(f"x/{i % 3}.tar", f"m{i}-" + "n" * (i % 2 * 150) + "é" * (i % 5 == 0), i, rng.randbytes(i * 37 % 3000)) for i in range(40)]
    df = spark.createDataFrame(members, "archive string, member string, n long, content binary")
    got = objects.put_tars(df, str(tmp_path)).collect()
    for r in got:
        want = next(m[3] for m in members if m[1] == r.member)
        assert (tmp_path / r.archive).read_bytes()[r.offset : r.offset + r.size] == want
    for i in range(3):
        with tarfile.open(tmp_path / f"x/{i}.tar") as tar:
            assert [m.name for m in tar] == [m[1] for m in sorted(members, key=lambda m: m[2]) if m[0] == f"x/{i}.tar"]
    assert sorted(os.listdir(tmp_path / "x")) == ["0.tar", "1.tar", "2.tar"]


def plain_crc(data):
    crc = 0xFFFFFFFF
    table = content._crc_table().tolist()
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ crc >> 8
    return base64.b64encode((crc ^ 0xFFFFFFFF).to_bytes(4, "big")).decode()


def test_checksums_of_pieces_are_those_of_the_whole(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i, n in enumerate([0, 1, 9, 1023, 1024, 1025, 5000, 70_001]):
        data = rng.randbytes(n)
        want[i] = (n, plain_crc(data))
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(i * 3))}) if n else [0, 0]
        rows += [(i, a, data[a:b]) for a, b in zip(cuts, cuts[1:])]
    want[99] = (30, None)
    rows += [(99, 0, b"x" * 10), (99, 20, b"y" * 10)]  # a gap
    rng.shuffle(rows)
    got = content.crc32c_of_pieces(spark.createDataFrame(rows, "id long, offset long, data binary").repartition(4)).collect()
    assert {r.id: (r.size, r.crc32c) for r in got} == want
    assert plain_crc(b"123456789") == "4waSgw=="  # the published check value


def parts_of(spark, rows):
    return spark.createDataFrame(rows, "id long, part int, key string, offset long, length long, whole boolean, sha256 string, compressed boolean, seal binary, name string")


def test_restore_streams_in_order_and_tells_damage_from_loss(spark, tmp_path):
    data = os.urandom(50_000) + b"z" * 50_000
    packed, sha = gzip.compress(data, mtime=0), hashlib.sha256(data).hexdigest()
    rows, bad = [], bytearray(data)
    bad[777] ^= 1

    def store(ident, blob, compressed=False, wanted=sha, cuts=3):
        step = max(1, -(-len(blob) // cuts))
        for k in range(cuts):
            put(tmp_path, f"in/{ident}/{k}", b"##" + blob[k * step : (k + 1) * step])
            rows.append((ident, k, f"{ident}/{k}", 2, len(blob[k * step : (k + 1) * step]), False, wanted, compressed, None, f"f{ident}"))

    store(1, data)
    store(2, packed, True)
    store(3, bytes(bad))
    store(4, packed[:-5], True)
    store(5, packed + packed, True)  # two members, twice the content
    store(6, b"", wanted=hashlib.sha256(b"").hexdigest())
    store(7, data)
    (tmp_path / "in/7/1").unlink()
    store(8, data)
    put(tmp_path, "in/8/2", b"##short")
    store(9, b"no gzip at all", True)
    store(10, packed[:40] + b"\0" * 40 + packed[80:], True)
    got = {r.id: (r.verdict, r.bytes) for r in content.restore_streams(parts_of(spark, rows).repartition(4), str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    n = len(data)
    assert got == {1: ("ok", n), 2: ("ok", n), 3: ("mismatch", 0), 4: ("mismatch", 0), 5: ("mismatch", 0), 6: ("ok", 0), 7: ("missing", 0), 8: ("missing", 0), 9: ("mismatch", 0), 10: ("mismatch", 0)}
    assert sorted(os.listdir(tmp_path / "out")) == ["f1", "f2", "f6"] and (tmp_path / "out/f2").read_bytes() == data


@pytest.mark.parametrize("chunk", [100, 4096])
def test_sealed_parts_open_across_their_cuts(spark, tmp_path, chunk):
    data = os.urandom(10_000)
    sha, key = hashlib.sha256(data).hexdigest(), os.urandom(32)
    files = spark.createDataFrame([(1, data, key, b"abcd")], "id long, content binary, key binary, prefix binary")
    chunks = content.encrypt_blob(files, chunk).orderBy("i").collect()
    blob = bytes(chunks[0].header) + b"".join(bytes(c.sealed) for c in chunks)
    rows, at = [], 0
    for k, n in enumerate([7, 30, 4000, 5, len(blob)]):
        piece = blob[at : at + n]
        put(tmp_path, f"{k}", piece)
        rows += [(i, k, f"{k}", 0, len(piece), False, sha, False, s, "") for i, s in ((1, key), (2, os.urandom(32)))]
        at += n
    put(tmp_path, "cut", blob[: 20 + chunk + 16])  # whole chunks, but fewer than the header says
    rows.append((3, 0, "cut", 0, 20 + chunk + 16, False, sha, False, key, ""))
    put(tmp_path, "head", blob[:11])
    rows.append((4, 0, "head", 0, 11, False, sha, False, key, ""))
    got = {r.id: r.verdict for r in content.restore_streams(parts_of(spark, rows), str(tmp_path)).collect()}
    assert got[1] == "ok" and got[2] == got[3] == "mismatch" and got[4] in ("mismatch", "missing")


def test_blobs_streamed_into_files_tell_damage(spark, tmp_path):
    data = bytes(range(256)) * 5
    files = spark.createDataFrame([(1, data, bytes(32), b"abcd"), (2, data, bytes(32), b"efgh"), (3, b"", bytes(32), b"ijkl"), (4, data, bytes(32), b"mnop")], "id long, content binary, key binary, prefix binary")
    chunks = content.encrypt_blob(files, 500).withColumn("key", F.col("id").cast("string"))
    heads = chunks.filter("i = 0").select("key", F.lit(-1).alias("i"), F.col("header").alias("data"))
    kept = chunks.filter("not (id = 2 and i = 2) and not (id = 4 and i = 0)").select("key", "i", F.col("sealed").alias("data"))
    put = {r.key: r.size for r in objects.put_streams(heads.unionByName(kept).repartition(3), str(tmp_path)).collect()}
    assert put["1"] == 20 + len(data) + 3 * 16 and put["3"] == 36
    sha = {1: data, 2: data, 3: b"", 4: data}
    rows = [(i, 0, str(i), 0, put[str(i)], False, hashlib.sha256(sha[i]).hexdigest(), False, bytes(32), "") for i in sha]
    got = {r.id: (r.verdict, r.digest) for r in content.restore_streams(parts_of(spark, rows), str(tmp_path)).collect()}
    assert got == {i: ("ok", hashlib.sha256(sha[i]).hexdigest()) if i in (1, 3) else ("mismatch", None) for i in sha}


def test_files_are_compressed_and_sealed_from_file_to_file(spark, tmp_path):
    noise = os.urandom(300_000)
    given = {"a/text": b"la la " * 400_000, "a/noise": noise, "empty": b"", "song.mp3": b"x" * 5000, "half": noise + b"z" * 20_000 + noise}
    for k, data in given.items():
        put(tmp_path, f"in/{k}", data)
    files = spark.createDataFrame([(k, "mp3" if k == "song.mp3" else "txt", bytes(32), b"abcd") for k in given], "key string, extension string, seal binary, prefix binary")
    packed = content.gzip_files(files, str(tmp_path / "in"), str(tmp_path / "packed"))
    told = {r.key: (r.size, r.compressed) for r in packed.collect()}
    assert {k for k, (_, c) in told.items() if c} == {"a/text"} and gzip.decompress((tmp_path / "packed/a/text").read_bytes()) == given["a/text"]
    assert all(told[k][0] == len(given[k]) for k in given if k != "a/text") and os.listdir(tmp_path / "packed/a") == ["text"]
    both = packed.join(files, "key")
    for compressed, place in ((True, "packed"), (False, "in")):
        some = both.filter(F.col("compressed") == compressed)
        sealed = {r.key: r.size for r in content.seal_files(some, str(tmp_path / place), str(tmp_path / "sealed"), 4096).collect()}
        assert sealed == {k: n + 20 + 16 * max(1, -(-n // 4096)) for k, (n, c) in told.items() if c == compressed}
    rows = [(i, 0, k, 0, (tmp_path / "sealed" / k).stat().st_size, False, hashlib.sha256(given[k]).hexdigest(), told[k][1], bytes(32), "") for i, k in enumerate(given)]
    assert {r.verdict for r in content.restore_streams(parts_of(spark, rows), str(tmp_path / "sealed")).collect()} == {"ok"}


def test_a_large_object_is_never_whole_in_a_worker(spark, tmp_path):
    """384 MB in parts of 16 MB: the workers' memory stays under what the object alone would take."""
    piece, n = os.urandom(1 << 20) * 16, 24
    sha = hashlib.sha256()
    for k in range(n):
        put(tmp_path, f"big/{k}", piece)
        sha.update(piece)
    rows = [(1, k, f"big/{k}", 0, len(piece), False, sha.hexdigest(), False, None, "") for k in range(n)]
    import psutil

    peak, done = [0], []
    import threading

    def watch():
        me = psutil.Process()
        while not done:
            for p in me.children(recursive=True):
                try:
                    if "pyspark" in " ".join(p.cmdline()) and "java" not in p.name():
                        peak[0] = max(peak[0], p.memory_info().rss)
                except psutil.Error:
                    pass
            done or threading.Event().wait(0.05)

    thread = threading.Thread(target=watch)
    thread.start()
    got = content.restore_streams(parts_of(spark, rows), str(tmp_path)).collect()
    done.append(1)
    thread.join()
    assert [(r.verdict, r.bytes) for r in got] == [("ok", n * len(piece))]
    assert peak[0] < 500 << 20, peak


def test_ends_of_split_sealed_and_compressed_records(spark, tmp_path):
    """60 small records in one archive: all match, with three requests at most."""
    rng = random.Random(9)
    rows, local, links, blob = [], [], [], b""
    for i in range(60):
        data = rng.randbytes(500 + i) if i % 2 else bytes([65 + i % 9]) * (900 + i)
        stored = data if i % 2 else gzip.compress(data, mtime=0)
        links.append((i, 0, "a", len(blob), len(stored)))
        blob += stored + b"\0" * 100
        rows.append((i, i % 2 == 0, None))
        local.append((i, len(data), __import__("zlib").crc32(data), data))
    put(tmp_path, "a", blob)
    records = spark.createDataFrame(rows, "id long, compressed boolean, seal binary")
    files = spark.createDataFrame(local, "backup_record_id long, size long, crc long, content binary")
    linked = spark.createDataFrame(links, "backup_record_id long, part_index int, backup_archive_id string, archive_offset long, archive_length long")
    archives = spark.createDataFrame([("a", "a", "a", 1, False)], "id string, path string, archive_id string, indexed_at int, encrypted boolean")
    ends = ledger.read_ends(records, linked, archives, str(tmp_path)).cache()
    assert ends.agg(F.sum("requests")).first()[0] <= 3
    assert {r.sound for r in ledger.sampled_ends(ends, records, files).collect()} == {True}
    other = files.withColumn("content", F.when(F.col("backup_record_id") < 4, F.concat(F.substring("content", 1, 200), F.lit(b"!"), F.substring("content", 202, 5000))).otherwise(F.col("content")))
    bad = {r.backup_record_id for r in ledger.sampled_ends(ends, records, other).collect() if not r.sound}
    assert bad == {0, 1, 2, 3}
    assert {r.sound for r in ledger.sampled_ends(ends, records, files.limit(0)).collect()} == {True}  # local files gone


def test_a_wrong_size_shows_against_the_file_and_a_wrong_checksum_always(spark, tmp_path):
    """Of a stream that the sample holds whole: its size is judged against the file only, as that of longer ones is."""
    data = b"one and the same line of text\n" * 9
    whole = gzip.compress(data, mtime=0)
    stored = [whole, whole[:-1] + bytes([whole[-1] ^ 255]), whole[:-8] + bytes([whole[-8] ^ 255]) + whole[-7:]]
    for i, blob in enumerate(stored):
        put(tmp_path, f"o{i}", blob)
    records = spark.createDataFrame([(i, True, None) for i in range(3)], "id long, compressed boolean, seal binary")
    links = spark.createDataFrame([(i, 0, f"o{i}", 0, len(whole)) for i in range(3)], "backup_record_id long, part_index int, backup_archive_id string, archive_offset long, archive_length long")
    archives = spark.createDataFrame([(f"o{i}", f"o{i}", f"o{i}", 1, False) for i in range(3)], "id string, path string, archive_id string, indexed_at int, encrypted boolean")
    files = spark.createDataFrame([(i, len(data), __import__("zlib").crc32(data), data) for i in range(3)], "backup_record_id long, size long, crc long, content binary")
    ends = ledger.read_ends(records, links, archives, str(tmp_path), 512)
    for local, sound in ((files, {0}), (files.limit(0), {0, 1})):
        assert {r.backup_record_id for r in ledger.sampled_ends(ends, records, local).collect() if r.sound} == sound


def test_equal_contents_of_one_archive_each_have_an_entry(spark):
    """Four records of one content: at their own offsets, one compressed; two more are nowhere in the index."""
    rows = [(0, 512, None), (1, 2048, None), (2, 4096, "gzip"), (3, 9999, None), (4, 512, "gzip")]
    records = spark.createDataFrame([(i, i, "s", c) for i, _, c in rows], "id long, media_file_id long, sha256 string, compression string")
    links = spark.createDataFrame([(i, 0, "a", at, 100) for i, at, _ in rows], "backup_record_id long, part_index long, backup_archive_id string, archive_offset long, archive_length long")
    archives = spark.createDataFrame([("a", "a", "a", 1, False, "clump", 9, None)], "id string, path string, archive_id string, indexed_at int, encrypted boolean, archive_type string, size_bytes long, crc32c string")
    found = spark.createDataFrame([("a", 9, None)], "key string, size long, crc32c string")
    entries = spark.createDataFrame([("a", "s", at, c) for _, at, c in rows[:3]], "archive_id string, entry_key string, entry_offset long, entry_compression string")
    local = spark.createDataFrame([(i, True) for i in range(5)], "media_file_id long, same boolean")
    got = ledger.verify_shallow(records, links, archives, found, entries, F.col("sha256"), local)
    assert sorted((r.id, r.verdict) for r in got.collect()) == [(0, "match"), (1, "match"), (2, "match"), (3, "mismatch"), (4, "mismatch")]


def test_what_was_settled_goes_when_it_is_cleared(spark):
    from pathlib import Path

    from stowage import session

    kept = session.settle(spark.range(3), "some")
    folder = Path(session.shared_dir(spark).removeprefix("file://"))
    assert kept.count() == 3 and folder.is_dir()
    session.clear(spark)
    assert not folder.exists() and session.settle(spark.range(2), "some").count() == 2


def test_the_vault_keeps_one_copy_of_contents(spark):
    """As prepared; pieces and members are taken from there, and what else is settled has no content."""
    from stowage.plans import vault
    from stowage.session import shared_dir
    from stowage.sources.views import Tables
    from tests.conftest import SMALL

    folder = Path(shared_dir(spark))
    before = set(folder.glob("*-*")) if folder.exists() else set()
    vault._vault(Tables(spark, SMALL))
    held = [p.name.split("-")[0] for p in set(folder.glob("*-*")) - before if list(p.glob("*.parquet")) and {"content", "stored"} & set(spark.read.parquet(str(p)).columns)]
    assert held == ["prepared"]
