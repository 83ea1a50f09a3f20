"""Groups of texts whose word shingle sets have a Jaccard similarity of 4/5 or more, exactly.

1. Rows with one shingle set are one point, named by the smallest of their numbers.
2. Prefix filter: with the shingles of all sets in one order, two sets that are 4/5 alike share a shingle among the
   first
   n - ceil(4n / 5) + 1 of each. So points meet in buckets, one for each shingle that several prefixes have, and no
   such pair is missed
   at any number of points. The order takes common shingles last. They are named by a sample, which sets the
   size of
   buckets and nothing else. Buckets of the same points (a passage's shingles, say) are one bucket. A pair whose first common
   shingle is at i and j of m and n shares at most min(m - i, n - j), so a bucket far down in both prefixes pairs nobody.
3. Links that another search found (SimHash fingerprints, say) come first, as they are or tested. While buckets would make many
   pairs for their size, a few rounds test each component
   against the leaders of some of its buckets, as long as that joins components, so a dense bucket becomes few components at
   a linear cost; all links of a round are tested at once and components are found once a round. Last, all pairs of a bucket
   that are still in different components are tested. Pairs within one component can't change the groups and are left out.
4. Before that, a bucket that would still make more than MANY pairs a row (near copies of one text, alike to it but often not to each
   other) is seen from a leader, one of its points, and all its points are tested against that. Sets of m and n shingles
   that differ from the leader's in d and e shingles are 4/5 alike if they have (d + e - (m + n) / 9) / 2 of these differences in
   common, or more. Where that is 0 or less both are alike to the leader, and are linked by it. All other pairs have a difference in
   common, so points meet
   in buckets of differences, rare ones first, by the same prefix filter (the sets themselves are their differences from an empty leader).
   Buckets of one leader become one.
5. A test takes two steps. A sketch counts a set's shingles in each of 256 bins; the sum of the bins' smaller counts
   bounds what two sets share,
   so pairs under it go without their sets being moved. What passes is tested on the whole sets.

Defined cases: null texts and texts without a word have the empty set and are alike; a text of fewer words than a
shingle has one shingle, all its words;
repeated rows are one point; a set of any size is tested whole; an empty table gives no rows. Only n and text are read,
so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm import kernels as K
from stowage.llm.common import cut, drop, text_bytes
from stowage.llm.components import components

#: A shingle is common if COMMON documents of the sample have it, which is one in SHARE of all documents at every size, so buckets of
#: other shingles hold about SHARE * COMMON documents however many there are. The most that are named, so that what is broadcast stays
#: under 16 MB.
SHARE, COMMON, MOST_COMMON = 4, 6, 2_000_000
#: Rounds against leaders end when one joins fewer of its pairs than this share, or after so many; a component is tested
#: against so many leaders a round. No round is held where buckets make at most FEW pairs a row.
WORTH, STAR_ROUNDS, LEADERS, FEW = 0.1, 3, 4, 4
#: Buckets of more pairs a row than MANY are seen from a leader.
MANY = 16
BINS = 256
#: Bits of a shingle's hash that name its bucket: less to write, and shingles that share a bucket by chance only add
#: candidates.
BUCKET = np.uint64((1 << 44) - 1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, those in common (sorted) last and else by hash; and where each
    document starts.
    """
    part, n_docs = K.LOWER[raw], len(offsets) - 1
    starts, ends, first = K.spans(part, offsets)
    words = K.word_hashes(part, starts, ends)
    n = np.diff(first)
    counts = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    hashes = K.ngram_hashes(words, size)
    for d in np.flatnonzero((n > 0) & (n < size)):  # the whole sequence
        hashes[first[d]] = K.ngram_hashes(words[first[d] : first[d + 1]], int(n[d]))[0]
    hashes = hashes[np.arange(len(words)) < np.repeat(first[:-1] + counts, n)]
    doc = np.repeat(np.arange(n_docs), counts)
    last = common[
        np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    ] == hashes if len(common) else np.zeros(len(hashes), bool)
    order = np.lexsort((hashes, last, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(n_docs + 1))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def whole_sets(rows: DataFrame, size: int) -> DataFrame:
    """(n, shingles) for rows (n, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = K.flat(batch.column(1))
            for lo, hi in K.parts(at):
                hashes, first = shingle_sets(
                    raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], size, np.zeros(0, np.uint64)
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), _lists(hashes, first)], ["n", "shingles"]
                )

    return rows.select("n", text_bytes("text").alias("text")).mapInArrow(run, "n long, shingles array<long>")


def sketches(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """How many hashes of each document are in each bin, a byte a bin; empty where a byte can't hold a count."""
    n = len(first) - 1
    cell = np.repeat(np.arange(n), np.diff(first)) * BINS + (K.mix(hashes) >> np.uint64(56)).astype(np.int64)
    counts = np.bincount(cell, minlength=n * BINS).reshape(n, BINS)
    return [c.astype(np.uint8).tobytes() if c.max() < 256 else b"" for c in counts]


def prefixes(rows: DataFrame, size: int, common: np.ndarray) -> DataFrame:
    """(n, x, y, size, sketch, prefix) for rows (n, text): x, y and size stand for the set, prefix holds its first
    shingles in the order.
    """
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = K.flat(batch.column(1))
            for lo, hi in K.parts(at):
                hashes, first = shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], size, shared.value)
                n = np.diff(first)
                keep = np.where(n == 0, 0, n - (4 * n + 4) // 5 + 1)
                prefix = hashes[np.arange(len(hashes)) < np.repeat(first[:-1] + keep, n)] & BUCKET
                x, y = (_sums(K.mix(hashes + np.uint64(c)), first) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(x),
                    pa.array(y),
                    pa.array(n.astype(np.int64)),
                    pa.array(sketches(hashes, first), pa.binary()),
                ]
                columns.append(_lists(prefix, np.concatenate([[0], np.cumsum(keep)])))
                yield pa.RecordBatch.from_arrays(columns, ["n", "x", "y", "size", "sketch", "prefix"])

    return rows.select("n", text_bytes("text").alias("text")).mapInArrow(
        run, "n long, x long, y long, size long, sketch binary, prefix array<long>"
    )


def common_shingles(rows: DataFrame, size: int) -> np.ndarray:
    """Shingles that several documents of the sample have."""
    sample = whole_sets(rows.filter(F.pmod(F.xxhash64("n"), F.lit(SHARE)) == 0), size)
    counts = sample.select(F.explode("shingles").alias("h")).groupBy("h").count().filter(F.col("count") >= COMMON)
    got = counts.orderBy(F.col("count").desc(), "h").limit(MOST_COMMON).select("h").toArrow()
    return np.sort(got.column("h").to_numpy().astype(np.int64).view(np.uint64))


def _possible(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow them to be 4/5 alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            total = batch.column(4).to_numpy()
            known = np.flatnonzero([len(x) == BINS == len(y) for x, y in zip(left, right)])
            keep = np.ones(batch.num_rows, bool)
            for lo in range(0, len(known), 4096):
                some = known[lo : lo + 4096]
                x, y = (
                    np.frombuffer(
                        b"".join([side[i] for i in some]), np.uint8
                    ).reshape(-1, BINS) for side in (left, right)
                )
                keep[some] = 9 * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= 4 * total[some]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = points.select(F.col("p").alias("a"), F.col("sketch").alias("s"), F.col("size").alias("m"))
    right = points.select(F.col("p").alias("b"), F.col("sketch").alias("t"), F.col("size").alias("o"))
    sized = pairs.join(left, "a").join(right, "b").filter(_near_in_size("m", "o"))
    return sized.select("a", "b", "s", "t", (F.col("m") + F.col("o")).alias("total")).mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, points: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) that are 4/5 alike, as a written table."""
    near = cut(_possible(pairs, points), "possible")
    asked = near.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    sets = cut(whole_sets(rows.join(asked, "n", "left_semi"), size), "sets")
    left = sets.select(F.col("n").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("n").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    alike = near.join(left, "a").join(right, "b").filter(9 * both >= 4 * (F.size("s") + F.size("t")))
    out = cut(alike.select("a", "b"), "links")
    drop(near, sets)
    return out


def _near_in_size(a: str, b: str):
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _can_share(rest: str, need: str, rest2: str, need2: str):
    """Whether two sets may be 4/5 alike that have a difference from their leader in common, this one and at most `rest` in all.

    need: 9 times a set's differences, less its size. Without a leader the differences are the set, and need is 8 times its size.
    """
    return 18 * F.least(rest, rest2) >= F.col(need) + F.col(need2)


def _buckets(tokens: DataFrame) -> DataFrame:
    """(h, p, size, rest, need): the buckets of several points, those of the same points as one, with the most `rest` and the least `need`
    that a point has in one of them. Buckets whose names are equal by chance are one too, which only adds candidates.
    """
    members = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("p")).alias("x"))
    named = members.filter("k > 1").select("h", F.xxhash64("k", "x").alias("g"))
    met = tokens.join(named, "h").groupBy("g", "p", "size").agg(F.max("rest").alias("rest"), F.min("need").alias("need"))
    return met.withColumnRenamed("g", "h")


def _pairs_made(buckets: DataFrame) -> DataFrame:
    """(h, n, pairs): each bucket's rows, and its pairs of points in different components."""
    members = buckets.groupBy("h", "c").agg(F.count(F.lit(1)).cast("double").alias("m"))
    each = members.groupBy("h").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("own"))
    return each.select("h", "n", ((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs"))


def _few_pairs(buckets: DataFrame) -> bool:
    """Whether the pairs of a bucket in different components are at most FEW for each row of the buckets (h, p, c)."""
    rows, pairs = _pairs_made(buckets).agg(F.sum("n"), F.sum("pairs")).first()
    return (pairs or 0) <= FEW * (rows or 0)


def _open(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Buckets (h, p, size, rest, need) with the component c of each point, without those that lie in one component, as a written
    table.
    """
    if roots is None:
        return cut(buckets.withColumn("c", F.col("p")), "open")
    named = buckets.join(roots.select(F.col("node").alias("p"), "root"), "p", "left")
    named = cut(named.select("h", "p", "size", "rest", "need", F.coalesce("root", "p").alias("c")), "named")
    several = named.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h")
    out = cut(named.join(several, "h"), "open")
    drop(named)
    return out


def _stars(buckets: DataFrame, turn: int) -> DataFrame:
    """For each component of several in a bucket LEADERS pairs, or fewer, of a member with a bucket's leader; which buckets
    and members, a hash of the turn says.
    """
    first = F.min(F.struct(F.xxhash64("c", F.lit(turn)), "c", "p", "size")).alias("m")
    leader = buckets.groupBy("h").agg(first).select(
        "h", F.col("m.c").alias("lc"), F.col("m.p").alias("l"), F.col("m.size").alias("ls")
    )
    met = buckets.join(leader, "h").filter((F.col("c") != F.col("lc")) & _near_in_size("size", "ls"))
    drawn = [F.min(F.struct(F.xxhash64("l", "p", F.lit(turn * LEADERS + k)), "l", "p")) for k in range(LEADERS)]
    some = met.groupBy("c").agg(F.array(*drawn).alias("m")).select(F.explode("m").alias("m"))
    return some.select(F.least("m.l", "m.p").alias("a"), F.greatest("m.l", "m.p").alias("b")).distinct()


def _dense(buckets: DataFrame) -> DataFrame:
    """The buckets that make more than MANY pairs a row, as a written table."""
    many = _pairs_made(buckets).filter(F.col("pairs") > MANY * F.col("n")).select("h")
    return cut(buckets.join(many, "h"), "dense")


def _led(buckets: DataFrame) -> DataFrame:
    """(l, ls, lc, p, size, c): the points of buckets with their leaders, the points of the least hash, so buckets that share many points
    often have one leader; as a written table.
    """
    first = F.min(F.struct(F.xxhash64("p"), "p", "size", "c")).alias("m")
    leader = buckets.groupBy("h").agg(first).select(
        "h", F.col("m.p").alias("l"), F.col("m.size").alias("ls"), F.col("m.c").alias("lc")
    )
    return cut(buckets.join(leader, "h").select("l", "ls", "lc", "p", "size", "c").distinct(), "led")


def _differences(led: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Buckets (h, p, size, rest, need) of the points led, by the shingles that a point or its leader has, but not both. Differences that a
    leader's points have in common are ordered by how many have them; those of one point meet nobody.
    """
    asked = led.select(F.col("p").alias("n")).distinct()
    sets = cut(whole_sets(rows.join(asked, "n", "left_semi"), size), "sets")
    own = sets.select(F.col("n").alias("p"), F.col("shingles").alias("s"))
    theirs = sets.select(F.col("n").alias("l"), F.col("shingles").alias("t"))
    apart = F.concat(F.array_except("s", "t"), F.array_except("t", "s"))
    each = led.join(own, "p").join(theirs, "l").select("l", "p", "size", apart.alias("d"))
    each = cut(each.select("l", "p", "size", F.size("d").cast("long").alias("own"), F.explode("d").alias("x")), "apart")
    drop(sets)
    shared = each.groupBy("l", "x").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    rest = F.row_number().over(Window.partitionBy("l", "p").orderBy(F.col("k").desc(), "x")).cast("long")
    placed = each.join(shared, ["l", "x"]).withColumn("rest", rest).filter("4 * rest >= 4 * own - size")
    out = cut(
        _buckets(placed.select(F.xxhash64("l", "x").alias("h"), "p", "size", "rest", F.expr("9 * own - size").alias("need"))),
        "differences",
    )
    drop(each)
    return out


def _crossed(buckets: DataFrame) -> DataFrame:
    """All pairs of a bucket that are in different components and may be alike. Components meet first, so no pair within one is made; then
    the profiles of the one that has fewer meet those of the other, a profile being all that is judged of a point. Points are named last, so
    a large component isn't laid out for each point that only some of it, or none, may be alike to.
    """
    judged = ("size", "rest", "need")

    def second(df: DataFrame) -> DataFrame:
        return df.select("h", *(F.col(x).alias(f"{x}2") for x in df.columns if x != "h"))

    profiles = cut(buckets.select("h", "c", *judged).distinct(), "profiles")
    bounds = F.min("size").alias("lo"), F.max("size").alias("hi"), F.max("rest").alias("rest"), F.min("need").alias("need")
    parts = cut(profiles.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"), *bounds), "parts")
    share = _can_share("rest", "need", "rest2", "need2")
    near = F.expr("(k < k2 or k = k2 and c < c2) and 5 * hi >= 4 * lo2 and 5 * hi2 >= 4 * lo")
    met = parts.join(second(parts), "h").filter(near & share).select("h", "c", "c2", "lo2", "hi2", "rest2", "need2")
    near = F.expr("5 * size >= 4 * lo2 and 5 * hi2 >= 4 * size")
    ones = met.join(profiles, ["h", "c"]).filter(near & share).select("h", "c", *judged, "c2")
    both = ones.join(second(profiles), ["h", "c2"]).filter(_near_in_size("size", "size2") & share)
    keys = ["c", *judged]
    points = buckets.select("h", *keys, "p")
    left = both.join(points, ["h", *keys]).select("h", *(f"{x}2" for x in keys), "p")
    pairs = left.join(second(points), ["h", *(f"{x}2" for x in keys)])
    out = cut(pairs.select(F.least("p", "p2").alias("a"), F.greatest("p", "p2").alias("b")).distinct(), "crossed")
    drop(profiles, parts)
    return out


def groups(
    rows: DataFrame, size: int = 5, known: DataFrame | None = None, linked: DataFrame | None = None
) -> DataFrame:
    """(n, root) for the written table rows (n, text), n distinct: root is the smallest n of the group.

    known: pairs (a, b) of numbers that are likely links; they are tested first and save rounds. linked: pairs (a, b) that are
    links, whatever their shingles.
    """
    found = cut(prefixes(rows, size, common_shingles(rows, size)), "prefixes")
    points = found.groupBy("x", "y", "size").agg(F.min("n").alias("p"))
    same = cut(found.select("n", "x", "y", "size").join(points, ["x", "y", "size"]).select("n", "p"), "same")
    own = found.join(same.filter("n = p").select("n"), "n", "left_semi")
    sketched = cut(own.select(F.col("n").alias("p"), "size", "sketch"), "sketches")
    tokens = own.select(F.posexplode("prefix").alias("at", "h"), F.col("n").alias("p"), "size")
    tokens = tokens.select("h", "p", "size", F.expr("size - at").alias("rest"), F.expr("8 * size").alias("need"))
    buckets = cut(_buckets(tokens), "buckets")
    drop(found)
    tested, links, roots = None, None, None

    def test(pairs: DataFrame) -> tuple[int, int]:
        """Test pairs that weren't tested yet and renew the components: how many pairs, and how many links they gave."""
        nonlocal tested, links, roots
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        n = pairs.count()
        if not n:
            return 0, 0
        new = _verify(pairs, sketched, rows, size)
        tested = pairs if tested is None else tested.union(pairs)
        links = new if links is None else links.union(new)
        got = new.count()
        if got:
            drop(roots)
            roots = cut(components(links), "roots")
        return n, got

    def of_points(pairs: DataFrame) -> DataFrame:
        left, right = same.select(
            F.col("n").alias("a"), F.col("p").alias("pa")
        ), same.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        ends = pairs.join(left, "a").join(right, "b").filter("pa <> pb")
        return ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()

    if linked is not None:
        links = cut(of_points(linked), "links")
        roots = cut(components(links), "roots")
    if known is not None:
        test(of_points(known))
    still = _open(buckets, roots)
    drop(buckets)
    for turn in range(STAR_ROUNDS):
        if _few_pairs(still):
            break
        n, got = test(_stars(still, turn))
        if got:
            buckets, still = still, _open(still.drop("c"), roots)  # a bucket in one component stays in one
            drop(buckets)
        if got <= WORTH * n:
            break
    dense = _dense(still)
    if not dense.isEmpty():
        led = _led(dense)
        star = led.filter((F.col("c") != F.col("lc")) & _near_in_size("size", "ls"))
        test(star.select(F.least("l", "p").alias("a"), F.greatest("l", "p").alias("b")).distinct())
        apart = _differences(led, rows, size)
        others = still.join(dense.select("h").distinct(), "h", "left_anti").drop("c")
        buckets, still = still, _open(others.unionByName(apart), roots)
        drop(buckets, led, apart)
    drop(dense)
    test(_crossed(still))
    drop(still, sketched)
    if roots is None:
        return same.select("n", F.col("p").alias("root"))
    named = same.join(roots.select(F.col("node").alias("p"), "root"), "p", "left")
    return named.select("n", F.coalesce("root", "p").alias("root"))
