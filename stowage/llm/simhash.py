"""Operator 2: near-duplicates by SimHash fingerprints and a forest of vantage-point trees.

1. A fingerprint has a bit for each bit position that is set in over half of the hashes of a text's word shingles.
2. Equal fingerprints are one point from here on, so exact copies of any number cost one point.
3. A vantage-point tree splits points at the median Hamming distance to a vantage point. A point x goes home to one
   leaf; every leaf that may hold a point within r of x must also see x. By the triangle inequality a branch can be
   pruned if d(x, v) - r > mu (near branch) or d(x, v) + r <= mu (far branch), so x visits the few leaves whose
   boundary it is within r of.
   In 64 dimensions distances crowd round 32 and a radius of 4 prunes little. So there is a tree for each of three
   blocks of the bits, each under the Hamming distance of its block alone: of two points at most 4 apart, some
   block has at most 1 of the differing bits (4 < 3 * 2), and in that block's tree the radius is 1. The search stays
   exact.
4. Each leaf is a shard: its home points are compared with all of its points, on all bits, and what links is handed
   on as a
   spanning forest. Connected components (components.py) then join the leaves.

The trees come from a bounded sample of points (65,536, a thousandth of very many points, at most two million of eight
bytes each) that sets only vantage points, medians and how many ways a leaf is dealt;
every point is indexed and the result doesn't depend on the sample. A leaf that no vantage point splits holds points
that are
alike in its block; it gets a forest of its own over the other bits, with three blocks again, and so on while there are
bits. A leaf that is
still too large is dealt as a grid, parts of its home points by parts of its visitors, so a group is bounded in both.

Defined cases: null and empty texts have the zero fingerprint and link like any other; a null id gets a
fingerprint and a component, but is never a component's id unless all its ids are null; rows with one id are separate
rows; a text of any length is hashed whole; an empty
table gives no rows. Only id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm import jaccard
from stowage.llm import kernels as K
from stowage.llm.common import cut, text_bytes
from stowage.llm.components import components

SAMPLE, LARGEST_SAMPLE = 65_536, 1 << 21
LEAF = 512
BLOCKS = 3


# -- fingerprints


def xxh64_fingerprint(text: bytes, size: int) -> int:
    """SimHash of one text over XXH64 (seed 42) of its shingles of `size` words, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    n = max(1, len(words) - size + 1)
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, 65_536):
        hi = min(n, lo + 65_536)
        last = [e - 1 for e in ends[lo + size - 1 : hi + size - 1]] if n > 1 or len(words) >= size else [len(joined)]
        h = np.array(
            [digest(joined[s:e], 42) for s, e in zip(starts[lo:hi], last)], dtype="<u8"
        ).view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            seen = np.bincount(h[:, lane], minlength=256)
            votes[8 * lane : 8 * lane + 8] += seen @ ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > n)


def contract_fingerprints(texts: pa.Array, size: int) -> list[bytes]:
    return [xxh64_fingerprint(t or b"", size).to_bytes(8, "big") for t in texts.to_pylist()]


def fingerprints(
    df: DataFrame,
    id_col: str,
    text_col: str,
    size: int,
    make: Callable[[pa.Array, int], list[bytes]] = contract_fingerprints,
) -> DataFrame:
    """(doc_id, fingerprint): the fingerprint as big-endian bytes."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(make(batch.column(1), size), pa.binary())], ["doc_id", "fingerprint"]
            )

    return df.select(
        F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text")
    ).mapInArrow(run, f"doc_id {kind.simpleString()}, fingerprint binary")


# -- the forest


def _points(column: pa.Array, n_words: int) -> np.ndarray:
    raw, _ = K.flat(column)
    return raw.view(">u8").astype(np.uint64).reshape(-1, n_words)


def _distance(points: np.ndarray, other: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.bitwise_count((points ^ other) & mask).sum(axis=-1, dtype=np.int16)


class Tree:
    """A vantage-point tree under the Hamming distance of the bits in mask. Node 0 is the root; children are negative
    for leaves.

    used: the bits that this tree and those above it tell apart. Leaves are numbered through all trees that share
    `ways`, a leaf's number of parts.
    """

    def __init__(
        self,
        sample: np.ndarray,
        mask: np.ndarray,
        radius: int,
        leaf: int,
        weight: float,
        used: np.ndarray | None = None,
        ways: list[int] | None = None,
    ) -> None:
        """weight: how many points one point of the sample stands for. leaf: most points wanted in a leaf."""
        self.mask, self.radius = mask, radius
        self.used = mask if used is None else used | mask
        self.vantage: list[np.ndarray] = []
        self.mu: list[int] = []
        self.children: list[list[int]] = []
        self.ways: list[int] = [] if ways is None else ways
        self.forests: dict[int, list[Tree]] = {}
        self._grow(sample, leaf, weight)

    def _grow(self, sample: np.ndarray, leaf: int, weight: float) -> None:
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            large = len(rows) * weight > leaf and len(rows) >= 8
            node = self._split(sample, rows, todo) if large else None
            if node is None:
                node = -1 - len(self.ways)
                self.ways.append(max(1, round(len(rows) * weight / (4 * leaf))))
                masks = free_masks(self.used, BLOCKS) if large and self.ways[-1] > 1 else []
                if masks:
                    self.forests[-1 - node] = [
                        Tree(sample[rows], m, self.radius, leaf, weight, self.used, self.ways) for m in masks
                    ]
            if parent >= 0:
                self.children[parent][side] = node
            else:
                self.root = node

    def _split(self, sample: np.ndarray, rows: np.ndarray, todo: list) -> int | None:
        """The vantage point whose median splits most evenly with the fewest points on the boundary, of a few tried."""
        best = None
        for pick in range(min(5, len(rows))):
            v = sample[rows[(pick * 2_654_435_761) % len(rows)]]
            d = _distance(sample[rows], v, self.mask)
            mu = int(np.median(d))
            for m in (mu - 1, mu):
                near = int((d <= m).sum())
                if 0 < near < len(rows):
                    cost = max(near, len(rows) - near) + int((np.abs(2 * d - 2 * m - 1) < 2 * self.radius).sum()) / 2
                    if best is None or cost < best[0]:
                        best = cost, v, m, d
        if best is None or best[0] > 0.98 * len(rows):
            return None
        _, v, m, d = best
        node = len(self.vantage)
        self.vantage.append(v)
        self.mu.append(m)
        self.children.append([0, 0])
        todo += [(rows[d <= m], node, 0), (rows[d > m], node, 1)]
        return node

    def route(self, points: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): every leaf that a row's ball of the radius reaches; home: the row lies in it."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [
            (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        ]
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool) if home is None else home)]
        while todo:
            node, rows, own = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                for tree in self.forests.get(-1 - node, []):
                    r, leaves, h = tree.route(points[rows], own)
                    done.append((rows[r], leaves, h))
                if -1 - node not in self.forests:
                    done.append((rows, np.full(len(rows), -1 - node), own))
                continue
            d, mu = _distance(points[rows], self.vantage[node], self.mask), self.mu[node]
            near, far = d - self.radius <= mu, d + self.radius > mu
            todo += [
                (self.children[node][0], rows[near], (own & (d <= mu))[near]),
                (self.children[node][1], rows[far], (own & (d > mu))[far]),
            ]
        return tuple(np.concatenate(x) for x in zip(*done))


def free_masks(used: np.ndarray, blocks: int) -> list[np.ndarray]:
    """The bits that aren't used dealt to blocks in turn; none if there are too few to tell points apart."""
    free = [(w, b) for w in range(len(used)) for b in range(64) if not int(used[w]) >> b & 1]
    if len(free) < 4 * blocks:
        return []
    return [
        np.array(
            [sum(1 << b for v, b in free[k::blocks] if v == w) for w in range(len(used))], np.uint64
        ) for k in range(blocks)
    ]


def block_masks(n_words: int, blocks: int) -> list[np.ndarray]:
    """The bits dealt to blocks in turn."""
    out = []
    for b in range(blocks):
        bits = range(b, 64 * n_words, blocks)
        out.append(
            np.array(
                [sum(1 << (x - 64 * w) for x in bits if 64 * w <= x < 64 * w + 64) for w in range(n_words)], np.uint64
            )
        )
    return out


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each of n points to the least point of its component under the links (i, j): at most n of what may be
    n * n.
    """
    if len(i) <= n:
        return i, j
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == label).all():
            at = np.flatnonzero(label != np.arange(n))
            return at, label[at]
        label = now


def _forest_edges(points: np.ndarray, home: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between home points and all points of a leaf, as index pairs."""
    parent = np.arange(len(points))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    homes = np.flatnonzero(home)
    block = max(1, 2_000_000 // max(1, len(points)))
    for lo in range(0, len(homes), block):
        rows = homes[lo : lo + block]
        d = np.zeros((len(rows), len(points)), np.uint8 if points.shape[1] < 4 else np.int16)
        for w in range(points.shape[1]):
            d += np.bitwise_count(points[rows, w, None] ^ points[None, :, w])
        i, j = np.nonzero(d <= within)
        i = rows[i]
        keep = i != j
        i, j = _stars(i[keep], j[keep], len(points))
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
    return np.array(a, np.int64), np.array(b, np.int64)


def link(
    points: DataFrame,
    masks: list[np.ndarray],
    radius: int,
    within: int,
    n_words: int = 1,
    leaf: int = LEAF,
    sample: int | None = None,
) -> DataFrame:
    """Links (a, b) that join all points (distinct, column fingerprint) that are at most `within` bits apart,
    as far as the trees' radius finds them: with three block masks and radius = within // 3, all of them."""
    total = points.count()
    if total < 2:
        return points.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).limit(0)
    sample = sample or min(LARGEST_SAMPLE, max(SAMPLE, total >> 10))  # more leaves for more points; a block of 21 bits has no more than that to tell apart
    every = max(4, -(-total // sample))  # at most a quarter of the points, and at most `sample` on average
    taken = points if total < 64 else points.filter(F.pmod(F.xxhash64("fingerprint"), F.lit(every)) == 0)
    drawn = np.array(sorted(bytes(r[0]) for r in taken.limit(2 * sample).collect()), dtype=object)
    picked = np.frombuffer(b"".join(drawn), ">u8").astype(np.uint64).reshape(-1, n_words)
    trees = [Tree(picked, mask, radius, leaf, total / max(1, len(picked))) for mask in masks]
    shared = points.sparkSession.sparkContext.broadcast(trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _points(batch.column(0), n_words)
            for t, tree in enumerate(shared.value):
                row, leaf, home = tree.route(x)
                ways = np.array(tree.ways)[leaf]
                part = (K.mix(x[:, 0].copy() + np.uint64(t)) % np.uint64(1 << 31)).astype(np.int64)[row] % ways
                one, dealt, own = np.flatnonzero(ways == 1), np.flatnonzero(ways > 1), np.flatnonzero((ways > 1) & home)
                # a dealt leaf is a grid: home points go to all parts of their row, and every point goes to all parts
                # of its column
                across, along = _counts(ways[own]), _counts(ways[dealt])
                own, dealt = np.repeat(own, ways[own]), np.repeat(dealt, ways[dealt])
                at = np.concatenate([one, own, dealt])
                cell = np.concatenate(
                    [np.zeros(len(one), np.int64), part[own] << 32 | across, along << 32 | part[dealt]]
                )
                is_home = np.concatenate([home[one], np.ones(len(own), bool), np.zeros(len(dealt), bool)])
                columns = [
                    pa.array(t << 40 | leaf[at]),
                    pa.array(cell),
                    batch.column(0).take(pa.array(row[at])),
                    pa.array(is_home),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["leaf", "cell", "fingerprint", "home"])

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values = group["fingerprint"].to_numpy()
        x = np.frombuffer(b"".join(values), ">u8").astype(np.uint64).reshape(-1, n_words)
        a, b = _forest_edges(x, group["home"].to_numpy(), within)
        return pd.DataFrame({"a": values[a], "b": values[b]})

    routed = points.select("fingerprint").mapInArrow(route, "leaf long, cell long, fingerprint binary, home boolean")
    return routed.groupBy("leaf", "cell").applyInPandas(search, "a binary, b binary")


def _counts(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def group_fingerprints(
    prints: DataFrame, masks: list[np.ndarray], radius: int, within: int, n_words: int = 1
) -> DataFrame:
    """(fingerprint, component_id) for the written table prints (doc_id, fingerprint)."""
    points = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "points")
    edges = cut(link(points.select("fingerprint"), masks, radius, within, n_words), "links")
    roots = cut(components(edges).filter(F.col("node") != F.col("root")), "roots")
    named = cut(
        points.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
            "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")
        ),
        "named",
    )
    ids = cut(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "ids")
    return cut(
        named.select("fingerprint", "root").join(ids, "root").select("fingerprint", "component_id"), "components"
    )


def near_duplicates(df: DataFrame, id_col: str, text_col: str, size: int = 4, within: int = 4) -> DataFrame:
    """id, fingerprint (hexadecimal) and component_id for each row; links are exact."""
    prints = cut(fingerprints(df, id_col, text_col, size), "fingerprints")
    groups = group_fingerprints(prints, block_masks(1, 3), within // 3, within)
    return prints.join(groups, "fingerprint").select(
        F.col("doc_id").alias(id_col), F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id"
    )


def candidate_links(rows: DataFrame, size: int = 5, within: int = 4) -> DataFrame:
    """Pairs (a, b) of numbers of the written table rows (n, text), n distinct: rows of equal fingerprints, and links
    of the forest.
    """
    prints = cut(fingerprints(rows, "n", "text", size), "fingerprints")
    points = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "points")
    equal = prints.join(points, "fingerprint").filter(F.col("doc_id") != F.col("least")).select(
        F.col("least").alias("a"), F.col("doc_id").alias("b")
    )
    edges = cut(link(points.select("fingerprint"), block_masks(1, 3), within // 3, within), "links")
    left, right = points.select(
        F.col("fingerprint").alias("a"), F.col("least").alias("n")
    ), points.select(F.col("fingerprint").alias("b"), F.col("least").alias("m"))
    far = edges.join(left, "a").join(right, "b").select(F.col("n").alias("a"), F.col("m").alias("b"))
    return equal.unionByName(far)


def near_copies(rows: DataFrame, size: int = 5) -> DataFrame:
    """(n, root) for the written table rows (n, text): groups of rows whose fingerprints link, or whose shingle sets are 4/5 alike.

    Fingerprints count a shingle as often as a text has it, so they link texts that are one passage many times over with another
    tail, which sets tell apart. Since 64 bits miss many pairs of alike sets, a prefix filter adds those (jaccard.py).
    """
    return jaccard.groups(rows, size, linked=cut(candidate_links(rows, size), "linked"))
