"""Near duplicates by SimHash, found with vantage-point trees.

Fingerprints are computed where the documents lie. Equal ones are folded to one row first, so a group of copies of any
size is one point. A tree fitted on a bounded sample splits the points by Hamming distance from vantage points into
shards of even size; a point whose distance is within the search radius of a split also visits the shard beyond it,
because only there can the triangle bound leave partners. Visits go to higher shards alone, as a pair needs to meet
once. A task searches its shard with a tree of its own and returns a forest of links, never all pairs. Components come
from alternating star contraction of the links.

Defined results: NULL, empty and blank texts have the fingerprint zero and are linked like any other. Fewer words than a
shingle make one shingle. NULL ids take part; a component
with no other ids has a NULL name. Repeated rows give repeated rows. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import NO_ID, bounded_batches, doc_key, partitions, stored

#: The tree is fitted on at most about this many fingerprints, with at least SAMPLE_LEAF of them in a shard.
SAMPLE_ROWS, SAMPLE_LEAF = 200_000, 16
#: Points in a shard: no fewer than this, more where the sample is the bound.
SHARD_ROWS = 512
#: Shards of this size or less are compared directly inside a task.
DIRECT = 1024
EDGE_SCHEMA = "u long, v long"


def simhash(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """64 bits, each set if over half of the shingles' XXH64 values have it set; zero without words."""
    w = text.lower().split() if text else []
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h), bitorder="little").tobytes(), "little")


def _prints(words, seed):
    def run(batches):
        for b in batches:
            out = np.array([simhash(x, words, seed) for x in b.column(2).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.view(np.int64))], names=["doc_id", "t", "fp"])
    return run


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, t (hash of the text, as in `doc_key`), fp: one row per document."""
    ship(__name__)
    bounded_batches(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("long"), doc_key()[1].alias("t"), F.col("text"))
            .mapInArrow(_prints(words, seed), "doc_id long, t long, fp long"))


# ---- the tree: nodes of (vantage point, cut); points at most `cut` away go left, others right ----

def distance(x: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(x ^ v)


def split(points: np.ndarray, radius: int, rng) -> tuple[np.uint64, int] | None:
    """The vantage point and cut that leave the fewest points within the radius of the cut, for halves that are not too
    uneven; None if most points would have to visit both sides."""
    best = None
    n = len(points)
    candidates = np.concatenate([rng.choice(points, min(12, n), replace=False), rng.integers(0, 1 << 63, 4).astype(np.uint64)])
    for v in candidates:
        seen = np.bincount(distance(points, v), minlength=65)
        below = np.cumsum(seen)
        for cut in range(64):
            left, both = below[cut], seen[max(0, cut - radius + 1):cut + radius + 1].sum()
            if min(left, n - left) >= 0.3 * n and (best is None or both < best[0]):
                best = (both, v, cut)
    if best is None or best[0] > 0.8 * n:
        return None
    return best[1], best[2]


def grow(points: np.ndarray, leaf: int, radius: int, rng):
    """Nested (vantage, cut, left, right) or None for a leaf."""
    if len(points) <= leaf or (s := split(points, radius, rng)) is None:
        return None
    v, cut = s
    near = distance(points, v) <= cut
    return v, cut, grow(points[near], leaf, radius, rng), grow(points[~near], leaf, radius, rng)


def place(tree, points: np.ndarray, home: np.ndarray, radius: int, first: int = 0):
    """Yields (shard, indices, whether each is at home there); returns the number of shards through the last item.
    A visitor goes wherever a partner may be at home, but only behind its own home."""
    def down(node, idx, at_home, shard):
        if node is None:
            yield shard, idx, at_home
            return shard + 1
        v, cut, left, right = node
        d = distance(points[idx], v).astype(np.int16)
        near = d <= cut
        # left: those at home there, and visitors from before that may have partners there
        go = near & at_home | ~at_home & (d <= cut + radius)
        shard = yield from down(left, idx[go], at_home[go], shard)
        # right: those at home there, and all within reach of it
        go = ~near | (d > cut - radius)
        shard = yield from down(right, idx[go], at_home[go] & ~near[go], shard)
        return shard

    return down(tree, np.arange(len(points)), home, first)


def _shards(tree, radius):
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            points = fp.view(np.uint64)
            for shard, idx, at_home in place(tree.value, points, np.ones(len(fp), bool), radius):
                if len(idx):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(idx), shard, np.int32)), pa.array(fp[idx]), pa.array(at_home)], names=["shard", "fp", "home"])
    return run


def links(points: np.ndarray, home: np.ndarray, radius: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, at least one of them at home; repeats of a pair may occur."""
    found = []
    stack = [(np.arange(len(points)), home)]
    while stack:
        idx, own = stack.pop()
        here = idx[own]
        if not len(here):
            continue
        s = split(points[here], radius, rng) if len(here) > DIRECT else None
        if s is None:
            p, q = points[idx], points[here]
            for i in range(0, len(q), 256):
                a, b = np.nonzero(np.bitwise_count(q[i:i + 256, None] ^ p[None, :]) <= radius)
                x, y = here[i + a], idx[b]
                away = ~own[b]
                ok = away | (x < y)
                found.append((x[ok], y[ok]))
            continue
        v, cut = s
        d = distance(points[idx], v).astype(np.int16)
        near = d <= cut
        go = near & own | ~own & (d <= cut + radius)
        stack.append((idx[go], own[go]))
        go = ~near | (d > cut - radius)
        stack.append((idx[go], own[go] & ~near[go]))
    return found


def forest(n: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Union of the pairs as (member, smallest member of its component) for members that are not it."""
    root = np.arange(n)
    for x, y in pairs:
        while len(x):
            rx, ry = root[x], root[y]
            keep = rx != ry
            x, y, rx, ry = x[keep], y[keep], rx[keep], ry[keep]
            if not len(x):
                break
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while (root[root] != root).any():
                root = root[root]
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def _search(radius):
    def settle(rows):
        fp, home = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        points = fp.view(np.uint64)
        a, b = forest(len(fp), links(points, home, radius, np.random.default_rng(7)))
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["u", "v"])

    def run(batches):
        """Rows come sorted by shard."""
        now, rows = None, []
        for b in batches:
            shard, fp, home = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for i, j in zip(cuts, cuts[1:]):
                if j == i:
                    continue
                if rows and shard[i] != now:
                    yield settle(rows)
                    rows = []
                now = shard[i]
                rows.append((fp[i:j], home[i:j]))
        if rows:
            yield settle(rows)
    return run


def near_links(points: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) such that any two within the radius are connected."""
    ship(__name__)
    spark = points.sparkSession
    n = points.count()
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    picked = points.filter(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = np.array([r.fp for r in picked.collect()], np.int64).view(np.uint64)
    rng = np.random.default_rng(7)
    tree = grow(np.sort(sample), max(SAMPLE_LEAF, int(SHARD_ROWS * share)), radius, rng)
    held = spark.sparkContext.broadcast(tree)
    placed = points.select("fp").mapInArrow(_shards(held, radius), "shard int, fp long, home boolean")
    return (placed.repartition(partitions(spark), "shard").sortWithinPartitions("shard")
            .mapInArrow(_search(radius), EDGE_SCHEMA))


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of `edges` (u, v), by alternating large-star and small-star steps over stored tables."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = None
    while True:
        # every larger neighbour hangs on the smallest neighbour
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every node and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low)).distinct()
        now = stored(small, "stars")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            return now.select("u", F.col("v").alias("root"))
        before = mark


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """doc_id, t, fp, root (a fingerprint that names the component) and component_id (the smallest doc_id linked through
    any chain) for every document."""
    prints = stored(fingerprints(docs, words, seed), "prints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "points")
    roots = components(near_links(points, radius))
    linked = points.join(roots, points.fp == roots.u, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    table = stored(linked.join(named, "root").select("fp", "root", "component_id"), "named")
    return prints.join(table, "fp")


def keep_first(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """`docs` with one document of each component: that of the smallest id, a row without id only where no other row is
    in the component, one row where rows repeat."""
    found = near_duplicates(docs, words, seed, radius)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t")).alias("k"))
    first = first.select(F.coalesce("k.doc_id", F.lit(NO_ID)).alias("__d"), F.col("k.t").alias("__t"))
    d, t = doc_key()
    return (docs.withColumns({"__d": d, "__t": t}).join(first, ["__d", "__t"], "left_semi")
            .dropDuplicates(["__d", "__t"]).drop("__d", "__t"))
