"""Remove passages of words that stand earlier in the corpus.

Every text is cut into non-overlapping blocks of `block` words, its anchors; any passage of 2 * block words or more holds
at least one whole anchor wherever it stands. All rolling windows of `block` words of all texts probe the anchors. Only
hashes travel for this, packed by document and hash bucket, and each bucket streams: its distinct anchors are in memory,
the probes pass by. A probe off the block grid that meets an anchor, and an anchor that occurs twice, is a hit.

Hits are extended word by word to the windows of `window` words around them, whose 96-bit hashes decide exactly which
windows start earlier elsewhere: within a text all but the first start of a sequence are repeats, and between texts all
but those of the smallest id. Runs of repeats are the maximal exact repeats that go.

Hashes that occur often in a bounded sample of documents are sent to the tasks as short lists. Such blocks count as hits
at once, and of such windows the smallest ids are found by a sum per task and sent back, so no key that a large share of
all documents holds is ever shuffled. The lists only save work; no result depends on them.

Defined results: a NULL text has no words. NULL ids sort before all others; of rows with one id and different texts none
is earlier than the other. Rows alike in id and text get the same result. Texts with fewer words than a window never lose any. Empty tables give empty
tables. Only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import NO_ID, doc_key, partitions, stored

#: Documents sampled for frequent hashes, in how many of them a hash must be, and the length of the list.
SAMPLE_DOCS, SAMPLE_HITS, LISTED = 8_000, 4, 200_000
#: Words whose probes are packed together.
CHUNK = 200_000
GRID, ROLLING, ANCHOR = 0, 1, 2          # in the order in which a bucket reads them
M1, M2, M64, M32 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1, (1 << 32) - 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Hash of each n consecutive values, by doubling."""
    f = np.uint64(factor)
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    power, size = h, 1                      # power: hashes of `size` values
    left = n
    while left:
        if left & 1:
            if out is None:
                out, have = power, size
            else:
                m = min(len(out), len(power) - have)
                out = out[:m] * np.uint64(pow(factor, size, 1 << 64)) + power[have:have + m]
                have += size
        left >>= 1
        if left:
            m = len(power) - size
            power = power[:m] * np.uint64(pow(factor, size, 1 << 64)) + power[size:size + m]
            size *= 2
    out = out[:len(h) - n + 1]
    out = (out ^ out >> np.uint64(31)) * f
    return out ^ out >> np.uint64(29)


def _words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def _texts(column):
    return column.cast(pa.binary()).to_pylist()


def _sampled(block, window):
    def run(batches):
        for b in batches:
            for text in _texts(b.column(0)):
                h = word_hashes(_words(text))
                for kind, n in ((0, block), (1, window)):
                    g = np.unique(rolling(h, n, M1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), kind, np.int32)), pa.array(g.view(np.int64))], names=["kind", "g"])
    return run


def frequent_hashes(docs: DataFrame, block: int, window: int) -> list[np.ndarray]:
    """Sorted hashes of blocks, and of windows, that several documents of the sample hold."""
    n = docs.count()
    share = int(1_000_000 * min(1.0, SAMPLE_DOCS / max(1, n)))
    rows = docs.filter(F.pmod(F.xxhash64("d", "t"), F.lit(1_000_000)) < share).select("text")
    common = (rows.mapInArrow(_sampled(block, window), "kind int, g long").groupBy("kind", "g").agg(F.count("*").alias("n"))
              .filter(F.col("n") >= SAMPLE_HITS).orderBy(F.desc("n"), "g").limit(LISTED).collect())
    return [np.sort(np.array([r.g for r in common if r.kind == k], np.int64).view(np.uint64)) for k in (0, 1)]


def listed(g: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(g), bool)
    return known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g


def _probe(block, buckets, known):
    """Rows (bucket, kind, payload): per chunk of documents and bucket its distinct anchors; its probes off the grid;
    its probes on the grid. Payload of probes: ids, number of hashes of each, hashes."""
    def pack(g, d):
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        n = np.diff(np.r_[cut, len(d)])
        return np.int64(len(cut)).tobytes() + d[cut].tobytes() + n.astype(np.int32).tobytes() + _short(g)

    def rows(docs):
        gs, ds, grids = [], [], []
        for d, g in docs:
            gs.append(g)
            ds.append(np.full(len(g), d, np.int64))
            grids.append(np.arange(len(g)) % block == 0)
        g, d, grid = np.concatenate(gs), np.concatenate(ds), np.concatenate(grids)
        stay = ~listed(g, known.value)
        g, d, grid = g[stay], d[stay], grid[stay]
        bucket = (g >> np.uint64(32)).astype(np.int64) * buckets >> 32
        mark = bucket * 2 + grid
        # documents stay in their order; numbers of 16 bits are sorted by counting
        order = np.argsort(mark.astype(np.uint16) if buckets <= 1 << 15 else mark, kind="stable")
        g, d, grid, bucket, mark = g[order], d[order], grid[order], bucket[order], mark[order]
        cut = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)] if len(mark) else [0]
        out = []
        for i, j in zip(cut, cut[1:]):
            b = int(bucket[i])
            if grid[i]:
                out.append((b, GRID, _counted(g[i:j])))
                out.append((b, ANCHOR, pack(g[i:j], d[i:j])))
            else:
                out.append((b, ROLLING, pack(g[i:j], d[i:j])))
        b, k, p = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], names=["bucket", "kind", "payload"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for d, text in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                g = rolling(word_hashes(_words(text)), block, M1)
                if len(g):
                    held.append((d, g))
                    size += len(g)
                    if size >= CHUNK:
                        yield rows(held)
                        held, size = [], 0
        if held:
            yield rows(held)
    return run


#: A bucket holds a bounded number of anchors, so these bits of a hash tell them apart; a chance meeting only adds work.
SHORT = np.uint64((1 << 48) - 1)


def _short(g: np.ndarray) -> bytes:
    """48 bits of each hash."""
    return g.astype(np.uint32).tobytes() + (g >> np.uint64(32)).astype(np.uint16).tobytes()


def _long(p, n, at) -> np.ndarray:
    low, high = np.frombuffer(p, np.uint32, n, at), np.frombuffer(p, np.uint16, n, at + 4 * n)
    return high.astype(np.uint64) << np.uint64(32) | low


def _counted(g):
    """Distinct hashes with whether each occurs once only."""
    g, n = np.unique(g & SHORT, return_counts=True)
    return np.int64(len(g)).tobytes() + _short(g) + (n > 1).astype(np.uint8).tobytes()


def _unpack(p):
    docs = int(np.frombuffer(p, np.int64, 1)[0])
    d = np.frombuffer(p, np.int64, docs, 8)
    n = np.frombuffer(p, np.int32, docs, 8 + 8 * docs)
    return np.repeat(d, n), _long(p, int(n.sum()), 8 + 12 * docs)


def _match(batches):
    """Over rows sorted by bucket and kind. Hits come out one by one."""
    bucket, grids, anchors, met = None, [], None, None

    def index():
        g = np.concatenate([x for x, _ in grids] or [np.zeros(0, np.uint64)])
        many = np.concatenate([x for _, x in grids] or [np.zeros(0, bool)])
        order = np.argsort(g, kind="stable")
        g, many = g[order], many[order]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        n = np.diff(np.r_[start, len(g)])
        return g[start], (n > 1) | (np.maximum.reduceat(many, start) if len(start) else np.zeros(0, bool))

    for b in batches:
        wait = []
        for at, kind, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if at != bucket:
                bucket, grids, anchors = at, [], None
            if kind == GRID:
                n = int(np.frombuffer(p, np.int64, 1)[0])
                grids.append((_long(p, n, 8), np.frombuffer(p, np.uint8, n, 8 + 6 * n) > 0))
                continue
            if anchors is None:
                anchors, met = index()
                grids = []
            if not len(anchors):
                continue
            d, g = _unpack(p)
            i = np.minimum(np.searchsorted(anchors, g), len(anchors) - 1)
            ok = anchors[i] == g
            if kind == ROLLING:
                met[i[ok]] = True
            else:
                ok &= met[i]
            if ok.any():
                wait.append((d[ok], g[ok]))
        if wait:
            d, g = (np.concatenate(x) for x in zip(*wait))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(g.view(np.int64))], names=["d", "g"])


def _near_hits(block, window, known):
    """Per document: number of words; for those with hits also the text and, as bits, the window starts to be judged;
    the others are done."""
    def judge(b):
        for d, t, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2)), b.column(3)):
            words = _words(text)
            found = found.values.to_numpy() if found.is_valid else ()
            bits = None
            if len(words) >= window:
                g = rolling(word_hashes(words), block, M1)
                hit = listed(g, known.value)
                if len(found):
                    hit |= listed(g & SHORT, np.sort(np.asarray(found, np.int64).view(np.uint64)))
                if hit.any():
                    span = window - block + 1                # a window start sees the rolling starts of so many places
                    total = np.r_[0, np.cumsum(hit)]
                    starts = total[span:] - total[:-span] > 0
                    bits = np.packbits(starts).tobytes() if starts.any() else None
            sha = None if bits else hashlib.sha256(b" ".join(words)).hexdigest()
            yield d, t, len(words), sha, text if bits else None, bits

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                cols = zip(*judge(b.slice(i, 1000)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["d", "t", "n", "sha", "text", "bits"])
    return run


def _judged(text, bits, window):
    """Of the window starts to be judged: places, both hashes, and whether the text holds the sequence earlier."""
    h = word_hashes(_words(text))
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[:len(h) - window + 1])
    a, z = rolling(h, window, M1)[at], (rolling(h, window, M2)[at] >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(a, kind="stable")
    again = np.zeros(len(at), bool)
    same = a[order[1:]] == a[order[:-1]]
    if (same & (z[order[1:]] != z[order[:-1]])).any():      # the first hash alone does not tell them apart
        order = np.lexsort((z, a))
        same = (a[order[1:]] == a[order[:-1]]) & (z[order[1:]] == z[order[:-1]])
    again[order[1:]] = same
    return at, a, z, again


def _frequent_windows(window, known):
    """Of each frequent window the smallest id, per batch."""
    def run(batches):
        for b in batches:
            parts = []
            for d, text, bits in zip(*[b.column(i).to_pylist() for i in range(3)]):
                _, a, z, again = _judged(text, bits, window)
                ok = ~again & listed(a, known.value)
                parts.append((a[ok], z[ok], np.full(int(ok.sum()), d, np.int64)))
            a, z, d = [np.concatenate(x) for x in zip(*parts)] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
            order = np.lexsort((d, z, a))
            a, z, d = a[order], z[order], d[order]
            first = np.r_[True, (a[1:] != a[:-1]) | (z[1:] != z[:-1])] if len(a) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(z[first].view(np.int32)), pa.array(d[first])], names=["w1", "w2", "d"])
    return run


def _windows(window, known):
    """The other windows, each once per text."""
    def run(batches):
        for b in batches:
            for d, t, text, bits in zip(*[b.column(i).to_pylist() for i in range(4)]):
                at, a, z, again = _judged(text, bits, window)
                ok = ~again & ~listed(a, known.value)
                at, a, z = at[ok], a[ok], z[ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(z.view(np.int32)), pa.array(np.full(len(at), d, np.int64)), pa.array(np.full(len(at), t, np.int64)),
                     pa.array(at.astype(np.int32))], names=["w1", "w2", "d", "t", "pos"])
    return run


def cover(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(window, frequent):
    def run(batches):
        a0, z0, d0 = frequent.value
        for b in batches:
            kept, gone = [], []
            for d, text, bits, starts in zip(*[b.column(i).to_pylist() for i in (0, 3, 4, 5)]):
                words = _words(text)
                at, a, z, late = _judged(text, bits, window)
                if len(a0):
                    # several frequent windows may share the first hash; they stand side by side
                    i = np.searchsorted(a0, a)
                    for step in range(int(np.unique(a0, return_counts=True)[1].max())):
                        k = np.minimum(i + step, len(a0) - 1)
                        late = late | (a0[k] == a) & (z0[k] == z) & (d0[k] != d)
                out = cover(np.r_[at[late], np.array(starts or [], np.int64)].astype(np.int64), window, len(words))
                kept.append(b" ".join([w for w, x in zip(words, out.tolist()) if not x]))
                gone.append(int(out.sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=["d", "t", "n", "gone", "kept"])
    return run


def repeats(docs: DataFrame, window: int = 20, block: int = 10) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept: the words that stay, joined by blanks, or NULL where all stay."""
    assert window >= 2 * block - 1, "a window must hold a whole block wherever it starts"
    ship(__name__)
    spark = docs.sparkSession
    d, t = doc_key()
    rows = docs.select(d.alias("d"), t.alias("t"), F.col("text"))
    blocks, windows = frequent_hashes(rows, block, window)
    known, known_windows = spark.sparkContext.broadcast(blocks), spark.sparkContext.broadcast(windows)
    n = partitions(spark)
    found = stored(rows.select("d", "text").mapInArrow(_probe(block, 2 * n, known), "bucket int, kind int, payload binary")
                   .repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_match, "d long, g long"), "hits")
    per_doc = found.groupBy("d").agg(F.collect_list("g").alias("g"))
    near = stored(rows.join(per_doc.hint("shuffle_hash"), "d", "left").select("d", "t", "text", "g").mapInArrow(
        _near_hits(block, window, known), "d long, t long, n long, sha string, text binary, bits binary"), "near-hits")
    open_ = near.filter("bits is not null")
    first = open_.select("d", "text", "bits").mapInArrow(_frequent_windows(window, known_windows), "w1 long, w2 int, d long")
    first = sorted((r.w1 & M64, r.w2 & M32, r.d) for r in first.groupBy("w1", "w2").agg(F.min("d").alias("d")).collect())    # no more than listed
    frequent = spark.sparkContext.broadcast(tuple(np.array([r[i] for r in first], k) for i, k in enumerate((np.uint64, np.uint32, np.int64))))
    starts = open_.select("d", "t", "text", "bits").mapInArrow(_windows(window, known_windows), "w1 long, w2 int, d long, t long, pos int")
    late = stored(starts.withColumn("d0", F.min("d").over(Window.partitionBy("w1", "w2"))).filter("d <> d0")
                  .groupBy("d", "t").agg(F.collect_set("pos").alias("starts")), "late")
    cut = (open_.select("d", "t", "n", "text", "bits").join(late.hint("shuffle_hash"), ["d", "t"], "left").select("d", "t", "n", "text", "bits", "starts")
           .mapInArrow(_remove(window, frequent), "d long, t long, n long, gone long, kept string"))
    whole = near.filter("bits is null").select("d", "n", F.lit(0).cast("long").alias("gone"), "sha", F.lit(None).cast("string").alias("kept"))
    out = whole.unionByName(cut.select("d", "n", "gone", F.sha2("kept", 256).alias("sha"), "kept"))
    return out.select(F.nullif(F.col("d"), F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_words"), F.col("gone").alias("n_removed"),
                      F.col("sha").alias("kept_sha256"), "kept")
