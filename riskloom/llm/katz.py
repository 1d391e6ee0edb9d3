"""Language-model scores: a Katz back-off model of bigrams learnt from the corpus.

All words and all bigrams of the training documents are counted, whatever their frequency. Discounts and weights:

* a count of r up to K keeps the share d_r of Good-Turing (Katz's formula); the mass set free goes to what was not seen;
* back-off weights are normalised exactly: for each context, the discounted seen words and the backed-off unseen ones
  add up to one. A context whose counts leave nothing free gives up 1/(c+1);
* p(w | h) = d c(h, w) / c(h) if seen, else alpha(h) p(w); p(w) = d c(w) / N if seen, else the free mass of unseen words.
  A context that was never seen has alpha 1.

Words of at least `CLASS_SHARE` of all tokens, of training or other documents, have numbers, which the tasks hold, as they
do bigrams of such words of at least `HOT_SHARE` (at most 1/share of each, by that definition); these are scored in place.
Other words go by 62 bits of their hash. Bigrams lie in a table of buckets: with their context where that has no number,
else with their word where that has none, else with their context, which is split over as many buckets as its share of
the tokens asks for. So a bucket knows the counts of its unnumbered words and the sums of its unnumbered contexts; only the
count of a word after another unnumbered context is sent on. Chunks of documents count every occurrence not settled in place
as unseen first and ask each bucket once, in one packed row, by how much its n-grams differ from unseen ones; the answers
return to the chunk. So no key of a large share of the training tokens is ever shuffled, Spark moves packed rows instead of one
per n-gram, and the two shares and the bucket size decide the route of an n-gram only, never its score.

Defined results: a NULL or empty text is one end token. Documents without id, or with a NULL flag, are training documents. Rows alike in id and
text get equal scores. With no training tokens every token is unseen: base and score follow from the formulas with zero
counts (score counts an unseen word as certain). Empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import NO_ID, bounded_batches, doc_key, partitions, release, stored

CLASS_SHARE, HOT_SHARE, K = 1e-6, 1e-6, 5
#: Tokens a bucket of the bigram table should hold.
BUCKET = 1_000_000
#: Numbers of what is not among the numbered words: other words, start (context only), end. A bigram is h << 24 | w.
OTHER, START, END, FIRST, SHIFT = 0, 1, 2, 3, 24
#: From here on, words and bigrams are hashes.
HASHED = 1 << 62
#: Kinds of packed rows: bigrams with counts; bigrams sent to their word's bucket as well; counts of such words, sent to the
#: bigram's bucket; occurrences in a chunk of documents; what a chunk settled in place; answers to a chunk.
PAIRS, COPIES, COUNTS, ASKED, OWN, ANSWER = range(6)
ROW = "bucket long, kind int, chunk long, data binary, more binary, counts array<long>"
#: The end token among word counts; no word holds a line end.
END_WORD = b"\n"
COUNTED, CHUNK = 300_000, 300_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _texts(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def _count_words(batches):
    """Counts in training documents and in all. Each document goes to one of two counters, put together when they are sent."""
    seen, others = Counter(), Counter()

    def flush():
        words, c = list(seen), list(seen.values())
        n = [k + others.pop(w, 0) for w, k in seen.items()]
        words += others
        n += others.values()
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c + [0] * len(others), pa.int64()), pa.array(n, pa.int64())],
                                           names=["word", "c", "n"])
        seen.clear()
        others.clear()
        return batch

    for b in batches:
        for text, out in zip(_texts(b.column(0)), b.column(1).to_pylist()):
            words = words_of(text)
            words.append(END_WORD)
            (others if out else seen).update(words)
            if len(seen) + len(others) > COUNTED:
                yield flush()
    yield flush()


def discounts(n_of: dict[int, int], k: int = K) -> np.ndarray:
    """d_1 .. d_k from counts of counts, at index r; 1 beyond. Where Good-Turing gives no share between 0 and 1 (tables
    too small or too even), half a count is taken instead."""
    d = np.ones(k + 1)
    n = [n_of.get(r, 0) for r in range(k + 2)]
    if all(n[1:]):
        a = (k + 1) * n[k + 1] / n[1]
        if a < 1:
            for r in range(1, k + 1):
                d[r] = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
    if not all(0 < x < 1 for x in d[1:]):
        d[1:] = [(r - 0.5) / r for r in range(1, k + 1)]
    return d


def discounted(c, d: np.ndarray):
    """d_c * c."""
    return np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0) * c


class Words:
    """The numbered words with what one token of each adds; index OTHER stands for an unseen word."""

    def __init__(self, rows, total: int, types: int, of_counts: dict[int, int], all_discounted: float):
        rows = sorted(rows, key=lambda r: (-r[2], r[0]))
        self.d = discounts(of_counts)
        ends = [sum(r[i] for r in rows if r[0] == END_WORD) for i in (1, 2)]
        rows = [r for r in rows if r[0] != END_WORD]
        self.words = [r[0] for r in rows]
        c = np.array([0, 0, ends[0], *[r[1] for r in rows]], np.int64)
        #: Tokens that follow each numbered word in all documents, as many as there are of it.
        self.follow = np.array([0, ends[1], 0, *[r[2] for r in rows]], np.int64)
        self.base = np.log10(c + 0.5) - math.log10(total + 0.5 * (types + 1))
        self.known = c > 0
        self.free = max(1 - all_discounted / total, 1 / (total + 1)) if total else 1.0     # mass of unseen words
        #: p(w) of a seen word is its discounted count times this.
        self.share = (1 - self.free) / all_discounted if all_discounted else 0.0
        self.p = self.share * discounted(c, self.d)
        self.log_p = np.log10(np.where(self.p > 0, self.p, self.free))


def _ready(held) -> dict:
    """The broadcast dictionary, with the word numbers made once per Python worker."""
    v = held.value
    if "number" not in v:
        v["number"] = {w: i for i, w in enumerate(v["words"], FIRST)}
    return v


def _chunks(batches, number, first):
    """Documents in chunks: columns before the text; numbers of all tokens, the same with hashes for words without a
    number, and the end of each document."""
    rows, words, size = [], [], 0
    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in range(first)], _texts(b.column(first))):
            w = words_of(row[-1])
            rows.append(row[:-1])
            words.append(w)
            size += len(w) + 1
            if size >= CHUNK:
                yield rows, *_numbers(words, number, size)
                rows, words, size = [], [], 0
    if rows:
        yield rows, *_numbers(words, number, size)


def _numbers(words, number, size):
    out = np.fromiter(chain.from_iterable(map(number.get, chain(w, (END_WORD,)), repeat(OTHER)) for w in words), np.int64, size)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    out[ends] = END
    ids, starts = out.copy(), np.r_[0, ends[:-1] + 1]
    other = np.flatnonzero(out == OTHER)
    doc = np.searchsorted(ends, other)
    ids[other] = [_word_id(words[j][i]) for j, i in zip(doc.tolist(), (other - starts[doc]).tolist())]
    return out, ids, ends


def _word_id(word: bytes) -> int:
    return HASHED | xxhash.xxh3_64_intdigest(word) >> 2


def _before(w, ends):
    h = np.roll(w, 1)
    h[0] = START
    h[ends[:-1] + 1] = START
    return h


def _mix(h, w):
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)
        for step, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(step)) * np.uint64(factor)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(2)).astype(np.int64) | HASHED


def _keys(h, w):
    """h << SHIFT | w for two numbers, otherwise a hash of both."""
    return np.where((h < HASHED) & (w < HASHED), (h & (1 << SHIFT) - 1) << SHIFT | w, _mix(h, w))


def _home(x, parts):
    """Bucket of an unnumbered word."""
    return _mix(x, np.zeros(1, np.int64)) % parts


def _bucket(h, w, v):
    numbered = h < HASHED
    spread = v["spread"][np.where(numbered, h, OTHER)]
    both = _mix(h, _mix(np.zeros(1, np.int64), w) % spread) % v["parts"]
    return np.where(numbered & (w < HASHED), both, _home(np.where(numbered, w, h), v["parts"]))


def pack(*columns) -> bytes:
    """Columns of 8-byte numbers of one length, the first by differences, byte by byte, compressed."""
    n, out = len(columns[0]), []
    for i, x in enumerate(columns):
        x = np.ascontiguousarray(x).view(np.int64)
        out.append((np.diff(x, prepend=np.int64(0)) if i == 0 else x).view(np.uint8).reshape(n, 8).T.tobytes())
    return n.to_bytes(8, "little") + pa.Codec("zstd", 1).compress(b"".join(out), asbytes=True)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return [np.zeros(0, np.int64)] * columns
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 8 * n * columns, asbytes=True), np.uint8).reshape(columns, 8, n)
    out = [np.ascontiguousarray(x.T).view(np.int64).reshape(n) for x in raw]
    out[0] = np.cumsum(out[0])
    return out


def _all(rows, columns):
    """The columns of several packed rows, one after the other, and their lengths."""
    parts = [unpack(x, columns) for x in rows]
    if not parts:
        return [np.zeros(0, np.int64)] * columns, np.zeros(0, np.int64)
    return [np.concatenate(x) for x in zip(*parts)], np.array([len(x[0]) for x in parts])


def _rows(rows):
    """Rows (bucket, kind, chunk, data, more, counts) as a batch."""
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    cols = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["bucket", "kind", "chunk", "data", "more", "counts"])


def _ranks(x):
    """Equal values get one number, in the order of the values."""
    order = np.argsort(x)
    x = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.r_[False, x[1:] != x[:-1]])
    return out


def _lexsorted(bucket, x, y):
    """np.lexsort((y, x, bucket)): the ranks and the place make one number to sort by, as long as it has room for them."""
    bits = len(x).bit_length()
    if not len(x) or 3 * bits > 63 or int(bucket.max()) >> (63 - bits):
        return np.lexsort((y, x, bucket))
    first = _ranks(bucket << bits | _ranks(x))
    return np.sort((first << bits | _ranks(y)) << bits | np.arange(len(x))) & (1 << bits) - 1


def _split(kind, chunk, bucket, *columns):
    """One packed row per bucket, sorted by the first two columns."""
    order = _lexsorted(bucket, *columns[:2])
    bucket, columns = bucket[order], [x[order] for x in columns]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else []
    return [(int(bucket[a]), kind, chunk, pack(*[x[a:b] for x in columns]), None, None) for a, b in zip(cuts[:-1], cuts[1:])]


def _count_bigrams(held):
    def run(batches):
        v = _ready(held)
        for _, _, w, ends in _chunks(batches, v["number"], 0):
            h = _before(w, ends)
            h, w, n = _summed(h, w, np.ones(len(w), np.int64))
            far = (h >= HASHED) & (w >= HASHED)
            yield _rows(_split(PAIRS, 0, _bucket(h, w, v), h, w, n)
                        + _split(COPIES, 0, _home(w[far], v["parts"]), h[far], w[far], n[far]))
    return run


def _summed(h, w, n):
    """Bigrams, each once."""
    if not len(h):
        return h, w, n
    k = _keys(h, w)
    order = np.argsort(k)
    first = np.flatnonzero(np.r_[True, np.diff(k[order]) != 0])
    return h[order[first]], w[order[first]], np.add.reduceat(n[order], first)


def _by_kind(table, kind, column="data"):
    at = np.flatnonzero(table.column("kind").to_numpy() == kind)
    return table.column(column).take(pa.array(at)).to_pylist()


def _merge(parts):
    """A bucket's bigrams and the counts of its unnumbered words, and those counts for the other buckets that need them."""
    def run(table):
        bucket = table.column("bucket")[0].as_py()
        h, w, c = _summed(*_all(_by_kind(table, PAIRS), 3)[0])
        fh, fw, fc = _summed(*_all(_by_kind(table, COPIES), 3)[0])
        own = (h < HASHED) & (w >= HASHED)
        words, at = np.unique(np.concatenate([w[own], fw]), return_inverse=True)
        cw = np.bincount(at, np.concatenate([c[own], fc]), len(words)).astype(np.int64)
        order = np.lexsort((w, h))
        out = [(bucket, PAIRS, 0, pack(h[order], w[order], c[order]), pack(words, cw), np.bincount(np.minimum(c, K + 2), minlength=K + 3).tolist())]
        out += _split(COUNTS, 0, _home(fh, parts), fh, fw, cw[np.searchsorted(words, fw)])
        return pa.Table.from_batches([_rows(out)])
    return run


def _found(sorted_keys, keys):
    """Where each key stands, and whether it does."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _sums(at, n, *columns):
    """Sums of the columns by number, as doubles also where there is nothing to sum."""
    return [np.bincount(at, x, n).astype(float) for x in columns]


def _context_sums(held):
    """A bucket's share of the sums of numbered contexts."""
    def run(batches):
        v = held.value
        for b in batches:
            for data, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (h, w, c), (words, cw) = unpack(data, 3), unpack(more, 2)
                h, w, c = (x[h < HASHED] for x in (h, w, c))
                p = v["p"][np.where(w < HASHED, w, OTHER)]
                rare = w >= HASHED
                p[rare] = v["share"] * discounted(cw[np.searchsorted(words, w[rare])], v["d1"])
                ids, at = np.unique(h, return_inverse=True)
                sums = _sums(at, len(ids), c, discounted(c, v["d2"]), p)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *sums)], names=["h", "n", "kept", "mass"])
    return run


def _hot(least):
    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                h, w, c = unpack(data, 3)
                hot = (h < HASHED) & (w < HASHED) & (c >= least)
                yield pa.RecordBatch.from_arrays([pa.array(x[hot]) for x in (h, w, c)], names=["h", "w", "c"])
    return run


def _delta(v, h, w, c):
    """By how much log10 p(w | h) of a seen bigram of numbered words differs from that of an unseen one."""
    return np.log10(v["scale"][h] * discounted(c, v["d2"]) / v["n"][h]) - v["log_alpha"][h] - np.log10(v["p"][w])


def _ask(held):
    """Per chunk of documents what is settled in place, and the other occurrences, packed by bucket."""
    def run(batches):
        v = _ready(held)
        for rows, numbers, ids, ends in _chunks(batches, v["number"], 3):
            starts = np.r_[0, ends[:-1] + 1]
            h = _before(ids, ends)
            numbered_h, numbered_w = h < HASHED, ids < HASHED
            held_h = np.where(numbered_h, h, OTHER)
            score = v["log_p"][numbers] + v["log_alpha"][held_h]
            at, hot = _found(v["hot"], np.where(numbered_h & numbered_w, _keys(h, ids), 0))
            score[hot] += v["hot_delta"][at[hot]]
            sums = [np.add.reduceat(x, starts) for x in (v["known"][numbers].astype(float), v["base"][numbers], score)]
            keys = [np.array(x, np.int64) for x in zip(*[(d, t, bool(out)) for d, t, out in rows])]
            chunk = xxhash.xxh3_64_intdigest(b"".join(x.tobytes() for x in keys)) - (1 << 63)
            doc = np.repeat(np.arange(len(rows)), ends - starts + 1)
            away = np.flatnonzero(~hot & (~numbered_h | ~numbered_w | (v["n"][held_h] > 0)))
            # the word of a bigram without any number is asked about on its own, behind no context
            far = np.flatnonzero(~numbered_h & ~numbered_w)
            none = np.full(len(far), OTHER, np.int64)
            yield _rows([(chunk % v["parts"], OWN, chunk, pack(*keys, ends - starts + 1, *sums), None, None)]
                        + _split(ASKED, chunk, _bucket(h[away], ids[away], v), h[away], ids[away], doc[away])
                        + _split(ASKED, chunk, _home(ids[far], v["parts"]), none, ids[far], doc[far]))
    return run


def _answer(held):
    """What a bucket's n-grams add to the sums of the documents that ask."""
    def run(table):
        v = held.value
        out = [(0, OWN, chunk, data, None, None) for chunk, data in zip(_by_kind(table, OWN, "chunk"), _by_kind(table, OWN))]
        chunks = _by_kind(table, ASKED, "chunk")
        if chunks:
            (qh, qw, doc), lengths = _all(_by_kind(table, ASKED), 3)
            (h, w, c), _ = _all(_by_kind(table, PAIRS), 3)
            (words, cw), _ = _all(_by_kind(table, PAIRS, "more"), 2)
            k = _keys(h, w)
            order = np.argsort(k)
            k, h, w, c = k[order], h[order], w[order], c[order]
            count = np.zeros(len(w), np.int64)                         # of unnumbered words
            own = (h < HASHED) & (w >= HASHED)
            count[own] = cw[np.searchsorted(words, w[own])]
            (fh, fw, fc), _ = _all(_by_kind(table, COUNTS), 3)
            at, there = _found(k, _keys(fh, fw))
            count[at[there]] = fc[there]
            p = v["p"][np.where(w < HASHED, w, OTHER)]
            p[w >= HASHED] = v["share"] * discounted(count[w >= HASHED], v["d1"])
            held_h = np.where(h < HASHED, h, OTHER)
            n, scale, log_alpha = (v[x][held_h] for x in ("n", "scale", "log_alpha"))
            far = np.flatnonzero(h >= HASHED)
            contexts, at = np.unique(h[far], return_inverse=True)
            sums = _sums(at, len(contexts), c[far], discounted(c[far], v["d2"]), p[far])
            _, far_scale, far_alpha = weights(*sums)
            n[far], scale[far], log_alpha[far] = sums[0][at], far_scale[at], far_alpha[at]
            delta = np.log10(scale * discounted(c, v["d2"]) / n) - log_alpha - np.log10(p)

            score, base, known = np.zeros(len(qh)), np.zeros(len(qh)), np.zeros(len(qh), np.int64)
            at, there = _found(k, _keys(qh, qw))
            there &= qh != OTHER
            score[there] += delta[at[there]]
            at, there = _found(contexts, qh)
            score[there] += far_alpha[at[there]]
            at, there = _found(words, qw)
            there &= qh < HASHED
            seen = cw[at[there]]
            score[there] += np.log10(v["share"] * discounted(seen, v["d1"])) - v["log_p"][OTHER]
            base[there], known[there] = np.log10(seen + 0.5) - math.log10(0.5), 1
            # one answer per document that asked
            of = np.repeat(np.arange(len(chunks)), lengths) << 40 | doc
            docs, at = np.unique(of, return_inverse=True)
            sums = _sums(at, len(docs), known, base, score)
            cuts = np.searchsorted(docs, np.arange(len(chunks) + 1) << 40)
            out += [(0, ANSWER, chunk, pack((docs[a:b] & (1 << 40) - 1), *[x[a:b] for x in sums]), None, None)
                    for chunk, a, b in zip(chunks, cuts[:-1], cuts[1:])]
        return pa.Table.from_batches([_rows(out)])
    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _add_up(table):
    """The documents of a chunk. Chunks of the same documents share their answers evenly."""
    own = _by_kind(table, OWN)
    d, _, out, tokens, *sums = unpack(own[0], 7)
    sums = [x.view(np.float64).copy() for x in sums]
    (doc, *more), _ = _all(_by_kind(table, ANSWER), 4)
    for x, y in zip(sums, more):
        x += _sums(doc, len(d), y.view(np.float64))[0] / len(own)
    n = len(own)
    ids = pa.array(np.tile(d, n), mask=np.tile(d == NO_ID, n))
    cols = [np.tile(x, n) for x in (out != 0, tokens, np.rint(sums[0]).astype(np.int64), sums[1], sums[2])]
    return pa.Table.from_arrays([ids, *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _grouped(df: DataFrame, key: str, parts: int):
    """Groups spread over a fixed number of tasks: packed rows are too small for sizes in bytes to tell the work."""
    return df.repartition(parts, key).groupBy(key)


def train(docs: DataFrame, held_out: str = "held_out") -> tuple[dict, DataFrame]:
    """From the texts of `docs` that are not held out: what tasks hold (numbered words, hot bigrams, weights of numbered
    contexts) and the table of bigrams with counts, by bucket."""
    ship(__name__)
    spark = docs.sparkSession
    bounded_batches(spark)
    out = F.coalesce(F.col(held_out), F.lit(False))
    table = stored(docs.select("text", out.alias("out")).mapInArrow(_count_words, "word binary, c long, n long")
                   .groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    s = table.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count_if(F.col("c") > 0).alias("v"),
                  F.sum(F.when(F.col("c") > K, F.col("c"))).alias("much")).first()
    total, tokens = s.c or 0, s.n or 0
    of_counts = {r.c: r.k for r in table.filter(F.col("c").between(1, K + 1)).groupBy("c").agg(F.count("*").alias("k")).collect()}
    d1 = discounts(of_counts)
    kept = (s.much or 0) + sum(d1[c] * c * n for c, n in of_counts.items() if c <= K)
    numbered = (F.col("n") >= CLASS_SHARE * tokens) | (F.col("word") == END_WORD)
    words = Words([(bytes(r.word), r.c, r.n) for r in table.filter(numbered).collect()], total, s.v, of_counts, kept)
    parts = max(partitions(spark), -(-tokens // BUCKET))
    spread = 1 + words.follow * 4 * parts // max(tokens, 1)
    held = spark.sparkContext.broadcast({"words": words.words, "spread": spread, "parts": parts})
    found = docs.filter(~out).select("text").mapInArrow(_count_bigrams(held), ROW)
    pairs = stored(_grouped(found, "bucket", parts).applyInArrow(_merge(parts), ROW), "bigrams")
    of_pairs = {r.pos: r.k for r in pairs.select(F.posexplode("counts").alias("pos", "k")).groupBy("pos").agg(F.sum("k").alias("k")).collect()}
    d2 = discounts(of_pairs)
    v = {"words": words.words, "spread": spread, "parts": parts, "p": words.p, "share": words.share, "d1": d1, "d2": d2}
    own = pairs.filter(F.col("kind") == PAIRS)
    sums = (own.select("data", "more").mapInArrow(_context_sums(spark.sparkContext.broadcast(v)), "h long, n double, kept double, mass double")
            .groupBy("h").agg(*[F.sum(x).alias(x) for x in ("n", "kept", "mass")]).toArrow())      # one row per numbered word
    of_context = np.zeros((3, FIRST + len(words.words)))
    of_context[:, sums.column("h").to_numpy()] = [sums.column(x).to_numpy() for x in ("n", "kept", "mass")]
    _, scale, log_alpha = weights(*of_context)
    v |= {"n": of_context[0], "scale": scale, "log_alpha": log_alpha, "log_p": words.log_p, "known": words.known, "base": words.base}
    hot = own.select("data").mapInArrow(_hot(HOT_SHARE * total), "h long, w long, c long").toArrow()
    h, w, c = (hot.column(i).to_numpy() for i in range(3))
    k = _keys(h, w)
    order = np.argsort(k)
    return {**v, "hot": k[order], "hot_delta": _delta(v, h, w, c)[order], "total": total}, pairs


def weights(n: np.ndarray, kept: np.ndarray, mass: np.ndarray):
    """Mass left to unseen words, factor on the seen ones and log10 of the back-off weight, per context."""
    share = np.divide(kept, n, out=np.zeros_like(n), where=n > 0)
    left = np.where(n > 0, np.maximum(1 - share, 1 / (n + 1)), 1.0)
    full = 1 - mass < 1e-12                                    # every word was seen: nothing to back off to
    left[full] = 0
    scale = np.divide(1 - left, share, out=np.zeros_like(n), where=share > 0)
    alpha = np.where(full, 1.0, left / np.where(full, 1.0, 1 - mass))
    return left, scale, np.log10(alpha)


def score(docs: DataFrame, held_out: str = "held_out") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; the model learns from
    those not held out."""
    ship(__name__)
    v, pairs = train(docs, held_out)
    release(docs.sparkSession)          # the shuffles of the counts: the occurrences asked about need their room on disk
    held = docs.sparkSession.sparkContext.broadcast(v)
    d, t = doc_key()
    out = F.coalesce(F.col(held_out), F.lit(False))
    asked = docs.select(d.alias("d"), t.alias("t"), out.alias("out"), F.col("text")).mapInArrow(_ask(held), ROW)
    answers = _grouped(pairs.select(asked.columns).unionByName(asked), "bucket", v["parts"]).applyInArrow(_answer(held), ROW)
    rows = _grouped(answers, "chunk", v["parts"]).applyInArrow(_add_up, SCORED)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v["total"]).cast("long").alias("train_tokens"), "base_score", "score")


def held_out_of(doc_id, folds: int = 5, held: int = 1):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds == held, F.lit(False))
