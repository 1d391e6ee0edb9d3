"""The text operators on small tables: SQL or brute force, edge cases, and rounds through the pipeline."""

import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import decontam, katz, langid, linededup, neardup, pieces, quality, queries, revisit, secrets, simhash, substring

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, pool=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Shared lines, near and exact copies, long repeats, and every awkward text."""
    line = "This very line stands in many of the documents, more than four."
    base = words(120, 1, 4000)
    texts = [None, "", " \n\t ", "x", "a\nb\n", "▁   é", "\n".join([line] * 3), base, base, base + " end", base.replace("w", "v", 1)]
    texts += [f"{words(30, i, 500)}\n{line.upper() if i % 2 else '  ' + line}\n{words(10, i + 50, 500)}" for i in range(9)]
    texts += [words(20, 70 + i, 900) + " " + words(45, 3, 900) + " " + words(15, 90 + i, 900) for i in range(5)]
    texts += ["same " * 60, "le chat " * 40, words(3000, 9, 300)]
    rows = [(i, t, ["en", "fr", None][i % 3], "src/a.py" if i % 2 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [(7, base, "en", "s", len(base)), (None, base, None, None, 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, words(25, 3, 900)), (2, words(6, 3, 900)), (2, None), (3, ""), (None, "SAME same")], "item_id long, text string")


def plain(rows):
    """Documents with ids that do not repeat."""
    return {r[0]: r[1] for r in rows if r[0] is not None}


def _plain(v):
    if pd.isna(v):
        return "~"
    return str(int(v)) if isinstance(v, (float, int, np.integer)) and not isinstance(v, (bool, np.bool_)) else str(v)


def test_queries_agree_with_sql(spark, tmp_path, corpus, items):
    spark.createDataFrame([r for r in corpus if r[0] is not None][:-1], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    items.filter("item_id is not null").write.parquet(f"{tmp_path}/benchmark.parquet")
    pages = [(i, f"http{'s' * (i % 2)}://{'www.' * (i % 3 == 0)}Host.org/p{i % 4}{'#x' * (i % 5 == 0)}", f"<p>{i % 6}</p>") for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    vectors = [(i, [((i * 7 + k * 13) % 29 - 14) / 8 for k in range(32)] if i % 9 else None, i % 3) for i in range(90)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, sql in queries.SQL.items():
        want = con.execute(sql).df()
        got = queries.QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
        as_rows = lambda d: sorted(tuple(_plain(v) for v in r) for r in d.astype(object).itertuples(index=False))
        assert as_rows(got) == as_rows(want), name


def test_line_dedup_over_many_tasks(spark, docs):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, linededup.dedup_lines(docs, counts=True).collect())))
        assert seen[0] == seen[1] == seen[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_automaton_against_windows():
    r = random.Random(5)
    for _ in range(60):
        its = [(str(i), [bytes([97 + r.randrange(3)]) for _ in range(r.randrange(0, 9))]) for i in range(4)]
        text = [bytes([97 + r.randrange(4)]) for _ in range(40)]
        hit, found = set(), set()
        for i, w in its:
            k = min(4, len(w))
            for p in range(len(w) - k + 1) if k else ():
                for q in range(len(text) - k + 1):
                    if text[q:q + k] == w[p:p + k]:
                        hit.update(range(q, q + k))
                        found.add(i)
        a = decontam.Automaton(its, 4)
        spans, got = a.hits(text)
        assert {x for s, e in spans for x in range(s, e)} == hit and {a.ids[k] for k in got} == found


def test_decontaminate_cuts_spans_in_blocks(docs, items):
    one = decontam.decontaminate(docs, items).select("doc_id", "text")
    assert not [r for r in one.collect() if r.text and words(25, 3, 900) in r.text]
    parts = decontam.mark_hits(docs.select("doc_id", "text"), items, block_words=20)
    whole = decontam.mark_hits(docs.select("doc_id", "text"), items)
    cover = lambda d: sorted((str(r.doc_id), str(r.text), r["__n"], str(decontam._merge(r["__from"], r["__to"])), str(sorted(set(r["__items"])))) for r in d.collect())
    assert cover(parts) == cover(whole)


def _fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, docs, corpus):
    got = simhash.near_duplicates(docs.select("doc_id", "text")).collect()
    assert len(got) == len(corpus)
    fps = {(d, t): _fingerprint(t) for d, t, *_ in corpus}
    names = list(fps)
    root = {k: k for k in names}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for k in names:
        if k[0] is not None:
            low[find(k)] = min(low.get(find(k), 10**9), k[0])
    want = Counter((k[0], fps[k], low.get(find(k))) for k in ((d, t) for d, t, *_ in corpus))
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    kept = simhash.keep_first(docs).collect()
    assert len(kept) == len({find(k) for k in names})


def test_tree_search_is_exact():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    near = [s ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for s in seeds for a, b in rng.integers(0, 64, (40, 2))]
    points = np.unique(np.concatenate([seeds, np.array(near, np.uint64), rng.integers(0, 1 << 63, 3000).astype(np.uint64)]))
    want = {(i, j) for i in range(len(points)) for j in (np.flatnonzero(np.bitwise_count(points[i + 1:] ^ points[i]) <= 2) + i + 1).tolist()}
    tree = simhash.grow(points, 100, 2, rng)
    assert tree is not None
    got = set()
    for _, idx, home in simhash.place(tree, points, np.ones(len(points), bool), 2):
        for x, y in simhash.links(points[idx], home, 2, rng):
            got |= {(min(a, b), max(a, b)) for a, b in zip(idx[x].tolist(), idx[y].tolist())}
    assert got == want


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 105), (105, 101)], "u long, v long")
    assert {r.u: r.root for r in simhash.components(chain).collect() if r.u != r.root} == {**{i: 0 for i in range(1, 61)}, 105: 100, 101: 100}


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_near_copies(spark, corpus, monkeypatch):
    """Planted copies with a few words changed: the stage keeps what all pairs of exact similarity 0.8 leave."""
    r, rows = random.Random(4), list(corpus)
    for g in range(6):
        base = words(200, 900 + g, 5000).split()
        for c in range(30 if g == 0 else 5):
            copy = list(base)
            for _ in range(r.randrange(1, 6)):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            rows.append((1000 + 100 * g + c, " ".join(copy), "en", "s", 1))
    sets = {(i, t): _shingles(t) for i, t, *_ in rows}
    names = list(sets)
    root = {k: k for k in names}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(names):
        for b in names[i + 1:]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                root[find(a)] = find(b)
    first = {}
    for k in sorted(names, key=lambda k: (k[0] is None, k[0] or 0)):
        first.setdefault(find(k), k)
    planted = spark.createDataFrame(rows, DOC)
    # (2, 0): large buckets only by the second round, in blocks of a few points
    for small, ahead, block, direct in ((neardup.SMALL, neardup.NEXT, neardup.BLOCK, neardup.DIRECT), (2, 0, 7, 2)):
        for name, value in (("SMALL", small), ("NEXT", ahead), ("BLOCK", block), ("DIRECT", direct)):
            monkeypatch.setattr(neardup, name, value)
        got = corpus_pipeline.near_dedup(spark, planted, "").collect()
        assert Counter(x.doc_id for x in got) == Counter(i for i, _ in first.values()), small


def test_near_duplicates_come_from_the_tree(spark, monkeypatch):
    """Without the tree's links nothing is linked but equal texts, however few points a bucket has."""
    base = words(200, 5, 5000)
    docs = spark.createDataFrame([(1, base), (2, base + " more"), (3, base), (4, words(200, 6, 5000)), (5, "one more " + base)], "doc_id long, text string")

    def groups():
        found = {r.d: r.root for r in neardup.near_duplicates(docs).collect()}
        return sorted(sorted(d for d in found if found[d] == x) for x in set(found.values()))

    assert groups() == [[1, 2, 3, 5], [4]]
    monkeypatch.setattr(neardup.Bucket, "search", lambda self, rng: [])
    assert groups() == [[1, 3], [2], [4], [5]]


def test_no_pair_is_lost_between_buckets(spark):
    """A pair at exactly 0.8 that thirty bands of five min-hashes leave apart."""
    w = [f"w206042x{i}" for i in range(14)]
    docs = spark.createDataFrame([(1, " ".join(w[:13])), (2, " ".join(w[1:]))], "doc_id long, text string")
    assert [r.doc_id for r in neardup.keep_first(docs).collect()] == [1]


@pytest.mark.parametrize("listed", [0, 1, 2])
def test_similar_sets_share_one_of_their_first_shingles(listed):
    r = np.random.default_rng(listed)
    for t in range(3000):
        n = int(r.integers(1, 40)) if t % 10 else int(r.integers(400, 600))     # the parities of some have twice the bits of others
        every = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        a, b = (np.sort(r.permutation(every)[:max(1, len(every) - int(r.integers(0, 3 + n // 10)))]) for _ in range(2))
        hashes = np.sort(r.permutation(every)[:listed * len(every) // 2])
        frequent = np.stack([hashes, r.permutation(len(hashes)).astype(np.uint64)])
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            sizes, bits = np.array([len(a), len(b)]), [neardup.parities(a), neardup.parities(b)]
            assert sum(len(x) for x, _ in neardup.possible(np.arange(2), sizes, bits, 80))
            assert len(np.intersect1d(neardup.first(a, 80, frequent), neardup.first(b, 80, frequent)))


@pytest.mark.parametrize("direct", [1, 8, 48])
def test_bucket_search_against_all_pairs(monkeypatch, direct):
    monkeypatch.setattr(neardup, "DIRECT", direct)
    for seed in range(12):
        r = np.random.default_rng(seed)
        sets = [np.zeros(0, np.int64)] * (seed % 3)
        for _ in range(5):                                     # clouds of copies that drift apart, and loners
            base = r.integers(0, 1 << 60, 60)
            for _ in range(r.integers(1, 40)):
                copy = base.copy()
                copy[r.integers(0, 60, r.integers(0, 14))] = r.integers(0, 1 << 60)
                sets.append(np.unique(copy[:r.integers(45, 61)]))
        n = len(sets)
        component = np.arange(n)
        component[r.integers(0, n, n // 4)] = 0
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        found = neardup.Bucket(component, np.concatenate(sets), starts, 80).search(np.random.default_rng(1))

        def groups(links):
            root = component.copy()
            for x, y in links:
                root[root == root[x]] = root[y]
            return np.unique(root, return_inverse=True)[1], len(np.unique(root))

        held = [set(s.tolist()) for s in sets]
        pairs = [(x, y) for x in range(n) for y in range(x) if 5 * len(held[x] & held[y]) >= 4 * len(held[x] | held[y])]
        assert set(found) <= {p for x, y in pairs for p in ((x, y), (y, x))}
        one, two = groups(found), groups(pairs)
        assert one[1] == two[1] and len(set(zip(one[0], two[0]))) == one[1]
        assert len(found) == len(np.unique(component)) - one[1]     # a forest: no link that joins nothing


def test_katz_adds_up_and_matches_both_routes(spark, docs, monkeypatch):
    d = docs.select("doc_id", "text").withColumn("held_out", katz.held_out_of(F.col("doc_id")))
    seen = []
    for hot, few in ((1e-6, 1e-5), (0.02, 0.03)):             # all n-grams held by the tasks, and nearly none
        monkeypatch.setattr(katz, "HOT_SHARE", hot)
        monkeypatch.setattr(katz, "CLASS_SHARE", 1e-2)
        seen.append(sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.score(d).collect()))
    assert seen[0] == seen[1]
    n, kept = np.array([10.0, 0.0, 7.0]), np.array([8.0, 0.0, 7.0])
    mass = np.array([0.4, 0.0, 0.3])
    left, scale, log_alpha = katz.weights(n, kept, mass)
    assert np.allclose(scale * np.divide(kept, n, out=np.zeros(3), where=n > 0) + 10 ** log_alpha * (1 - mass), 1)
    empty = katz.score(d.limit(0))
    assert empty.count() == 0


def _plain_katz(rows):
    """n_tokens, n_known, base and score by (id, text) from plain counts of all words and bigrams."""
    split = lambda t: [*(t or "").encode().lower().split(), katz.END_WORD]
    train = [split(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    one = Counter(w for x in train for w in x)
    two = Counter(b for x in train for b in zip([None, *x], x))
    d1, d2 = (katz.discounts(Counter(c.values())) for c in (one, two))
    total, d = sum(one.values()), lambda c, by: c * (by[c] if c < len(by) else 1)
    kept = sum(d(c, d1) for c in one.values())
    free = max(1 - kept / total, 1 / (total + 1))
    p = {w: (1 - free) * d(c, d1) / kept for w, c in one.items()}
    n, share, mass = Counter(), Counter(), Counter()
    for (h, w), c in two.items():
        n[h] += c
        share[h] += d(c, d2)
        mass[h] += p[w]
    left = {h: max(1 - share[h] / n[h], 1 / (n[h] + 1)) for h in n}

    def prob(h, w):
        if (h, w) in two:
            return (1 - left[h]) * d(two[h, w], d2) / share[h]
        return (left[h] / (1 - mass[h]) if h in n else 1) * p.get(w, free)

    for h in n:                                                # each context adds up to one, the unseen word included
        assert abs(sum(prob(h, w) for w in [*one, b"never seen"]) - 1) < 1e-9
    out = {}
    for i, t in rows:
        x = split(t)
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1))) for w in x)
        out[i, t] = (len(x), sum(w in one for w in x), base, sum(math.log10(prob(h, w)) for h, w in zip([None, *x], x)))
    return out


def test_katz_counts_every_bigram(spark, docs, corpus, monkeypatch):
    """Whatever has a number or is held by the tasks, scores are those of plain counts over all words and bigrams."""
    want = _plain_katz([(i, t) for i, t, *_ in corpus])
    d = docs.select("doc_id", "text").withColumn("held_out", katz.held_out_of(F.col("doc_id")))
    for numbered, hot in ((1e-6, 1e-6), (1e-2, 1e-6), (1e-2, 0.05), (0.9, 0.9)):
        monkeypatch.setattr(katz, "CLASS_SHARE", numbered)
        monkeypatch.setattr(katz, "HOT_SHARE", hot)
        got = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in katz.score(d).collect())
        assert got == Counter((i, n, k, round(b, 6), round(s, 6)) for n, k, b, s, i in
                              ((*want[i, t], i) for i, t, *_ in corpus)), (numbered, hot)


def test_katz_in_small_chunks_and_buckets(spark, corpus, monkeypatch):
    """Packed rows come back whole; chunks alike share their answers; words that only held-out documents hold, however often,
    rows alike and missing flags change nothing."""
    r = np.random.default_rng(3)
    cols = [np.sort(r.integers(-(1 << 62), 1 << 62, 999)), r.integers(0, 9, 999), r.normal(size=999)]
    back = katz.unpack(katz.pack(*cols), 3)
    assert (back[0] == cols[0]).all() and (back[1] == cols[1]).all() and (back[2].view(np.float64) == cols[2]).all()
    assert [len(x) for x in katz.unpack(katz.pack(*[np.zeros(0, np.int64)] * 2), 2)] == [0, 0]

    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, t) for i, t, *_ in corpus] + [(i, "nowhere else " * 50 + words(20, i, 900)) for i in held] + [(5, corpus[-3][1])] * 3 + [(6, "")] * 3
    want = _plain_katz(rows)
    flag = F.when(F.col("doc_id").isNotNull(), katz.held_out_of(F.col("doc_id")))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", flag).withColumn("bucket", F.lit("x"))
    for chunk, bucket in ((1, 50), (200, 7), (300_000, 2_000_000)):
        monkeypatch.setattr(katz, "CHUNK", chunk)
        monkeypatch.setattr(katz, "BUCKET", bucket)
        monkeypatch.setattr(katz, "CLASS_SHARE", 1e-2)
        monkeypatch.setattr(katz, "HOT_SHARE", 0.05)
        got = katz.score(d).collect()
        assert len(got) == len(rows)
        by_id = {}
        for i, t in rows:
            by_id.setdefault(i, []).append(want[i, t])
        for i in by_id:
            mine = sorted((x.n_tokens, x.n_known, x.base_score, x.score) for x in got if x.doc_id == i)
            assert np.allclose(mine, sorted(by_id[i]), rtol=0, atol=1e-7), (chunk, i)


BLANK_WORD = "▁multitudes"


def test_pieces_round_trip_and_library(docs, corpus):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for _, t, *_ in corpus if t is not None] + ["  a  b \n\n c ", " ", "\n", "日本語 🙂 tab\t", "x" * 300]
    model = pieces.load()
    exact, some = pieces.Encoder(model, 0.0), pieces.Encoder(model, 0.3, 1)
    for i, t in enumerate(texts):
        if "▁" not in t:
            assert exact.encode(t).tolist() == sp.encode(t)
        assert some.decode(some.encode(t, i).tolist()) == t
    # each part through the plain agenda with the key of its document and number
    for coder in (some, pieces.Encoder(model, 0.1, 7)):
        coded = coder.encode_all(texts, list(range(len(texts))))
        for i, t in enumerate(texts):
            if "▁" not in t:
                parts = coder.parts(t)
                keys = coder.part_keys(np.full(len(parts), coder.key(i, t), np.uint64), np.arange(len(parts)))
                assert coded[i].tolist() == [x for p, k in zip(parts, keys) for x in coder.segment(p, int(k))[0]]
    often = some.encode(" ".join(["multitudes"] * 1000)).tolist()
    assert some.decode(often) == " ".join(["multitudes"] * 1000)
    draws = {tuple(some.encode("multitudes", d).tolist()) for d in range(1000)}
    assert len(draws) > 4 and len({tuple(some.segment(BLANK_WORD, int(k))[0]) for k in some.part_keys(
        np.full(1000, some.key(0, ""), np.uint64), np.arange(1000))}) > 4
    assert some.encode("same text", None).tolist() == some.encode("same text", None).tolist()
    got = pieces.encode(docs).collect()
    assert all(r.lossless for r in got if r.text is not None) and any(r.ids is None for r in got)
    back = pieces.decode(pieces.encode(docs).drop("text")).collect()
    assert Counter(r.text for r in back) == Counter(t for _, t, *_ in corpus)
    assert len({tuple(pieces.Encoder(model, 0.3, s).encode("unbelievable multitudes").tolist()) for s in range(9)}) > 1


def test_pieces_of_repeated_parts(corpus):
    coder = pieces.Encoder(pieces.load(), 0.4, 3)
    pairs, r = coder.pairs, random.Random(4)
    known = dict(zip(pairs.key.tolist(), zip(pairs.level.tolist(), pairs.merged.tolist())))
    some = [(k >> 32, k & 0xFFFFFFFF) for k in r.sample(list(known), 3000)]
    some += [(r.randrange(-1, len(pairs.symbols)), r.randrange(-1, len(pairs.symbols))) for _ in range(5000)]
    left, right = np.array(some, np.int32).T.reshape(2, 8, -1)
    level, merged = pairs.find(left, right)
    for x, y, got, into in zip(*(v.ravel().tolist() for v in (left, right, level, merged))):
        want = known.get(x << 32 | y) if x >= 0 and y >= 0 else None
        assert (got, into) == want if want else got == pieces.NEVER
    # what a row starts from is worked out once per part; each row still has its own draw
    parts = ["▁international", "▁the", "▁understanding", "é", "▁word▁" + "x" * 40]
    row = np.array([r.randrange(len(parts)) for _ in range(400)])
    key = np.array([r.getrandbits(64) for _ in row], np.uint64)
    ids, n, _, _ = coder.run(parts, key, row)
    ends = np.cumsum(n)
    for x, k, a, z in zip(row.tolist(), key.tolist(), ends - n, ends):
        assert ids[a:z].tolist() == coder.segment(parts[x], k)[0]


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    text = b" ".join(b"w%d" % (i % 9 if i < 60 else i) for i in range(90))
    bits = np.packbits(np.ones(71, bool)).tobytes()
    want = substring._judged(text, bits, 20)[3]
    rolling = substring.rolling
    # the first hash holds one bit of the window: most windows share it with others
    monkeypatch.setattr(substring, "rolling", lambda h, n, f: rolling(h, n, f) & np.uint64(1) if f == substring.M1 else rolling(h, n, f))
    assert want.any() and not want.all() and (substring._judged(text, bits, 20)[3] == want).all()


def test_substring_without_lists(spark, docs, monkeypatch):
    d = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    a = sorted(map(str, substring.repeats(d).drop("kept").collect()))
    monkeypatch.setattr(substring, "SAMPLE_HITS", 10**9)
    assert sorted(map(str, substring.repeats(d).drop("kept").collect())) == a
    assert substring.repeats(docs).count() == docs.count() and substring.repeats(d.limit(0)).count() == 0


def test_quality_counts_and_verdicts(spark, docs, corpus):
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.judge(docs).collect()}
    for d, t, *_ in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        cover = {x for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for x in range(k, k + 8)}
        r = got[d, len(w), sum(map(len, w))]
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.kept and r.base_failed)
    assert quality.judge(docs.limit(0)).count() == 0


def test_language_id(spark):
    d = spark.read.parquet(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001") + "/documents.parquet")
    m = langid.fit(langid.split(d).filter("not held_out"))
    out = langid.predict(langid.split(d), m).filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert out > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "der und"), (4, "der und")], "doc_id long, text string")
    got = langid.predict(odd, m).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[0].score == 0 and got[3] == got[4]
    assert langid.fit(langid.split(d).filter("false")) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_revisits(spark):
    rows = [(1, "http://a.org/x/", 10, "response", 200, '"e"', None, "d1", {"date": "1", "content-type": "t", "etag": '"e"'}),
            (2, "https://www.A.org/x#f", 20, "revisit", 304, 'W/"e"', None, None, {"date": "2", "content-type": "no"}),
            (3, "http://a.org/x", 5, "revisit", 304, '"e"', None, None, None),
            (4, "http://a.org/x", 30, "revisit", 304, '"f"', None, None, {}), (5, "http://a.org/x", 31, "revisit", 304, None, None, None, None),
            (6, None, 40, "revisit", 304, '"e"', None, None, None), (7, "http://a.org/x", None, "revisit", 304, '"e"', None, None, None)]
    rec = spark.createDataFrame(rows, "record_id long, url string, seen_at long, type string, status int, etag string, last_modified string, digest string, headers map<string,string>")
    got = {r.record_id: r for r in revisit.resolve(rec).collect()}
    assert {k: r.outcome for k, r in got.items()} == {2: "resolved", 3: "no earlier response", 4: "changed", 5: "unvalidated",
                                                     6: "no earlier response", 7: "no earlier response"}
    assert got[2].headers == {"date": "2", "content-type": "t", "etag": '"e"'} and got[2].response_id == 1
    pay = spark.createDataFrame([(1, "body")], "record_id long, payload string")
    assert {r.record_id: r.payload for r in revisit.with_payload(revisit.resolve(rec), pay).collect()}[2] == "body"


def test_secrets(spark):
    r = random.Random(3)
    rows = []
    for i in range(120):
        key = "".join(r.choice("ABCDEFGHIJ234567") for _ in range(16))
        text = f"the token = \"{xxhash.xxh64_hexdigest(str(i))}\" of" if i % 3 == 0 else f"see AKIA{key} now" if i % 3 == 1 else f"card {10**15 + i * 7919} paid"
        rows.append((i, text, "a/b.py"))
    rows += [(500, None, None), (501, "", None), (502, "no findings", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.scan(d, secrets.known_findings()).collect()
    assert len(got) == 120 and all(x.is_secret == (x.doc_id % 3 != 2) for x in got)
    assert all(rows[x.doc_id][1][x.place:x.place + x.length] == x.found for x in got)
    assert secrets.scan(d.limit(0), secrets.known_findings()).count() == 0


def test_pipeline(spark, tmp_path, docs, items):
    docs.withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns, name
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert done and all(x.lossless for x in done) and all(math.isfinite(x.n_pieces) for x in done)


def test_every_language_is_learnt(spark):
    """300 languages, some of copies of one text only; a plain ridge over all sampled rows gives the same scores."""
    rng = random.Random(5)
    rows = []
    for g in range(300):
        letters = [chr(0x4E00 + 20 * g + k) for k in range(20)]
        texts = [" ".join("".join(rng.choices(letters, k=4)) for _ in range(8)) for _ in range(1 if g % 3 == 0 else 4)]
        rows += [(f"g{g:03d}", t) for t in texts for _ in range(40 if g % 3 == 0 else 1)]
    rows += [("once", "abc"), ("bare", "123"), ("bare", "456"), (None, "def"), ("g000", None)]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    for most in (768, 100):
        model = langid.fit(labelled, sample_per_lang=3, most_landmarks=most)
        assert model["langs"] == [f"g{g:03d}" for g in range(300)] and len(model["bits"]) <= most
        if most == 768:
            got = langid.predict(labelled, model).filter("lang like 'g%' and text is not null").collect()
            texts = {(r.lang, r.text, r.lang_pred) for r in got}
            right = sum(a == b for a, _, b in texts) / len(texts)
            assert right > 0.9, right
    # the plain way: kernel features of every sampled row, the normal equations at once
    few = spark.createDataFrame([x for x in rows if x[0] and x[1] and x[0] < "g020"], "lang string, text string").dropDuplicates()
    few = few.unionByName(few)
    model = langid.fit(few, ridge=1e-2)
    marks = langid.unpacked(model["bits"])
    table = langid.letter_table()

    def features(text):
        x = np.zeros((1, langid.WIDTH), np.uint8)
        langid.mark_presence(text, x[0], table)
        return langid.kernel(x.astype(np.float32), marks.T, marks.sum(1))[0].astype(float)

    told = [tuple(r) for r in few.distinct().collect()]
    told = [x for x in told if x[0] in model["langs"]]
    k = np.stack([features(t) for _, t in told])
    own = langid.kernel(marks, marks.T, marks.sum(1)).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    phi = np.c_[k @ (vector[:, value > 1e-6 * value.max()] / np.sqrt(value[value > 1e-6 * value.max()])), np.ones(len(k))]
    y = np.array([[1.0 if g == h else -1.0 for h in model["langs"]] for g, _ in told])
    penalty = 1e-2 * len(k) * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    f = phi @ np.linalg.solve(phi.T @ phi + penalty, phi.T @ y)
    want = {t: (model["langs"][i], np.clip((s + 1) / 2, 0, 1)) for (_, t), i, s in zip(told, f.argmax(1), f.max(1))}
    for r in langid.predict(few, model).collect():
        if r.lang == "bare":
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        assert r.lang_pred == want[r.text][0] and abs(r.score - want[r.text][1]) < 1e-3
    assert langid.fit(few.limit(0)) is None


def test_katz_sorts_and_counts_once(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (0, 1, 5000):
        bucket, x, y = rng.integers(0, 7, n), rng.integers(-3, 40, n) << 50, rng.integers(0, 9, n)
        assert katz._lexsorted(bucket, x, y).tolist() == np.lexsort((y, x, bucket)).tolist()
    wide = rng.integers(0, 1 << 60, 50)                         # no room for its ranks
    assert katz._lexsorted(wide, wide, wide).tolist() == np.argsort(wide).tolist()
    batch = pa.RecordBatch.from_arrays([pa.array(["a b a", "b c", None]), pa.array([False, True, False])], names=["text", "out"])
    updates, plain = [], Counter.update

    def update(self, words=None):
        updates.append(len(words or ()))
        plain(self, words)

    monkeypatch.setattr(katz.Counter, "update", update)
    got = {r["word"]: (r["c"], r["n"]) for b in katz._count_words(iter([batch])) for r in b.to_pylist()}
    assert got == {b"a": (2, 2), b"b": (1, 2), b"c": (0, 1), katz.END_WORD: (2, 3)} and sum(updates) == 8


def test_katz_tasks_take_bounded_batches_and_counts(spark, monkeypatch):
    counted = katz._count_words

    def watched(batches):
        yield from counted(b for b in batches if b.nbytes < 8 << 20 or 1 / 0)

    own = spark.conf.get(katz_bound := "spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.unset(katz_bound)
    monkeypatch.setattr(katz, "_count_words", watched)
    try:
        d = spark.range(24, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('ab cd ', 150000)").alias("text"), F.lit(False).alias("held_out"))
        assert katz.train(d)[0]["total"] == 24 * 300_001
    finally:
        spark.conf.unset(katz_bound) if own is None else spark.conf.set(katz_bound, own)
    text = pa.array([" ".join(f"w{i}x{j}" for j in range(100_000)) for i in range(8)])
    batch = pa.RecordBatch.from_arrays([text, pa.array([False] * 8)], names=["text", "out"])
    flushed = [b.num_rows for b in counted(iter([batch]))]
    assert sum(flushed) == 800_000 + len(flushed) and max(flushed) < 500_000
