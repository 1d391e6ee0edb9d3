"""Cross-tokenizer alignment, vector codes and shards, against brute force on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import crosstok, queries, sharding, vectorcodes

TEXTS = [None, "", " ", "x", "hello world", "a▁b", "<|endoftext|> and </s> are text", "naïve café — déjà vu", "汉字 kana かな 🙂🙂", "Ωμέγα и кириллица",
         "tab\tand\n\nlines \r\n  end  ", "don't we'll I'm 1234 5.6e-7 ||;,", "\x00\x01 control \x85 \xa0   blanks", "hello world", "word " * 300,
         "".join(chr(c) for c in range(1, 0x530))]


def _tokens(al, text):
    a = al.a.encode(" " + text, add_special_tokens=False).ids
    b = al.b.encode(text)
    spelt = [b"".join(table[i] for i in ids) for table, ids in ((al.bytes_a, a), (al.bytes_b, b))]
    return (a, b) if spelt == [(" " + text).encode()] * 2 else ([], [])


def _plain_alignment(texts):
    """Per text: A and B ids, groups as lists, links; by walking both sequences of ends."""
    al = crosstok.Aligner(crosstok.load())
    out = []
    for text in texts:
        a, b = _tokens(al, text) if text else ([], [])
        ea, eb = ([sum(len(t[i]) for i in ids[:k + 1]) for k in range(len(ids))] for t, ids in ((al.bytes_a, a), (al.bytes_b, b)))
        groups, links, ga, gb = [], [], [], []
        both = set(ea) & set(eb)
        i = j = 0
        for e in sorted(both):
            ga, gb = [], []
            while i < len(a) and ea[i] <= e:
                ga.append(a[i])
                i += 1
            while j < len(b) and eb[j] <= e:
                gb.append(b[j])
                j += 1
            groups.append((ga, gb))
            links.append((ga[-1], gb[-1]))
        out.append((a, b, groups, links))
    return out


def test_alignment_against_plain_walk(spark, tmp_path):
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice("ab \n'1é—字") for _ in range(r.randrange(60))) for _ in range(120)]
    rows = [(i if i % 9 else None, t, i, "own") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, a_ids string")
    want = _plain_alignment(texts)
    count = Counter(x for *_, links in want for x in links)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_cross_tokenizer"](spark, str(tmp_path)).collect()
    spelt = lambda groups: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    as_row = lambda i, a, b, g, ln: (i, len(a), len(b), len(g), len(ln), sum(count[x] == top[x[1]] for x in ln), sum(count[x] for x in ln),
                                     hashlib.sha256(spelt(g).encode()).hexdigest() if a else "")
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(str, (tuple(x[c] for c in names) for x in got))) == sorted(str(as_row(row[0], *w)) for row, w in zip(rows, want))
    # the operator's own output: ids and group sizes; a column of the same name is replaced, others pass
    full = {x.n: x for x in crosstok.align(docs).collect()}
    for k, (a, b, groups, _) in enumerate(want):
        x = full[k]
        if not a:
            assert x.a_ids is None and x.b_ids is None
        else:
            assert (x.a_ids, x.b_ids) == (a, b) and list(zip(x.a_sizes, x.b_sizes)) == [(len(g), len(h)) for g, h in groups]
    assert set(crosstok.align(docs).columns) == {"doc_id", "text", "n", "a_ids", "b_ids", "a_sizes", "b_sizes"}


def test_both_libraries_give_the_same_ids():
    al = crosstok.Aligner(crosstok.load())
    assert al.quick
    r = random.Random(8)
    chars = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x530))]
    for text in ["".join(chars), *("".join(r.choice(chars[:98] if k % 2 else chars) for _ in range(80)) for k in range(400))]:
        assert crosstok.PLAIN.fullmatch(text)
        assert al.quick(" " + text) == al.a.encode(" " + text, add_special_tokens=False).ids


def test_pointers_reach_the_last_token_of_long_components():
    # ends that meet only at the very end: one group, however long the chain
    n = 5000
    end_a, end_b = np.r_[np.arange(2, 2 * n, 2), 2 * n], np.r_[np.arange(1, 2 * n - 1, 2), 2 * n]
    a, b, with_b = crosstok.Aligner.groups(end_a, end_b)
    assert not a.any() and not b.any() and with_b.tolist() == [len(end_b) - 1]


def test_alignment_of_long_and_empty(spark):
    long = " ".join(f"w{i % 977} ünï{i % 13}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, "x" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in crosstok.align_report(docs).collect()}
    want = _plain_alignment([" ".join(long.split()[:50])])[0]
    assert got[1].n_groups == got[1].n_links > 100_000 and got[2].n_a > 0 and len(want[2])
    assert crosstok.align_report(docs.limit(0)).collect() == [] and crosstok.align(docs.limit(0)).collect() == []


# ---- vector codes ----

def _plain_codes(rows, entries=64, positions=16, rounds=2):
    """rows: (id, grid vector). Codes, errors and codebooks by comparing everything with everything."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(rows[0][1]) // positions
    part = lambda v, p: v[p * d:(p + 1) * d]
    books = [[list(part(v, p)) for _, v in rows[:entries]] for p in range(positions)]
    dist = lambda x, c: sum((s - t) ** 2 for s, t in zip(x, c))
    near = lambda x, p: min(range(len(books[p])), key=lambda e: (dist(x, books[p][e]), e))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in rows:
            for p in range(positions):
                held[p, near(part(v, p), p)].append(part(v, p))
        for (p, e), xs in held.items():
            books[p][e] = [sum(col) // len(xs) for col in zip(*xs)]
    out = []
    for i, v in rows:
        code = [near(part(v, p), p) for p in range(positions)]
        out.append((i, "".join(f"{c:02x}" for c in code), sum(dist(part(v, p), books[p][c]) for p, c in enumerate(code))))
    return out, books


def _vectors(n, dim, seed, spread=40):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    return [[c + r.randrange(-spread, spread) / 256 for c in centres[r.randrange(5)]] for _ in range(n)]


@pytest.mark.parametrize("dim,block", [(32, 4096), (16, 64), (48, 97)])
def test_codes_against_brute_force(spark, monkeypatch, dim, block):
    monkeypatch.setattr(vectorcodes, "BLOCK_ROWS", block)
    base = _vectors(260, dim, dim)
    base += [base[3]] * 90 + [base[5]] * 2                        # a third of the rows is one vector
    rows = [(i if i % 50 else None, v, [None, 1, 2][i % 3], "x") for i, v in enumerate(base)]
    rows += [(900, None, 1, "x"), (901, [*base[0][:-1], None], 1, "x"), (902, [*base[0][:-1], math.nan], 2, "x"), (903, [math.inf, *base[0][1:]], 2, "x")]
    odd = [(904, base[0][:-1], 1, "x"), (905, [], 2, "x"), (906, [1e30, *base[0][1:]], None, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, code string").repartition(3)
    grid = lambda v: [math.floor(256 * x) for x in v]
    want, books = _plain_codes([(i, grid(v)) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)])
    coded, got_books = vectorcodes.compress(df)
    got = vectorcodes.label_errors(coded).collect()
    assert got_books.tolist() == books
    assert sorted(map(str, ((r.vec_id, r.code, r.error) for r in got if r.code))) == sorted(map(str, want))
    assert {r.vec_id for r in got if r.code is None} == {904, 905, 906}
    totals = defaultdict(int)
    for r in got:
        totals[r.label] += r.error or 0
    assert all(r.label_error == totals[r.label] for r in got)


def test_ties_few_vectors_and_empty_tables(spark):
    rows = [(1, [0.0] * 16, 0), (2, [2 / 256] * 16, 0), (3, [1 / 256] * 16, 1)]      # the third lies between the others
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    coded, books = vectorcodes.compress(df, entries=2, rounds=0)
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == {1: ("00" * 16, 0), 2: ("01" * 16, 0), 3: ("00" * 16, 16)}
    coded, books = vectorcodes.compress(df)
    assert books.shape == (16, 3, 1) and len(coded.collect()) == 3
    coded, books = vectorcodes.compress(df.limit(0))
    assert vectorcodes.label_errors(coded).collect() == [] and books.size == 0


def test_cover_trees_cover():
    r = np.random.default_rng(2)
    points = np.concatenate([r.integers(-300, 300, (900, 3)), np.repeat(r.integers(-300, 300, (3, 3)), 200, 0)])
    tree = vectorcodes.grow(points, 1)
    seen = points[tree.order]
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for a, b, far, first, children in zip(tree.start, tree.end, tree.radius, tree.first, tree.children):
        assert ((seen[a:b] - seen[a]) ** 2).sum(1).max() <= far * far + 1e-6
        if children:
            below = range(first, first + children)
            assert [tree.start[first], *(tree.end[k] for k in below)] == [a, *(tree.start[k] for k in below[1:]), b]
    books = points[r.integers(0, len(points), 40)][None]
    whole = sum(int((e - s).sum()) for s, e, *_ in vectorcodes.assign(points, tree, books))
    assert whole == len(points)


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = [(i, f"{i:02x}", i % 7, i % 4 or None) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, code string, error long, label int")
    key = lambda d: sorted(map(str, d.collect()))
    want = key(vectorcodes.label_errors(df))
    monkeypatch.setattr(vectorcodes, "LABELS", 0)
    assert key(vectorcodes.label_errors(df)) == want


# ---- shards ----

def _plain_shards(rows, shards):
    keyed = []
    for i, t in rows:
        raw = (t or "").encode()
        keyed.append((hashlib.md5(raw).hexdigest()[:15], i is not None, i or 0, zlib.crc32(raw), len(raw) + 8, i))
    keyed.sort()
    total, done, out, slot = sum(k[4] for k in keyed), 0, [], Counter()
    for *_, crc, size, i in keyed:
        s = (2 * done + size) * shards // (2 * total)
        out.append((i, size, crc, s, slot[s]))
        slot[s] += 1
        done += size
    return out


def _shard_rows(df):
    return [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()]


@pytest.mark.parametrize("limit", [500_000, 7])
def test_shards_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(sharding, "RANGE_KEYS", limit)
    monkeypatch.setattr(sharding, "STEP", 3)
    r = random.Random(6)
    rows = [(i if i % 40 else None, "copy of one text " * 4 if i % 3 == 0 else None if i % 17 == 0 else "é" * r.randrange(200)) for i in range(400)]
    rows += [(7777, "the same row")] * 30 + [(9000, "long " * 4000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, h string").repartition(3)
    for shards in (1, 5, 24):
        got = _shard_rows(sharding.assign(docs, shards))
        assert sorted(map(str, got)) == sorted(map(str, _plain_shards(rows, shards)))
    if limit == 7:          # copies of one text are spread over several ranges
        p = sharding.plan(docs, 5)
        full = sharding.in_ranges(p.keys, p.cut).groupBy("range").agg(F.count("*").alias("n")).collect()
        assert max(x.n for x in full) <= limit * sharding.OVERFULL + 1


def test_shards_of_nothing_and_of_few(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(empty).collect() == []
    one = sharding.assign(empty.union(spark.createDataFrame([(None, None)], "doc_id long, text string"))).collect()
    assert [(x.doc_id, x.size, x.text_crc32, x.shard, x.slot) for x in one] == [(None, 8, 0, 12, 0)]


def test_written_shards_hold_whole_rows(spark, tmp_path):
    rows = [(i, f"text {i % 50} " * (i % 9), i, None if i % 5 else "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, `odd name` string")
    found = sharding.write_shards(docs, f"{tmp_path}/out", 6)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert {(x.doc_id, x.shard) for x in back.collect()} == {(x.doc_id, x.shard) for x in found.collect()}
    sharding.write_shards(docs.limit(0), f"{tmp_path}/none", 6)
