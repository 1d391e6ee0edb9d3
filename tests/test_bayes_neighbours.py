"""Naive Bayes folds and nearest neighbours against plain numpy."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.catalog import explore
from riskloom.operators import bayes
from riskloom.operators import neighbours as nb


def test_folds_against_fitting_each_one(spark):
    r = np.random.default_rng(1)
    y = r.integers(0, 3, 240)
    x = np.c_[r.normal(y, 1.0), r.normal(1e6 + 3 * y, 2.0), np.full(240, 7.0)]        # a large offset, a constant column
    rows = [(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))] + [(500, None, 1.0, 7.0, 1), (501, 1.0, 1.0, 7.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    got = {g.fold: (g.n, g.accuracy) for g in bayes.cross_validate(df, ["a", "b", "c"], "y", "id", 4).collect()}
    fold = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 4 for i in range(240)])
    x = x - x.mean(0)
    for f in range(4):
        t, v = x[fold != f], x[fold == f]
        own, extra = y[fold != f], 1e-9 * t.var(0).max()
        score = [np.log((own == c).mean()) - 0.5 * (np.log(2 * np.pi * (t[own == c].var(0) + extra)) + (v - t[own == c].mean(0)) ** 2 / (
            t[own == c].var(0) + extra)).sum(1) for c in range(3)]
        assert got[f][0] == (fold == f).sum() and got[f][1] == pytest.approx((np.argmax(score, 0) == y[fold == f]).mean())


@pytest.mark.parametrize("cell,block", [(1500, 4096), (20, 7)])
def test_neighbours_against_all_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(nb, "CELL", cell)
    monkeypatch.setattr(nb, "BLOCK", block)
    r = np.random.default_rng(5)
    v = np.concatenate([r.integers(0, 30, (150, 2)), r.normal(200, 5, (60, 2)), np.zeros((80, 2))]).astype(float)     # ties, a far cloud, many alike
    ids = r.permutation(10_000)[:len(v)]
    df = spark.createDataFrame([(int(i), *map(float, x)) for i, x in zip(ids, v)] + [(20_000, None, 1.0)], "id long, p double, q double").repartition(5)
    got = {}
    for x in nb.nearest_neighbours(df, "id", ["p", "q"], 4).collect():
        got.setdefault(x.id, {})[x["rank"]] = (x.neighbour, x.distance)
    for i, x in zip(ids, v):
        d = ((v - x) ** 2).sum(1)
        want = sorted((d2, o) for d2, o in zip(d, ids) if o != i)[:4]
        assert [got[i][k] for k in range(1, 5)] == [(o, pytest.approx(np.sqrt(d2))) for d2, o in want]
    assert len(got) == len(v)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 3.0)], "id long, p double")
    assert sorted((x.id, x["rank"], x.neighbour) for x in nb.nearest_neighbours(df, "id", ["p"], 5).collect()) == [
        (1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 1), (3, 1, 2), (3, 2, 1)]
    assert nb.nearest_neighbours(df.limit(0), "id", ["p"]).collect() == [] == nb.nearest_neighbours(df.limit(1), "id", ["p"]).collect()


def test_synthetic_rows_even_out_the_classes(spark):
    df = spark.createDataFrame([(i, "Y" if i % 7 == 0 else "N", float(i % 11), float(i)) for i in range(140)], "id long, y string, p double, q double")
    made = nb.synthetic_minority(df, "id", "y", "Y", ["p", "q"], 3).cache()
    assert made.count() == 140 - 2 * 20 and made.select("base").distinct().count() == 20
    ends = {i: (float(i % 11), float(i)) for i in range(140)}
    for x in made.collect():
        a, b = ends[x.base], ends[x.neighbour]
        assert x.base != x.neighbour and 0 <= x.share < 1
        assert (x.p, x.q) == tuple(pytest.approx(s + x.share * (t - s)) for s, t in zip(a, b))
    assert made.where(F.col("neighbour") % 7 != 0).count() == 0


def test_a_fit_reads_rows_that_are_split_once(spark, monkeypatch):
    rows = [(i, *[float(i * k % 7) for k in range(9)], int(i % 4 == 0)) for i in range(200)]
    names = [*explore.legacy.FEATURES, explore.legacy.TARGET]
    df = spark.createDataFrame(rows, ["row_id", *names])
    given, fit = [], explore.ex.fit
    monkeypatch.setattr(explore, "_model_rows", lambda sp, d: df)
    monkeypatch.setattr(explore.ex, "fit", lambda rows, *more: (given.append(rows), fit(rows, *more))[1])
    assert sum(r.support for r in explore.QUERIES["fit_decision_tree"](spark, "").collect()) == 40
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan, plan


@pytest.mark.parametrize("bounded", [False, True])
def test_a_block_is_searched_in_part(monkeypatch, bounded):
    """Points far off in the widest column are not compared, and the answers are those of all pairs."""
    r = np.random.default_rng(3)
    v = np.stack([r.integers(0, 100_000, 3000), r.integers(0, 30, 3000)], axis=1).astype(float)
    v[:40] = v[0]                                               # equals go by key
    ids, compared, plain = r.permutation(3000).astype(np.int64), [], nb.squared
    d = plain(v, v)
    d[ids[:, None] == ids[None, :]] = np.inf
    want = {(int(ids[i]), int(ids[j]), d[i, j]) for i in range(3000) for j in np.lexsort((ids, d[i]))[:4]}
    far = np.sort(d, axis=1)[:, 3] if bounded else np.full(3000, np.inf)

    def rows(asks, bound):
        n = pa.array(np.zeros(3000, np.int32))
        return pa.RecordBatch.from_arrays([n, n, pa.array(np.full(3000, asks, np.int32)), pa.array(ids), pa.array(list(v)), pa.array(bound)],
                                          names=["cell", "block", "asks", "id", "v", "d2"])

    monkeypatch.setattr(nb, "squared", lambda x, y: compared.append(len(x) * len(y)) or plain(x, y))
    got = [b.to_pydict() for b in nb._search(4)([rows(0, np.full(3000, np.inf)), rows(1, far)])]
    assert {t for b in got for t in zip(b["id"], b["other"], b["d2"])} == want
    assert sum(compared) < 3000 * 3000 / 10
