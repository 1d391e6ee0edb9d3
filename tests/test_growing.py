"""How many boosted trees a model keeps."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors

from riskloom.catalog import models
from riskloom.operators import model as md
from riskloom.plans import training


def _rows(spark, n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x = [r.random() for _ in range(4)]
        out.append((Vectors.dense(x), float(r.random() < 0.15 + 0.5 * (x[0] > 0.7) * (x[1] > 0.4)), 1.0))
    return spark.createDataFrame(out, ["_v", "y", "weight"]).coalesce(1).persist()


@pytest.fixture(scope="module")
def data(spark):
    return _rows(spark, 400, 1), _rows(spark, 150, 2)


def _gbt():
    return GBTClassifier(featuresCol="_v", labelCol="y", weightCol="weight", maxDepth=3, stepSize=0.3, subsamplingRate=0.8,
                         featureSubsetStrategy="0.8", seed=42)


def _plain(margins, labels):
    """Average precision over the distinct margins, highest first."""
    total, hits, seen = 0.0, 0, 0
    for m in sorted(set(margins), reverse=True):
        pos = sum(y for x, y in zip(margins, labels) if x == m)
        hits, seen = hits + pos, seen + margins.count(m)
        total += pos * hits / seen
    return total / sum(labels)


def _wanted(fitted, rows):
    got, found = rows.collect(), []
    for n in range(1, fitted.getNumTrees + 1):
        margins = [sum(w * t.predict(r["_v"]) for t, w in zip(fitted.trees[:n], fitted.treeWeights)) for r in got]
        found.append(_plain([round(m, 12) for m in margins], [int(r["y"]) for r in got]))
    return found


@pytest.mark.parametrize("at_once", [10**6, 300])
def test_precision_of_every_length(data, monkeypatch, at_once):
    monkeypatch.setattr(md, "JUDGED_ROWS", at_once)
    fitted = _gbt().setMaxIter(6).fit(data[0])
    assert md.average_precisions(fitted, data[1]) == pytest.approx(_wanted(fitted, data[1]))
    assert md.average_precisions(fitted, data[1].where("y = 0")) == [1.0] * 6


def test_the_first_trees_are_a_model(data):
    fitted = _gbt().setMaxIter(6).fit(data[0])
    short, same = md.first_trees(fitted, 4), _gbt().setMaxIter(4).fit(data[0])
    assert short.getNumTrees == 4 and md.first_trees(fitted, 6) is fitted
    a, b = ([r["rawPrediction"][1] for r in m.transform(data[1]).collect()] for m in (short, same))
    assert a == pytest.approx(b)
    assert np.allclose(short.featureImportances.toArray(), same.featureImportances.toArray())


@pytest.mark.parametrize("values, want", [([1, 2, 2, 1, 5], (2, True)), ([1, 2, 1, 3, 1], (4, False)), ([1.0] * 9, (1, True)), ([3], (1, False))])
def test_patience(monkeypatch, values, want):
    monkeypatch.setattr(md, "PATIENCE", 3 if len(values) > 5 else 2)
    assert md.chosen_length(values) == want


@pytest.mark.parametrize("trees, patience", [(24, 3), (24, 7), (5, 7)])
def test_growing_goes_on_until_nothing_improves(data, monkeypatch, trees, patience):
    monkeypatch.setattr(md, "PATIENCE", patience)
    monkeypatch.setattr(md, "FIRST_FIT", 2)
    whole = _wanted(_gbt().setMaxIter(trees).fit(data[0]), data[1])
    assert md.grow(_gbt(), *data, trees).getNumTrees == md.chosen_length(whole)[0]


def test_registered_models_are_grown_whole(spark, monkeypatch):
    """No registered query lowers the number of trees or the patience."""
    asked = []

    def fit(df, columns, **kw):
        asked.append(kw.get("trees", md.TREES))
        raise StopIteration

    monkeypatch.setattr(md, "train", lambda train_rows, val_rows, columns, **kw: fit(train_rows, columns, **kw))
    monkeypatch.setattr(training, "require_positives", lambda *a: None)
    monkeypatch.setattr(models, "_fits", {})
    with pytest.raises(StopIteration):
        models.fitted(spark, "/root/testdata/sf0.001")
    assert asked == [2000] and md.PATIENCE == 100


def test_the_ablation_is_grown_whole(monkeypatch):
    asked = []
    monkeypatch.setattr(models, "fitted", lambda sp, d: "fitted")
    monkeypatch.setattr(models, "tidy", lambda df, digits: df)
    monkeypatch.setattr(training, "ablate", lambda f, trees=md.TREES, check_leaks=True: (asked.append(trees), "table"))
    assert models.QUERIES["ablation_without_pair_history"](None, "") == "table" and asked == [2000]
