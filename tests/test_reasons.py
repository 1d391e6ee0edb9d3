"""Reason codes and the fit around them: the same results, with little shuffled and the features read once."""

import re

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskloom.operators import model as md
from riskloom.plans import training
from riskloom.session import SETTINGS, compiled

COLUMNS = ["amount_log", "payee_total_txn_count", "amount_roundness"]


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(3000).select(
        F.concat(F.lit("t"), n).alias("txn_id"), (n * 7919 % 101 / 10).alias("amount_log"), (n * 31 % 17).alias("payee_total_txn_count"),
        F.element_at(F.array(F.lit("thousand"), F.lit("hundred"), F.lit("neither")), (n % 3 + 1).cast("int")).alias("amount_roundness"),
        ((n * 7919 % 101 > 80) | (n * 31 % 17 == 3)).alias("label_is_fraud"), (n % 2 == 0).alias("is_cold"),
        F.when(n % 5 == 0, "ALLOW").otherwise("WARN").alias("action"))


@pytest.fixture(scope="module")
def models(rows):
    m = md.train(rows.where("txn_id < 't2'"), rows.where("txn_id >= 't2'"), COLUMNS, trees=3, check=False)
    return {"cold": m, "warm": m}


def test_reasons_are_the_falls_of_the_margin(rows, models):
    m = models["cold"]
    some = rows.where("txn_id < 't11'")
    got = {r.txn_id: [(c.feature, round(c.contribution, 9)) for c in r.reason_codes] for r in md.reason_codes(some, models).collect()}
    want = {}
    for r in md.feature_array(some, COLUMNS, "x").where("action <> 'ALLOW'").collect():
        margin = lambda x: float(m.trees.predictRaw(Vectors.dense(x))[1])
        falls = [(c, margin(r.x) - margin([*r.x[:i], m.baseline[i], *r.x[i + 1:]])) for i, c in enumerate(COLUMNS)]
        if found := sorted(((c, v) for c, v in falls if v > 0), key=lambda p: (-p[1], p[0])):
            want[r.txn_id] = [(c, round(v, 9)) for c, v in found]
    assert want and got == want


def test_rows_are_repeated_after_the_shuffle(rows, models):
    plan = md.reason_codes(rows, models)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [max(") == 2
    for part in plan.split("Union")[1].split("Generate explode")[1:]:
        assert "Window [max(" in part


def test_a_task_takes_a_bounded_share_of_the_alerts(rows, models, monkeypatch):
    whole = sorted(map(str, md.reason_codes(rows, models).collect()))
    monkeypatch.setattr(md, "ALERTS_PER_TASK", 50)
    cut = md.reason_codes(rows, models)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(txn_id#\d+, 24\), REPARTITION_BY_NUM", plan)) == 2
    assert whole and sorted(map(str, cut.collect())) == whole


def test_features_are_read_once_by_the_fit(spark, rows, monkeypatch):
    read, split = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    events = rows.withColumns({"ts": F.timestamp_seconds(F.lit(1_700_000_000) + F.substring("txn_id", 2, 9).cast("long") * 3600), "label_typology": F.lit("legit"),
                               "amount": F.lit(1.0)})
    events = events.mapInArrow(counted, events.schema)
    monkeypatch.setattr(training, "assert_in_time", lambda r: split.append(r) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        training.fit(events, (0, 9), (10, 19), (20, None))
    days = {r.split: r.n for r in split[0].groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert days == {"train": 240, "val": 240, "test": 2520} and read.value == 3000


def test_generated_methods_stay_small_enough_to_compile(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    other = spark.newSession()
    other.conf.unset(key)
    compiled(other)
    assert other.conf.get(key) == SETTINGS[key]
    other.conf.set(key, "9000")
    compiled(other)
    assert other.conf.get(key) == "9000"
