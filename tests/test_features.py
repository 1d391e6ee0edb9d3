import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.catalog.shared import tidy
from riskloom.functions import columns as C
from riskloom.functions.registry import ALL_FEATURES, BASE_FEATURES, COLD_FEATURES, MAYBE_MISSING, WARM_ONLY_FEATURES
from riskloom.operators import features as ft
from riskloom.operators import history as h
from riskloom.operators.asof import hot_keys
from riskloom.operators.hotmedian import hot_median
from riskloom.operators.median import Ordered
from riskloom.sources import testviews as views

from conftest import DATA

NO_HOT = {"payer_vpa": [], "payee_vpa": [], "device_id": []}


def rows(df):
    return sorted(map(str, df.collect()))


def one(df, txn):
    return df.where(F.col("txn_id") == txn).first()


def test_contract():
    assert (len(BASE_FEATURES), len(MAYBE_MISSING)) == (37, 14)
    assert (len(ALL_FEATURES), len(COLD_FEATURES), len(WARM_ONLY_FEATURES)) == (51, 34, 17)
    assert set(ft.feature_columns.__code__.co_names) and ALL_FEATURES[8:10] == [
        "amount_zscore_vs_payer_30d", "amount_zscore_vs_payer_30d_is_missing"]
    assert set(COLD_FEATURES) | set(WARM_ONLY_FEATURES) == set(ALL_FEATURES)


def test_column_order_is_the_contract(events):
    assert ft.point_in_time(events({}), hot=NO_HOT).columns[-51:] == ALL_FEATURES


def test_unseen_payee(events):
    r = ft.point_in_time(events({}), hot=NO_HOT).first()
    assert r.is_cold and r.payee_is_unseen and r.payee_age_hours_in_system == 0
    for f in ("payee_distinct_payers_1h", "payee_fanin_velocity", "payee_amount_mean", "payee_p2m_ratio",
              "days_since_payer_last_paid_payee"):
        assert r[f] is None and r[f + "_is_missing"]
    assert r.payer_payee_txn_count == 0 and r.is_first_ever_txn_by_payer and r.is_new_device_for_payer


def test_fan_in(events):
    ev = events(*[dict(at=i, payer_vpa=f"p{i}@bank") for i in range(40)], dict(at=45, payer_vpa="last@bank", txn_id="probe"))
    r = one(ft.point_in_time(ev, hot=NO_HOT), "probe")
    assert r.payee_distinct_payers_1h == 40 and r.payee_distinct_payers_since_first_seen == 40
    assert 30 <= r.payee_fanin_velocity <= 45


def test_routing_to_a_fresh_payee(events):
    ev = events(*[dict(at=i) for i in range(4)])
    assert [r.is_cold for r in ft.cold_flags(ev, hot=NO_HOT).orderBy("txn_id").collect()] == [True, True, True, False]


def test_same_moment_rows_do_not_see_each_other(events):
    ev = events(dict(at=0), dict(at=0, payer_vpa="b@bank"), dict(at=1, txn_id="z"))
    out = ft.point_in_time(ev, hot=NO_HOT)
    assert {r.payee_total_txn_count for r in out.where("txn_id != 'z'").collect()} == {0}
    assert one(out, "z").payee_distinct_payers_since_first_seen == 2


def test_window_edges(events):
    # [t - 1h, t): a row exactly an hour back counts, the present moment does not
    ev = events(dict(at=0), dict(at=60, txn_id="edge"), dict(at=61, txn_id="past"))
    out = h.payer_txn_count(ev, hot=NO_HOT)
    assert one(out, "edge").payer_n_1h == 1 and one(out, "past").payer_n_1h == 1
    assert one(out, "past").payer_n == 2


def test_zscore_and_median(events):
    ev = events(dict(at=0, amount=100.0), dict(at=10, amount=200.0), dict(at=20, amount=450.0, txn_id="probe"),
                dict(at=30, amount=0.0, txn_id="later"))
    r = one(ft.point_in_time(ev, hot=NO_HOT), "probe")
    assert r.amount_zscore_vs_payer_30d == pytest.approx(6.0) and r.amount_ratio_to_payer_median == pytest.approx(3.0)


def test_equal_amounts_have_no_zscore(events):
    ev = events(*[dict(at=i, amount=333.33) for i in range(5)])
    out = ft.point_in_time(ev, hot=NO_HOT).orderBy("txn_id").collect()
    assert all(r.amount_zscore_vs_payer_30d is None for r in out) and out[-1].payee_amount_std == 0


@pytest.mark.parametrize("amount, kind", [(0.0, "thousand"), (3000.0, "thousand"), (500.0, "hundred"), (550.0, "neither"),
                                          (1000.5, "neither")])
def test_roundness(events, amount, kind):
    assert events(dict(amount=amount)).select(C.roundness("amount")).first()[0] == kind


@pytest.mark.parametrize("vpa, digits, entropy, name", [
    ("@x", 0.0, 0.0, False), ("aabb@x", 0.0, 1.0, False), ("a1b2@x@y", 0.5, 2.0, False), ("priyastores9@x", 1 / 12, None, True),
    ("9988@x", 1.0, 1.0, False)])
def test_handles(events, vpa, digits, entropy, name):
    r = events(dict(payee_vpa=vpa)).select(C.digit_ratio("payee_vpa"), C.entropy("payee_vpa"), C.has_name("payee_vpa")).first()
    assert r[0] == pytest.approx(digits) and r[2] is name
    assert entropy is None or r[1] == pytest.approx(entropy)


def test_future_rows_change_nothing(spark):
    ev = views.txn(spark, DATA)
    cut = "2024-01-15"
    past = tidy(ft.point_in_time(ev.where(F.col("ts") < cut), hot=NO_HOT))
    whole = tidy(ft.point_in_time(ev, hot=NO_HOT).where(F.col("ts") < cut))
    assert rows(past) == rows(whole)


def test_warm_up_slice_is_part_of_the_whole(spark):
    ev = views.txn(spark, DATA)
    late = ft.since(ft.point_in_time(ev, hot=NO_HOT), "2024-01-20")
    assert late.where("is_cold = false").count() > 0
    assert late.agg(F.min("ts")).first()[0].day >= 20


def test_hot_keys_give_the_same_features(spark):
    ev = views.txn(spark, DATA).persist()
    hot = hot_keys(ev, min_rows=9, share=0.0)
    assert hot["payer_vpa"] and hot["device_id"]
    plain = tidy(ft.point_in_time(ev, hot=NO_HOT))
    split = tidy(ft.point_in_time(ev, hot=hot, width=12 * C.HOUR))
    assert rows(plain) == rows(split)


@pytest.mark.parametrize("read", ["payer_txn_count", "payer_last_txn", "payer_new_payee_ratio", "payee_distinct_payers",
                                  "payee_amount_stats", "pair_last_txn_time", "device_distinct_payers"])
def test_hot_keys_give_the_same_reads_with_ties(spark, read):
    ev = views.txn_ties(spark, DATA).where("txn_id like '%3'").persist()
    hot = hot_keys(ev, min_rows=4, share=0.0)
    assert all(hot.values())
    fn = getattr(h, read)
    assert rows(tidy(fn(ev, hot=NO_HOT))) == rows(tidy(fn(ev, hot=hot, width=90 * C.DAY)))


def test_hot_keys_are_found(spark):
    ev = views.txn_ties(spark, DATA)
    found = hot_keys(ev, min_rows=10, share=0.1)
    assert len(found["payee_vpa"]) == 7 and found["payer_vpa"] == []


def test_hot_median_descends_to_the_exact_value(spark):
    rng = random.Random(5)
    data = [("k", t, f"t{t}", float(rng.choice([5, 5, 5, 7]) if rng.random() < 0.4 else round(rng.random() * 100, 2)))
            for t in range(1, 400)]
    df = spark.createDataFrame(data, "k string, us long, txn_id string, x double")
    got = {r.txn_id: r.median for r in hot_median(df, "k", "x", 60, width=50, fan=4, short=8).collect()}
    for _, t, tid, _ in data:
        seen = [x for _, u, _, x in data if t - 60 <= u < t]
        assert got.get(tid) == (pytest.approx(float(np.median(seen))) if seen else None)


def test_ordered_bag():
    rng, bag, plain = random.Random(1), Ordered(), []
    for _ in range(6000):
        x = rng.randrange(500)
        if plain and rng.random() < 0.3:
            y = rng.choice(plain)
            plain.remove(y)
            bag.remove(y)
        plain.append(x)
        bag.add(x)
    assert bag.median() == np.median(plain) and bag.pick(0) == min(plain)


def test_probes_read_but_do_not_count(spark, events):
    ev = events(dict(at=0), dict(at=10, amount=300.0))
    probes = events(dict(at=5, txn_id="q1"), dict(at=5, txn_id="q2"), dict(at=11, txn_id="q3")).select("txn_id", "ts", "payer_vpa")
    out = {r.txn_id: (r.n, r["median"]) for r in h.payer_amount_stats(ev, probes, hot=NO_HOT).collect()}
    assert out == {"q1": (1, 100.0), "q2": (1, 100.0), "q3": (2, 200.0)}


def test_first_row_of_a_repeated_txn_wins(events):
    ev = events(dict(txn_id="a", at=5, amount=2.0), dict(txn_id="a", at=1, amount=1.0), dict(txn_id="b"))
    assert {(r.txn_id, r.amount) for r in ft.first_per_txn(ev).collect()} == {("a", 1.0), ("b", 100.0)}


def test_a_task_takes_a_bounded_share_of_a_large_table(spark, events, monkeypatch):
    ev = events(*[dict(at=i, payer_vpa=f"p{i % 9}@bank", payee_vpa=f"q{i % 7}@bank", amount=float(i)) for i in range(60)])
    whole = rows(ft.point_in_time(ev, hot=NO_HOT))
    monkeypatch.setattr("riskloom.session.ROWS_PER_TASK", 5)
    cut = ft.point_in_time(ev, hot=NO_HOT)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    for key in ("payer_vpa", "payee_vpa", "device_id"):
        assert re.search(rf"hashpartitioning\({key}#\d+, 12\), REPARTITION_BY_NUM", plan), key
    assert rows(cut) == whole
