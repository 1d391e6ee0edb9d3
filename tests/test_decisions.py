import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import messages, policy
from riskloom.functions.registry import ALL_FEATURES
from riskloom.operators import backtest as bt
from riskloom.operators import bootstrap
from riskloom.operators import drift as dr
from riskloom.operators import metrics as mx
from riskloom.operators import model as md
from riskloom.operators import monitor as mo
from riskloom.operators import thresholds as th
from riskloom.operators.ranking import percentiles, running_totals, smallest
from riskloom.plans.training import quality_gate

T = {"cold": {"t_warn": 0.2, "t_review": 0.5, "t_block": 0.9}, "warm": {"t_warn": 0.1, "t_review": 0.4, "t_block": 0.8}}


def scored(spark, n=500, seed=1, grid=None):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.2).astype(int)
    p = np.clip(rng.normal(0.3 + 0.3 * y, 0.2), 0, 1)
    if grid:
        p = np.round(p * grid) / grid
    a = np.round(rng.random(n) * 5000, 2)
    rows = [(f"t{i:05d}", float(p[i]), int(y[i]), float(a[i]), "warm" if i % 3 else "cold") for i in range(n)]
    return spark.createDataFrame(rows, "txn_id string, score double, label int, amount double, route string"), p, y, a


def average_precision(p, y):
    ap, prev = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = (y[hit] == 1).sum() / y.sum()
        ap += (recall - prev) * (y[hit] == 1).mean()
        prev = recall
    return ap


@pytest.mark.parametrize("grid", [None, 10])
def test_rank_metrics(spark, grid):
    df, p, y, a = scored(spark, grid=grid)
    r = mx.rank_metrics(df).first()
    assert r.pr_auc == pytest.approx(average_precision(p, y))
    pos, neg = p[y == 1], p[y == 0]
    assert r.roc_auc == pytest.approx(((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2))


def test_alert_metrics_break_ties_by_key(spark):
    df, p, y, a = scored(spark, grid=4)
    order = sorted(range(len(p)), key=lambda i: (-p[i], i))
    for r in mx.alert_metrics(df).collect():
        top = order[:max(1, round(len(p) * r.rate))]
        assert r.n_alerts == len(top) and r.precision == pytest.approx(y[top].mean())
        assert r.amount_weighted_recall == pytest.approx((a * y)[top].sum() / (a * y).sum())


def test_one_class_gives_no_auc(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("b", 0.2, 0)], "txn_id string, score double, label int")
    r = mx.rank_metrics(df).first()
    assert r.pr_auc is None and r.roc_auc is None


def test_bootstrap_interval_holds_the_estimate(spark):
    df, *_ = scored(spark, 300)
    a = mx.bootstrap_pr_auc(df, 100).first()
    assert a.ci_low < a.pr_auc < a.ci_high and mx.bootstrap_pr_auc(df, 100).first() == a
    b = mx.bootstrap_value_recall(df, 0.05, 100).first()
    assert b.ci_low <= b.amount_weighted_recall <= b.ci_high


def test_replicates_against_plain_sums(spark, monkeypatch):
    """Every replicate, from the same draws, by walking the score groups one after the other."""
    r = np.random.default_rng(3)
    rows = [(f"t{i}", float(r.integers(0, 40)) / 40, int(r.random() < 0.2), float(r.integers(1, 5))) for i in range(900)]
    rows += [("z", 0.5, 1, None), ("y", 0.5, None, 3.0)]
    df = spark.createDataFrame(rows, "txn_id string, score double, label int, amount double").repartition(3)
    monkeypatch.setattr(bootstrap, "ROWS", 7)
    for amount in (None, "amount"):
        got = {x.replicate: x for x in bootstrap.replicate_metrics(df, 20, 0.1, amount=amount).collect()}
        worth = F.when(F.col("label") == 1, F.coalesce("amount", F.lit(0.0))).otherwise(0.0) if amount else F.lit(0.0)
        groups = df.select(F.col("score").alias("s"), F.coalesce(F.col("label") == 1, F.lit(False)).cast("int").alias("pos"), worth.alias("amount")).groupBy(
            "s", "pos", "amount").agg(F.count("*").alias("n")).withColumn("key", F.xxhash64("s", "pos", "amount")).collect()
        drawn = bootstrap.draws(np.array([g.key for g in groups]), np.array([g.n for g in groups]), 20, 42)
        for k in range(20):
            per = {}
            for g, d in zip(groups, drawn[:, k]):
                n, p, v = per.get(g.s, (0, 0, 0))
                per[g.s] = (n + d, p + d * g.pos, v + d * g.pos * g.amount)
            all_n, all_p, all_v = (sum(x[c] for x in per.values()) for c in range(3))
            want, seen, hits, ap, value = max(1, round(all_n * 0.1)), 0, 0, 0, 0
            for s in sorted(per, reverse=True):
                n, p, v = per[s]
                value += v * min(1, max(0, (want - seen) / n)) if n else 0
                seen, hits = seen + n, hits + p
                ap += p * hits / seen if seen else 0
            assert got[k + 1].pr_auc == pytest.approx(ap / all_p)
            assert got[k + 1].amount_weighted_recall == (pytest.approx(value / all_v) if all_v else None)
    # draws have the mean and the spread of a sum of n single draws
    many = bootstrap.draws(np.arange(400), np.full(400, 9), 500, 1)
    assert abs(many.mean() - 9) < 0.1 and abs(many.var() - 9) < 0.3
    none = bootstrap.replicate_metrics(df.limit(0), 5).collect()
    assert len(none) == 5 and all(x.pr_auc is None for x in none)


def test_running_totals_match_one_window(spark):
    df, p, *_ = scored(spark, 400, grid=50)
    got = {r.score: r.n_before for r in running_totals(df, "score", {"n": F.lit(1)}, descending=True).collect()}
    assert got == {v: int((p > v).sum()) for v in set(p)}


def test_percentiles_and_smallest(spark):
    df, p, *_ = scored(spark, 333)
    r = percentiles(df, "score", {"a": 0.0, "b": 0.37, "c": 1.0}).first()
    assert (r.a, r.b, r.c) == pytest.approx(tuple(np.quantile(p, [0, 0.37, 1])))
    assert sorted(r[0] for r in smallest(df.select("txn_id"), "txn_id", 40, 333).collect()) == [f"t{i:05d}" for i in range(40)]


def brute_sweep(p, y, a, cap=0.02):
    c = np.arange(0, 1.005, 0.005)
    f = y == 1

    def cost(warn, review, block):
        allow = p < warn
        w, r, b = (p >= warn) & (p < review), (p >= review) & (p < block), p >= block
        return (a[allow & f].sum() - a[~allow & f].sum() + 40 * (w & ~f).sum() + 150 * (r & ~f).sum() + 500 * (b & ~f).sum())

    one = [cost(t, t, 9) for t in c]
    n = np.array([(p >= t).sum() for t in c])
    ok = n / len(p) <= cap
    review = c[min(np.flatnonzero(ok) if ok.any() else np.flatnonzero(n == n.min()), key=lambda i: (one[i], i))]
    above = c[c > review] if (c > review).any() else np.array([1.0])
    block = min(above, key=lambda t: (cost(review, review, t), t))
    below = c[c < review] if (c < review).any() else np.array([0.0])
    warn = min(below, key=lambda t: (cost(t, review, block), t))
    return warn, review, block, cost(warn, review, block)


@pytest.mark.parametrize("seed, grid", [(1, None), (2, 20), (3, 2)])
def test_threshold_search_equals_brute_force(spark, seed, grid):
    df, p, y, a = scored(spark, 600, seed, grid)
    routes = np.array(["warm" if i % 3 else "cold" for i in range(600)])
    for r in th.optimize(df).collect():
        m = routes == r.route
        want = brute_sweep(p[m], y[m], a[m])
        assert (r.t_warn, r.t_review, r.t_block, r.expected_cost) == pytest.approx(want)


def test_cold_is_never_laxer(spark):
    rows = [("cold", 0.1, 0.2, 0.9, 1.0), ("warm", 0.3, 0.4, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "route string, t_warn double, t_review double, t_block double, expected_cost double")
    out = th.as_thresholds(th.stricter_cold(df))
    assert all(out["cold"][t] >= out["warm"][t] for t in policy.TIERS) and out["cold"]["t_block"] == 1.0
    assert out["warm"] == {"t_warn": 0.3, "t_review": 0.4, "t_block": 0.5}


def test_chosen_thresholds_beat_the_naive_cutoff(spark):
    df, *_ = scored(spark, 600)
    chosen = th.optimize(df.withColumn("route", F.lit("warm"))).first()
    assert chosen.expected_cost <= th.naive_cost(df).first().cost


@pytest.mark.parametrize("score, cold, want", [(0.1, False, "WARN"), (0.0999, False, "ALLOW"), (0.4, False, "REVIEW"),
                                               (0.8, False, "BLOCK"), (0.4, True, "WARN"), (0.9, True, "BLOCK")])
def test_tier_lower_bounds_are_inclusive(spark, score, cold, want):
    tier = policy.risk_tier(F.lit(score), F.lit(cold), T)
    assert spark.range(1).select(policy.action_of(tier)).first()[0] == want


@pytest.mark.parametrize("action, fraud, want", [("ALLOW", True, 80), ("ALLOW", False, 0), ("WARN", True, -80),
                                                 ("WARN", False, 40), ("REVIEW", False, 150), ("BLOCK", False, 500)])
def test_cost(spark, action, fraud, want):
    assert spark.range(1).select(policy.cost(F.lit(action), F.lit(fraud), F.lit(80.0))).first()[0] == want


def test_backtest_with_the_same_actions_changes_nothing(spark):
    df, *_ = scored(spark)
    rows = df.withColumn("label_is_fraud", F.when(F.col("score") > 0.05, F.col("label") == 1)).withColumn(
        "action", policy.action(F.col("score"), F.col("route") == "cold", T)).withColumn("new_action", F.col("action"))
    r = bt.backtest(rows).first()
    assert r.net_benefit_delta == 0 and r.a_n_excluded_unknown_label == df.where("score <= 0.05").count()


def test_sibling_versions():
    assert bt.sibling_versions("warm-2026-abc") == ("cold-2026-abc", "warm-2026-abc")
    assert bt.sibling_versions("v1") == ("v1", "v1")


def psi(spark, a, b):
    frame = lambda v: spark.createDataFrame([(None if x is None else float(x),) for x in v], "x double")
    return dr.psi_numeric(frame(a), frame(b), ["x"]).first().psi


def test_psi_bounds(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(0, 1, 5000)
    assert psi(spark, a, rng.normal(0, 1, 5000)) < 0.1 and psi(spark, a, rng.normal(3, 0.3, 5000)) > 0.25
    assert psi(spark, a, list(rng.normal(0, 1, 4000)) + [None] * 1000) > 0.1
    assert psi(spark, [None, None], [1.0]) == 0.0 and psi(spark, [2.0] * 50, [2.0] * 30) == pytest.approx(0.0)


def test_psi_of_categories(spark):
    frame = lambda n, m: spark.createDataFrame([("a",)] * n + [("b",)] * m, "c string")
    assert dr.psi_categorical(frame(300, 700), frame(290, 710), "c").first().psi < 0.1
    assert dr.psi_categorical(frame(900, 100), frame(100, 900), "c").first().psi > 0.25


def test_ks(spark):
    rng = np.random.default_rng(0)
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "score double")
    same = dr.score_drift(frame(rng.normal(0, 1, 800)), frame(rng.normal(0, 1, 900))).first()
    moved = dr.score_drift(frame(rng.normal(0, 1, 800)), frame(rng.normal(0.5, 1, 900))).first()
    assert not same.significant_drift and moved.significant_drift and moved.ks_statistic > same.ks_statistic


def test_empty_queue_and_labels(spark):
    d = spark.createDataFrame([], "id long, scored_at timestamp, action string, risk_score double")
    lab = spark.createDataFrame([], "decision_id long, disposition string")
    assert mo.queue_depth(d, lab).first().queue_depth == 0
    assert mo.queue_upper_median_age(d, lab).first().median_age_seconds == 0.0
    assert mo.reviewed_precision(lab).first().precision_on_reviewed_pct is None
    with pytest.raises(ValueError):
        dr.recent(d, 30, "2024-01-01")


def test_score_of_one_is_bucket_21(spark):
    d = spark.createDataFrame([(1.0,), (0.0,), (0.05,)], "risk_score double")
    assert [(r.bucket, r.n) for r in mo.score_histogram(d).collect()] == [(1, 1), (2, 1), (21, 1)]


def test_every_feature_has_words(spark):
    one = spark.range(1)
    for name in ALL_FEATURES:
        text = one.select(messages.message_for(name, F.lit(0.4), F.lit("hundred"))).first()[0]
        assert text and name not in text


@pytest.mark.parametrize("name, v, want", [
    ("amount_ratio_to_payer_median", 2.5, "Amount is 2x this payer's typical payment"),
    ("payee_p2m_ratio", 0.375, "38% of this payee's transactions are merchant-style payments"),
    ("hour_of_day", 3.0, "Transaction occurred at 03:00 -- a late-night hour with little legitimate activity for most payers"),
    ("payer_payee_txn_count", 0.0, "First payment ever between this payer and payee"),
    ("days_since_payer_last_paid_payee", None, "First-ever payment from this payer to this payee"),
    ("payee_amount_std", None, "Payee amount std could not be reliably computed (insufficient history)"),
    ("seconds_since_payer_last_txn", 120.0, "2 minutes since this payer's last payment")])
def test_message_texts(spark, name, v, want):
    assert spark.range(1).select(messages.message_for(name, F.lit(v).cast("double"), F.lit(None))).first()[0] == want


def test_one_decimal_is_rounded_on_the_exact_value(spark):
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.75, 1.05, 2.675, 3.95, 0.3 - 5e-17, 12345.65, 1e12 + 0.25] + [k / 20 for k in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(F.format_string("%.1f", messages.tenths(F.col("v")))).collect()]
    assert got == [f"{v:.1f}" for v in values]


def test_reasons_are_ranked_and_a_lone_weak_one_is_dropped(spark):
    rows = [("a", f, 1.0, None, c) for f, c in [("is_night", 0.3), ("amount_log", 0.9), ("hour_of_day", -2.0), ("is_p2p", 0.1)]]
    rows += [("b", "is_p2p", 1.0, None, 0.5)]
    df = spark.createDataFrame(rows, "txn_id string, feature string, v double, category string, contribution double")
    out = {r.txn_id: [c.code for c in r.reason_codes] for r in md.top_reasons(df, 2).collect()}
    assert out == {"a": ["amount_log", "is_night"], "b": []}


def test_quality_gate(spark):
    table = lambda v: spark.createDataFrame([("warm", "pr_auc", "", v)], "model string, metric string, at string, value double")
    assert quality_gate(table(0.8)) == 0.8
    with pytest.raises(ValueError):
        quality_gate(table(0.7))


def test_rules_score(spark):
    df = spark.createDataFrame([(True, 4.0, True, True, 0), (False, None, False, False, 3)],
                               "payee_is_unseen boolean, amount_zscore_vs_payer_30d double, is_collect_request boolean, "
                               "is_night boolean, payer_payee_txn_count long")
    assert [r.score for r in md.rules_score(df).collect()] == [7, 0]


def test_a_leaking_feature_is_found(spark):
    rows = [(float(i), float(i % 7), "x" if i % 2 else "y", int(i > 60)) for i in range(100)]
    df = spark.createDataFrame(rows, "leak double, noise double, kind string, label int")
    got = {r.feature: (r.auc, r.leaks) for r in mx.feature_auc(df, ["leak", "noise"], ["kind"]).collect()}
    assert got["leak"] == (1.0, True) and not got["noise"][1] and not got["kind"][1]
