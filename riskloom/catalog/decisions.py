"""Registered queries over the decision table: monitoring, evaluation, cost
policy, backtests and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy
from ..functions.registry import ALL_FEATURES, CATEGORICAL
from ..operators import backtest as bt
from ..operators import drift as dr
from ..operators import features as feats
from ..operators import history as h
from ..operators import metrics as mx
from ..operators import monitor as mo
from ..operators import thresholds as th
from ..plans import reports
from ..session import materialize
from ..sources import testviews as views
from .history import features_sql
from .shared import DECISIONS, LABELS, TXN, big, r, tidy

THRESHOLDS = {"cold": {"t_warn": 0.6, "t_review": 0.85, "t_block": 0.98},
              "warm": {"t_warn": 0.5, "t_review": 0.8, "t_block": 0.96}}
SCORED_SQL = """SELECT txn_id, {score} AS score, CAST(label_is_fraud AS INT) AS label, amount, is_cold,
  CASE WHEN is_cold THEN 'cold' ELSE 'warm' END AS route,
  CASE WHEN label_is_fraud THEN CASE id % 5 WHEN 0 THEN 'MULE_FANIN' WHEN 1 THEN 'SCAM_COLLECT'
       WHEN 2 THEN 'ATO_BURST' ELSE 'QR_SWAP' END ELSE 'legit' END AS typology
FROM {decisions} d WHERE label_is_fraud IS NOT NULL"""
COARSE = "CAST(id % 37 AS DOUBLE) / 37"          # heavy ties
SCORED = f"scored AS ({SCORED_SQL.format(score='risk_score', decisions='decisions')})"
SCORED_TIES = f"scored AS ({SCORED_SQL.format(score=COARSE, decisions='decisions')})"
D, L = f"WITH {DECISIONS}", f"WITH {DECISIONS}, {LABELS}"
S, ST = f"{D}, {SCORED}", f"{D}, {SCORED_TIES}"


def scored(spark, d, score="risk_score"):
    return spark.sql(SCORED_SQL.replace("{score}", score), decisions=views.decisions(spark, d))


def ties(spark, d):
    return scored(spark, d, COARSE)


QUERIES, SQL = {}, {}


def add(name, fn, sql=None, digits=6):
    QUERIES[name] = lambda spark, d: tidy(fn(spark, d), digits)
    if sql:
        SQL[name] = sql


# --- monitoring -----------------------------------------------------------------
def half_up(e, digits):
    return r(e, digits)


add("action_mix", lambda sp, d: mo.action_mix(views.decisions(sp, d)),
    f"{D} SELECT action, count(*) AS n, {half_up('100.0 * count(*) / sum(count(*)) OVER ()', 2)} AS pct "
    "FROM decisions GROUP BY action")
add("alert_rate_over_time", lambda sp, d: mo.alert_rate(views.decisions(sp, d)),
    f"{D} SELECT date_trunc('day', scored_at) AS day, count(*) AS total, count(*) FILTER (WHERE action != 'ALLOW') AS alerts, "
    + half_up("100.0 * count(*) FILTER (WHERE action != 'ALLOW') / count(*)", 2) + " AS alert_rate_pct FROM decisions GROUP BY 1")
add("latency_percentiles", lambda sp, d: mo.latency(views.decisions(sp, d)),
    f"{D} SELECT source, count(*) AS n, " + ", ".join(
        f"{half_up(f'quantile_cont(latency_ms, {q})', 2)} AS {n}" for n, q in
        [("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)]) + " FROM decisions GROUP BY source")
add("precision_on_reviewed_cases", lambda sp, d: mo.reviewed_precision(views.review_labels(sp, d)),
    f"{L} SELECT count(*) AS n_reviewed, count(*) FILTER (WHERE disposition = 'CONFIRMED_FRAUD') AS n_confirmed_fraud, "
    + half_up("100.0 * count(*) FILTER (WHERE disposition = 'CONFIRMED_FRAUD') / nullif(count(*), 0)", 2)
    + " AS precision_on_reviewed_pct FROM review_labels")
add("reviewed_precision_share", lambda sp, d: mo.reviewed_share(views.review_labels(sp, d)),
    f"{L} SELECT count(*) AS total_labels, {r('avg(CASE WHEN disposition = $$CONFIRMED_FRAUD$$ THEN 1.0 ELSE 0.0 END)')} "
    "AS reviewed_precision FROM review_labels")
PENDING = ("pending AS (SELECT d.*, (epoch_us(m.now) - epoch_us(scored_at)) / 1000000.0 AS age FROM decisions d, "
           "(SELECT max(scored_at) AS now FROM decisions) m WHERE action IN ('REVIEW', 'BLOCK') "
           "AND NOT EXISTS (SELECT 1 FROM review_labels rl WHERE rl.decision_id = d.id))")
add("review_queue_depth_and_age",
    lambda sp, d: mo.queue_depth(views.decisions(sp, d), views.review_labels(sp, d)),
    f"{L}, {PENDING} SELECT count(*) AS queue_depth, {half_up('quantile_cont(age, 0.5)', 0)} AS median_age_seconds FROM pending")
add("review_queue_page", lambda sp, d: mo.queue_page(views.decisions(sp, d), views.review_labels(sp, d), page=2).select(
    "id", "scored_at", "action", "risk_score"),
    f"{L}, {PENDING} SELECT id, scored_at, action, {r('risk_score')} AS risk_score FROM pending "
    "ORDER BY scored_at DESC, id DESC LIMIT 25 OFFSET 25")
add("review_queue_upper_median_age",
    lambda sp, d: mo.queue_upper_median_age(views.decisions(sp, d), views.review_labels(sp, d)),
    f"{L}, {PENDING}, o AS (SELECT age, row_number() OVER (ORDER BY age) - 1 AS k, count(*) OVER () AS n FROM pending) "
    f"SELECT {r('max(age)')} AS median_age_seconds, any_value(n) AS queue_depth FROM o WHERE k = n // 2")
add("score_histogram", lambda sp, d: mo.score_histogram(views.decisions(sp, d)),
    f"{D}, b AS (SELECT CASE WHEN risk_score >= 1 THEN 21 ELSE CAST(floor(risk_score * 20) AS BIGINT) + 1 END AS bucket "
    f"FROM decisions) SELECT bucket, {half_up('(bucket - 1) * 0.05', 2)} AS bucket_start, count(*) AS n FROM b GROUP BY bucket")


def _new_labels(sp, d):
    lab = views.review_labels(sp, d)
    return lab.select(F.when(F.col("decision_id") % 2 == 0, F.col("decision_id")).otherwise(-F.col("decision_id"))
                      .alias("decision_id"),
                      F.when(F.col("decision_id") % 5 == 4, "MAYBE").otherwise(F.col("disposition")).alias("disposition"))


def _label_outcomes(sp, d):
    good, bad = mo.review_split(_new_labels(sp, d), views.decisions(sp, d))
    return good.withColumn("reason", F.lit("accepted")).unionByName(bad).groupBy("reason", "disposition").agg(
        F.count("*").alias("n"))


add("review_label_validation", _label_outcomes,
    f"{L}, n AS (SELECT CASE WHEN decision_id % 2 = 0 THEN decision_id ELSE -decision_id END AS decision_id, "
    "CASE WHEN decision_id % 5 = 4 THEN 'MAYBE' ELSE disposition END AS disposition FROM review_labels) "
    "SELECT CASE WHEN disposition NOT IN ('CONFIRMED_FRAUD', 'LEGIT', 'UNCLEAR') THEN 'invalid disposition' "
    "WHEN decision_id NOT IN (SELECT id FROM decisions) THEN 'unknown decision' ELSE 'accepted' END AS reason, "
    "disposition, count(*) AS n FROM n GROUP BY 1, 2")
add("decision_lookup", lambda sp, d: views.decisions(sp, d).join(
    views.review_labels(sp, d).select(F.concat(F.lit("txn-"), F.col("decision_id")).alias("txn_id")), "txn_id", "left_semi")
    .groupBy("txn_id").agg(F.count("*").alias("n"), F.max("action").alias("action")),
    f"{L} SELECT txn_id, count(*) AS n, max(action) AS action FROM decisions WHERE txn_id IN "
    "(SELECT concat('txn-', decision_id) FROM review_labels) GROUP BY txn_id")

# --- evaluation -----------------------------------------------------------------
GROUPED = ("g AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY 1), "
           "c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER (ORDER BY score DESC) AS cp, "
           "row_number() OVER (ORDER BY score DESC) AS i, lead(n - pos) OVER (ORDER BY score DESC) AS neg2, "
           "lead(pos) OVER (ORDER BY score DESC) AS pos2, sum(n) OVER () AS nn, sum(pos) OVER () AS pp FROM g)")
RANK = (f"SELECT {big('sum(n)')} AS n_events, {big('sum(pos)')} AS n_positives, "
        f"{r('sum(CAST(pos AS DOUBLE) * cp / cn) / sum(pos)')} AS pr_auc, "
        + r("sum((n - pos) * (cp - pos + pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(n - pos))") + " AS roc_auc FROM c")
FPR = ("SELECT " + r("coalesce(max(cp / pp) FILTER (WHERE (cn - cp) / (nn - pp) <= 0.01 AND "
                     "(i = 1 OR neg2 IS NULL OR pos <> pos2 OR n - pos <> neg2)), 0.0)") + " AS recall FROM c")
RATES = "rates AS (SELECT unnest([0.01, 0.02, 0.05])::DOUBLE AS rate)"
CAUGHT = (f"{RATES}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, txn_id) AS k, count(*) OVER () AS nn FROM scored), "
          "f AS (SELECT *, k <= greatest(1, CAST(round_even(nn * rate, 0) AS BIGINT)) AS hit FROM o, rates)")
ALERTS = ("SELECT rate, count(*) FILTER (WHERE hit) AS n_alerts, "
          + r("avg(label) FILTER (WHERE hit)") + " AS precision, "
          + r("sum(amount) FILTER (WHERE hit AND label = 1) / sum(amount) FILTER (WHERE label = 1)")
          + " AS amount_weighted_recall FROM f GROUP BY rate")
TYPO = ("SELECT rate, typology, count(*) AS n, " + r("avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)")
        + " AS recall FROM f WHERE label = 1 GROUP BY rate, typology")
BINNED = ("b AS (SELECT " + " + ".join(f"(score > {i / 10})::INT" for i in range(1, 10)) + " AS bin, count(*) AS n, "
          "avg(score) AS predicted, avg(label) AS observed FROM scored GROUP BY 1)")
for suffix, source, pre in (("", scored, S), ("_ties", ties, ST)):
    add("pr_auc_and_roc_auc" + suffix, lambda sp, d, f=source: mx.rank_metrics(f(sp, d)), f"{pre}, {GROUPED} {RANK}")
    add("recall_at_fpr" + suffix, lambda sp, d, f=source: mx.recall_at_fpr(f(sp, d)), f"{pre}, {GROUPED} {FPR}")
    add("precision_at_alert_rate" + suffix, lambda sp, d, f=source: mx.alert_metrics(f(sp, d)), f"{pre}, {CAUGHT} {ALERTS}")
    add("per_typology_recall" + suffix, lambda sp, d, f=source: mx.typology_recall(f(sp, d)), f"{pre}, {CAUGHT} {TYPO}")
add("brier_score", lambda sp, d: mx.brier(scored(sp, d)), f"{S} SELECT {r('avg(power(score - label, 2))')} AS brier FROM scored")
add("expected_calibration_error", lambda sp, d: mx.calibration_error(scored(sp, d)),
    f"{S}, {BINNED} SELECT {r('sum(n * abs(observed - predicted)) / sum(n)')} AS ece FROM b")
add("reliability_curve", lambda sp, d: mx.reliability(scored(sp, d)),
    f"{S}, {BINNED} SELECT {big('bin')} AS bin, n, {r('predicted')} AS predicted, {r('observed')} AS observed FROM b")
add("bootstrap_pr_auc", lambda sp, d: mx.bootstrap_pr_auc(scored(sp, d)))
add("bootstrap_amount_weighted_recall", lambda sp, d: mx.bootstrap_value_recall(scored(sp, d)))
_yn = "CASE WHEN score >= 0.8 THEN 'Y' ELSE 'N' END AS predicted, CASE WHEN label = 1 THEN 'Y' ELSE 'N' END AS truth"
add("confusion_matrix", lambda sp, d: mx.confusion(scored(sp, d).select(
    F.when(F.col("score") >= 0.8, "Y").otherwise("N").alias("predicted"),
    F.when(F.col("label") == 1, "Y").otherwise("N").alias("label"))),
    f"{S}, p AS (SELECT {_yn} FROM scored), c AS (SELECT count(*) FILTER (WHERE predicted = 'Y' AND truth = 'Y') AS tp, "
    "count(*) FILTER (WHERE predicted = 'Y' AND truth = 'N') AS fp, count(*) FILTER (WHERE predicted = 'N' AND truth = 'Y') AS fn, "
    "count(*) FILTER (WHERE predicted = 'N' AND truth = 'N') AS tn FROM p) "
    "SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, "
    f"{r('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {r('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, "
    f"{r('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1_score FROM c")


def _combined(sp, d):
    s = scored(sp, d)
    both = s.where("is_cold").unionByName(s.where("NOT is_cold"))
    return mx.score_only(both)


add("combined_cold_warm_metrics", _combined,
    f"{S}, u AS (SELECT * FROM scored WHERE is_cold UNION ALL SELECT * FROM scored WHERE NOT is_cold), {GROUPED}, {CAUGHT} "
    f"SELECT a.*, m.* FROM ({ALERTS}) a, ({RANK}) m")
add("event_summary", lambda sp, d: mx.event_summary(views.txn(sp, d)),
    f"WITH {TXN} SELECT count(*) AS event_count, {r('avg(label_is_fraud::INT)')} AS fraud_rate, "
    "count(*) FILTER (WHERE label_is_fraud) AS fraud_event_count, count(DISTINCT payer_vpa) AS unique_payers, "
    "count(DISTINCT payee_vpa) AS unique_payees, min(ts) AS first_ts, max(ts) AS last_ts FROM txn")
add("typology_counts", lambda sp, d: mx.typology_counts(views.txn(sp, d)),
    f"WITH {TXN} SELECT coalesce(label_typology, 'legit') AS typology, count(*) AS n FROM txn GROUP BY 1")

add("max_rolling_fanin_by_class", lambda sp, d: mx.rolling_payers_by_class(views.txn(sp, d), h.max_rolling_payers(views.txn(sp, d))),
    f"WITH {TXN}, m AS (SELECT payee_vpa, max(d) AS most FROM (SELECT payee_vpa, count(DISTINCT payer_vpa) OVER (PARTITION BY payee_vpa "
    "ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS d FROM txn) q GROUP BY 1), "
    "c AS (SELECT DISTINCT payee_vpa, label_typology AS class FROM txn WHERE label_typology IN ('MULE_FANIN', 'legit')) "
    f"SELECT class, count(*) AS n, {r('quantile_cont(most, 0.5)')} AS median, {r('quantile_cont(most, 0.95)')} AS p95 "
    "FROM c JOIN m USING (payee_vpa) GROUP BY class")
add("new_payees_by_window", lambda sp, d: mx.new_payees_by_window(views.txn(sp, d), 30, 4),
    f"WITH {TXN}, f AS (SELECT payee_vpa, min(us) AS us FROM txn WHERE label_typology = 'legit' GROUP BY 1), "
    "dd AS (SELECT CAST(floor((us - (SELECT min(us) FROM txn)) / 86400000000.0) AS BIGINT) AS day FROM f), "
    "n AS (SELECT (day - 1) // 4 AS w, count(*) AS c FROM dd WHERE day >= 1 AND day < 30 GROUP BY 1) "
    "SELECT i AS \"window\", i * 4 + 1 AS first_day, least(i * 4 + 4, 29) AS last_day, coalesce(c, 0) AS new_payees "
    "FROM range(0, 8) x(i) LEFT JOIN n ON n.w = x.i")

# --- cost policy ----------------------------------------------------------------
COST = ("CASE WHEN {fraud} THEN CASE WHEN {a} = 'ALLOW' THEN amount ELSE -amount END "
        "WHEN {a} = 'WARN' THEN 40.0 WHEN {a} = 'REVIEW' THEN 150.0 WHEN {a} = 'BLOCK' THEN 500.0 ELSE 0.0 END")


def tiers(score="score", names=("ALLOW", "WARN", "REVIEW", "BLOCK"), t=THRESHOLDS):
    def steps(k):
        b = t[k]
        return (f"CASE WHEN {score} < {b['t_warn']} THEN '{names[0]}' WHEN {score} < {b['t_review']} THEN '{names[1]}' "
                f"WHEN {score} < {b['t_block']} THEN '{names[2]}' ELSE '{names[3]}' END")
    return f"CASE WHEN is_cold THEN {steps('cold')} ELSE {steps('warm')} END"


def _acted(sp, d):
    s = scored(sp, d)
    return s.withColumn("action", policy.action(F.col("score"), F.col("is_cold"), THRESHOLDS))


def _tiers(sp, d):
    s = scored(sp, d)
    return s.withColumn("risk_tier", policy.risk_tier(F.col("score"), F.col("is_cold"), THRESHOLDS)).withColumn(
        "action", policy.action_of(F.col("risk_tier"))).select("txn_id", "risk_tier", "action")


ACTED = f"acted AS (SELECT *, {tiers()} AS action FROM scored)"
add("decision_tiers", _tiers,
    f"{S} SELECT txn_id, {tiers(names=('LOW', 'MEDIUM', 'HIGH', 'CRITICAL'))} AS risk_tier, {tiers()} AS action FROM scored")
add("action_cost", lambda sp, d: _acted(sp, d).select("txn_id", "action", policy.cost(
    F.col("action"), F.col("label") == 1, F.col("amount")).alias("cost")),
    f"{S}, {ACTED} SELECT txn_id, action, {r(COST.format(a='action', fraud='label = 1'))} AS cost FROM acted")
GRID = "grid AS (SELECT i, i * CAST(0.005 AS DOUBLE) AS t FROM range(0, 201) x(i))"
SWEEP = f"""{GRID}, s AS (SELECT route, score, label = 1 AS fraud, CAST(amount AS DECIMAL(18,2)) AS amount FROM scored),
r1 AS (SELECT route, i, t, sum(CASE WHEN score >= t THEN CASE WHEN fraud THEN -amount ELSE 150 END
         ELSE CASE WHEN fraud THEN amount ELSE 0 END END) AS cost,
         count(*) FILTER (WHERE score >= t) AS above, count(*) AS n FROM s, grid GROUP BY 1, 2, 3),
review AS (SELECT DISTINCT ON (route) route, t AS t_review, cost AS review_cost FROM r1
  ORDER BY route, CASE WHEN above / n <= 0.02 THEN 0 ELSE above END, cost, i),
r2 AS (SELECT s.route, i, t, t_review, sum(CASE WHEN score < t_review THEN CASE WHEN fraud THEN amount ELSE 0 END
         WHEN fraud THEN -amount WHEN score >= t THEN 500 ELSE 150 END) AS cost
  FROM s JOIN review USING (route), grid WHERE t > t_review OR (t_review = 1.0 AND i = 200) GROUP BY 1, 2, 3, 4),
block AS (SELECT DISTINCT ON (route) route, t AS t_block, cost AS block_cost FROM r2 ORDER BY route, cost, i),
r3 AS (SELECT s.route, i, t, sum(CASE WHEN score < t THEN CASE WHEN fraud THEN amount ELSE 0 END
         WHEN fraud THEN -amount WHEN score < t_review THEN 40 WHEN score < t_block THEN 150 ELSE 500 END) AS cost
  FROM s JOIN review USING (route) JOIN block USING (route), grid WHERE t < t_review OR (t_review = 0 AND i = 0) GROUP BY 1, 2, 3),
warn AS (SELECT DISTINCT ON (route) route, t AS t_warn, cost AS expected_cost FROM r3 ORDER BY route, cost, i),
chosen AS (SELECT route, t_warn, t_review, t_block, CAST(expected_cost AS DOUBLE) AS expected_cost
  FROM warn JOIN review USING (route) JOIN block USING (route))"""
_T = ", ".join(f"{r(t)} AS {t}" for t in policy.TIERS)


def _sums(sp, d):
    return th._with_sums(th.binned(scored(sp, d)), "route")


add("sweep_review_threshold", lambda sp, d: th.sweep_review(_sums(sp, d)).select("route", "t_review", "t_review_cost"),
    f"{S}, {SWEEP} SELECT route, {r('t_review')} AS t_review, {r('review_cost', 3)} AS t_review_cost FROM review", 3)
add("sweep_block_threshold", lambda sp, d: th.sweep_block(_sums(sp, d), th.sweep_review(_sums(sp, d))).select(
    "route", "t_review", "t_block", "t_block_cost"),
    f"{S}, {SWEEP} SELECT route, {r('t_review')} AS t_review, {r('t_block')} AS t_block, {r('block_cost', 3)} AS t_block_cost "
    "FROM review JOIN block USING (route)", 3)
add("optimal_thresholds", lambda sp, d: th.optimize(scored(sp, d)),
    f"{S}, {SWEEP} SELECT route, {_T}, {r('expected_cost', 3)} AS expected_cost FROM chosen", 3)
STRICT = """, both_ AS (SELECT c.*, w.t_warn AS ww, w.t_review AS wr, w.t_block AS wb,
  c.route = 'cold' AND (c.t_warn < w.t_warn OR c.t_review < w.t_review OR c.t_block < w.t_block) AS low
  FROM chosen c, (SELECT * FROM chosen WHERE route = 'warm') w),
strict AS (SELECT *, list_sort([least(1.0, greatest(t_warn * 1.15, ww)), least(1.0, greatest(t_review * 1.15, wr)),
  least(1.0, greatest(t_block * 1.15, wb))]) AS l FROM both_)"""
add("cold_strictness", lambda sp, d: th.stricter_cold(th.optimize(scored(sp, d))),
    f"{S}, {SWEEP}{STRICT} SELECT route, " + ", ".join(
        f"{r(f'CASE WHEN low THEN l[{i + 1}] ELSE {t} END')} AS {t}" for i, t in enumerate(policy.TIERS))
    + f", {r('expected_cost', 3)} AS expected_cost, low AS multiplier_applied FROM strict", 3)
add("naive_cutoff_cost", lambda sp, d: th.naive_cost(scored(sp, d)),
    f"{S}, a AS (SELECT *, CASE WHEN score >= 0.5 THEN 'BLOCK' ELSE 'ALLOW' END AS act FROM scored) "
    f"SELECT {r('sum(' + COST.format(a='act', fraud='label = 1') + ')', 3)} AS cost FROM a", 3)


def point_sql(act="action"):
    cost = COST.format(a=act, fraud="label = 1")
    fraud = "label = 1"
    return ", ".join([
        f"{r(f'count(*) FILTER (WHERE {act} <> $$ALLOW$$) / count(*)', 3)} AS alert_rate",
        f"{r(f'count(*) FILTER (WHERE {act} IN ($$REVIEW$$, $$BLOCK$$)) / count(*)', 3)} AS review_block_rate",
        r(f"coalesce(count(*) FILTER (WHERE {act} <> $$ALLOW$$ AND {fraud}) / nullif(count(*) FILTER (WHERE {act} <> $$ALLOW$$), 0), 0)", 3) + " AS precision",
        r(f"coalesce(count(*) FILTER (WHERE {act} <> $$ALLOW$$ AND {fraud}) / nullif(count(*) FILTER (WHERE {fraud}), 0), 0)", 3) + " AS recall",
        r(f"coalesce(sum(amount) FILTER (WHERE {act} <> $$ALLOW$$ AND {fraud}) / nullif(sum(amount) FILTER (WHERE {fraud}), 0), 0)", 3) + " AS amount_weighted_recall",
        f"{r(f'sum({cost})', 3)} AS expected_cost",
        r(f"coalesce(sum(amount) FILTER (WHERE {act} <> $$ALLOW$$ AND {fraud}), 0)", 3) + " AS prevented_loss",
        r(f"coalesce(sum({cost}) FILTER (WHERE label = 0), 0)", 3) + " AS friction_cost"])


add("operating_point", lambda sp, d: th.operating_point(_acted(sp, d), groups=("route",)),
    f"{S}, {ACTED} SELECT route, {point_sql()} FROM acted GROUP BY route", 3)


def _curve(sp, d):
    s = scored(sp, d)
    return th.threshold_curve(s, th.optimize(s))


add("threshold_curve", _curve,
    f"{S}, {SWEEP}, v AS (SELECT route, i, t AS t_review FROM r1 WHERE above / n <= 0.02 AND i % 4 = 0), "
    "a AS (SELECT s.route, v.t_review, s.amount, s.label, CASE WHEN score < least(c.t_warn, v.t_review) THEN 'ALLOW' "
    "WHEN score < v.t_review THEN 'WARN' WHEN score < greatest(c.t_block, v.t_review) THEN 'REVIEW' ELSE 'BLOCK' END AS act "
    "FROM scored s JOIN v USING (route) JOIN chosen c USING (route)) "
    f"SELECT route, {r('t_review', 3)} AS t_review, {point_sql('act')} FROM a GROUP BY a.route, a.t_review", 3)
add("policy_report", lambda sp, d: th.policy_report(scored(sp, d), THRESHOLDS),
    f"{S}, {ACTED}, p AS (SELECT {point_sql()} FROM acted), "
    "a AS (SELECT *, CASE WHEN score >= 0.5 THEN 'BLOCK' ELSE 'ALLOW' END AS act FROM scored), "
    f"n AS (SELECT {r('sum(' + COST.format(a='act', fraud='label = 1') + ')', 3)} AS naive_cost FROM a) "
    "SELECT expected_cost AS chosen_cost, alert_rate, precision, amount_weighted_recall, naive_cost FROM p, n", 3)

# --- backtest --------------------------------------------------------------------
FROM, TO = "1996-01-01", "1999-06-15"


def _window(sp, d):
    return bt.window(views.decisions(sp, d), FROM, TO, "warm-v1")


WINDOW = (f"win AS (SELECT * FROM decisions WHERE scored_at >= TIMESTAMP '{FROM}' AND scored_at < TIMESTAMP '{TO}' "
          "AND model_version IN ('cold-v1', 'warm-v1'))")


def summary_sql(act: str, prefix: str = "", digits=3) -> str:
    alert, f, known = f"{act} <> 'ALLOW'", "label_is_fraud", "label_is_fraud IS NOT NULL"
    cost = COST.format(a=act, fraud=f)
    parts = {
        "n_rows": "count(*)", "n_excluded_unknown_label": f"count(*) FILTER (WHERE NOT ({known}))",
        **{f"n_{a.lower()}": f"count(*) FILTER (WHERE {act} = '{a}')" for a in ("ALLOW", "WARN", "REVIEW", "BLOCK")},
        "n_fraud_known": f"count(*) FILTER (WHERE {f})", "n_caught": f"count(*) FILTER (WHERE {f} AND {alert})",
        "n_false_positives": f"count(*) FILTER (WHERE NOT {f} AND {alert})",
        "fraud_value_total": r(f"coalesce(sum(amount) FILTER (WHERE {f}), 0)", digits),
        "fraud_value_caught": r(f"coalesce(sum(amount) FILTER (WHERE {f} AND {alert}), 0)", digits),
        "expected_cost": r(f"coalesce(sum({cost}) FILTER (WHERE {known}), 0)", digits),
        "amount_weighted_recall": r(f"sum(amount) FILTER (WHERE {f} AND {alert}) / nullif(sum(amount) FILTER (WHERE {f}), 0)", digits),
        "precision": r(f"count(*) FILTER (WHERE {f} AND {alert}) / nullif(count(*) FILTER (WHERE {known} AND {alert}), 0)", digits),
    }
    return ", ".join(f"{v} AS {prefix}{k}" for k, v in parts.items())


add("backtest_summary", lambda sp, d: bt.summarize(_window(sp, d)), f"{D}, {WINDOW} SELECT {summary_sql('action')} FROM win", 3)
RESCORED = f"res AS (SELECT *, {tiers('least(1.0, raw_score * 1.05)')} AS new_action FROM win)"


def _backtest(sp, d):
    w = _window(sp, d)
    new = F.least(F.lit(1.0), F.col("raw_score") * 1.05)
    return bt.backtest(w.withColumn("new_action", policy.action(new, F.col("is_cold"), THRESHOLDS)))


add("backtest", _backtest,
    f"{D}, {WINDOW}, {RESCORED} SELECT *, {r('a_expected_cost - b_expected_cost', 3)} AS net_benefit_delta FROM "
    f"(SELECT {summary_sql('action', 'a_')} FROM res) a, (SELECT {summary_sql('new_action', 'b_')} FROM res) b", 3)
_w = THRESHOLDS["warm"]
NET = (f"{D}, c AS (SELECT 0.01::DOUBLE + 0.02::DOUBLE * i AS t FROM range(0, 50) x(i)), "
       "a AS (SELECT t, amount, label_is_fraud, CASE WHEN is_cold THEN " + tiers("risk_score") +
       f" WHEN risk_score < least({_w['t_warn']}::DOUBLE, t) THEN 'ALLOW' WHEN risk_score < t THEN 'WARN' "
       f"WHEN risk_score < greatest({_w['t_block']}::DOUBLE, t) THEN 'REVIEW' ELSE 'BLOCK' END AS act "
       "FROM decisions, c WHERE label_is_fraud IS NOT NULL) "
       f"SELECT {r('t', 3)} AS t_review, {r('sum(' + COST.format(a='act', fraud='label_is_fraud') + ')', 2)} AS expected_cost, "
       f"{r('-sum(' + COST.format(a='act', fraud='label_is_fraud') + ')', 2)} AS net_benefit FROM a GROUP BY a.t")
add("threshold_vs_net_benefit", lambda sp, d: bt.net_benefit_curve(views.decisions(sp, d), THRESHOLDS).select(
    F.bround("t_review", 3).alias("t_review"), "expected_cost", "net_benefit"), NET, 2)

# --- drift ------------------------------------------------------------------------
SPLIT = "1998-01-01"
DRIFT_SQL = """SELECT scored_at, amount * CASE WHEN scored_at >= TIMESTAMP '1998-01-01' THEN 1.5 ELSE 1.0 END AS amount,
  risk_score, latency_ms, CASE WHEN id % 7 = 0 THEN NULL ELSE raw_score END AS gappy, CAST(id % 4 AS DOUBLE) AS few,
  CAST(1.0 AS DOUBLE) AS fixed, CAST(NULL AS DOUBLE) AS absent,
  CASE WHEN scored_at >= TIMESTAMP '1998-01-01' AND id % 2 = 0 THEN 'worker' ELSE source END AS source
FROM {decisions} d"""
NUMERIC = ["amount", "risk_score", "latency_ms", "gappy", "few", "fixed", "absent"]


def _sides(sp, d):
    df = sp.sql(DRIFT_SQL, decisions=views.decisions(sp, d))
    at = F.col("scored_at") < F.lit(SPLIT).cast("timestamp")
    return df.where(at), df.where(~at)


PSI_TAIL = """edges AS (SELECT feature, CASE WHEN len(e) < 2 THEN [e[1] - 1e-9, e[1] + 1e-9] ELSE e END AS e FROM (
  SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e
  FROM long WHERE ref AND value IS NOT NULL GROUP BY 1) q),
hits AS (SELECT feature, ref, CASE WHEN value IS NULL THEN -1 WHEN value < e[1] OR value > e[-1] THEN NULL
  ELSE least(len(list_filter(e, lambda x: x <= value)), len(e) - 1) END AS bin FROM long JOIN edges USING (feature)),
counts AS (SELECT feature, bin, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM hits
  WHERE bin IS NOT NULL GROUP BY 1, 2),
slots AS (SELECT feature, unnest(list_concat([-1], range(1, len(e)))) AS bin FROM edges),
shares AS (SELECT feature, coalesce(r, 0) / greatest(sum(coalesce(r, 0)) OVER w, 1) AS p,
  coalesce(c, 0) / greatest(sum(coalesce(c, 0)) OVER w, 1) AS q FROM slots LEFT JOIN counts USING (feature, bin)
  WINDOW w AS (PARTITION BY feature)),
psi AS (SELECT feature, sum((CASE WHEN q = 0 THEN 1e-4 ELSE q END - CASE WHEN p = 0 THEN 1e-4 ELSE p END)
  * ln(CASE WHEN q = 0 THEN 1e-4 ELSE q END / CASE WHEN p = 0 THEN 1e-4 ELSE p END)) AS psi FROM shares GROUP BY 1)"""
CAT_TAIL = """cat AS (SELECT v, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM cats GROUP BY 1),
catp AS (SELECT coalesce(nullif(r / sum(r) OVER (), 0), 1e-4) AS p, coalesce(nullif(c / sum(c) OVER (), 0), 1e-4) AS q FROM cat),
catpsi AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM catp)"""
SEVERITY = "CASE WHEN psi > 0.25 THEN 'significant' WHEN psi > 0.1 THEN 'moderate' ELSE 'stable' END AS severity"


def _long(names, source, ref):
    return "long AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, CAST({n} AS DOUBLE) AS value, {ref} AS ref FROM {source}" for n in names) + ")"


DRIFTED = f"{D}, x AS MATERIALIZED ({DRIFT_SQL.format(decisions='decisions')}), "
_ref = f"scored_at < TIMESTAMP '{SPLIT}'"
_names_sql = ", ".join(f"('{n}')" for n in NUMERIC)
PSI_SQL = (f"{DRIFTED}{_long(NUMERIC, 'x', _ref)}, {PSI_TAIL}, every_ AS (SELECT n.feature, coalesce(psi, 0) AS psi "
           f"FROM (VALUES {_names_sql}) n(feature) LEFT JOIN psi USING (feature))")
add("psi_numeric", lambda sp, d: dr.psi_numeric(*_sides(sp, d), NUMERIC), f"{PSI_SQL} SELECT feature, {r('psi')} AS psi FROM every_")
CATS = f"cats AS (SELECT source AS v, {_ref} AS ref FROM x)"
add("psi_categorical", lambda sp, d: dr.psi_categorical(*_sides(sp, d), "source"),
    f"{DRIFTED}{CATS}, {CAT_TAIL} SELECT 'source' AS feature, {r('psi')} AS psi FROM catpsi")
add("feature_drift_severity", lambda sp, d: dr.feature_drift(*_sides(sp, d), NUMERIC, ["source"]).drop("caveat"),
    f"{PSI_SQL}, {CATS}, {CAT_TAIL}, a AS (SELECT feature, psi FROM every_ UNION ALL SELECT 'source', psi FROM catpsi) "
    f"SELECT feature, {r('psi')} AS psi, {SEVERITY} FROM a")
add("top_drifted_features", lambda sp, d: dr.top_drifted(dr.psi_numeric(*_sides(sp, d), NUMERIC), 3),
    f"{PSI_SQL} SELECT feature, {r('psi')} AS psi FROM every_ ORDER BY every_.psi DESC, feature LIMIT 3")
add("score_drift_ks", lambda sp, d: dr.score_drift(*[s.withColumnRenamed("amount", "score") for s in _sides(sp, d)]),
    f"{DRIFTED}g AS (SELECT amount AS v, count(*) FILTER (WHERE {_ref}) AS r, count(*) FILTER (WHERE NOT ({_ref})) AS c FROM x GROUP BY 1), "
    "k AS (SELECT sum(r) OVER (ORDER BY v) / sum(r) OVER () AS f, sum(c) OVER (ORDER BY v) / sum(c) OVER () AS h, "
    "sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM g), "
    "m AS (SELECT max(abs(f - h)) AS d, any_value(nr) AS nr, any_value(nc) AS nc FROM k), "
    "p AS (SELECT sum(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * power(sqrt(nr * nc / (nr + nc)) * d, 2))) AS pv "
    "FROM m, range(1, 101) x(j)) "
    f"SELECT {big('nr')} AS n_reference, {big('nc')} AS n_recent, {r('d')} AS ks_statistic, "
    f"{r('greatest(0, least(1, pv))')} AS ks_pvalue, pv < 0.05 AS significant_drift FROM m, p")
CAL_TAIL = ("cases AS (SELECT d.risk_score AS score, (rl.disposition = 'CONFIRMED_FRAUD')::INT AS hit FROM decisions d "
       "JOIN review_labels rl ON rl.decision_id = d.id WHERE d.scored_at >= TIMESTAMP '1996-01-01' AND rl.disposition <> 'UNCLEAR'), "
       "e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM cases), "
       "b AS (SELECT len(list_filter(e[2:-2], lambda x: x <= score)) AS bin, count(*) AS n, avg(score) AS s, avg(hit) AS h "
       "FROM cases, e GROUP BY 1)")


def _cal(sp, d):
    return dr.reviewed_calibration(views.decisions(sp, d), views.review_labels(sp, d), "1996-01-01")


CAL = f"{L}, {CAL_TAIL}"


add("calibration_drift_on_reviewed", _cal,
    f"{CAL} SELECT {big('bin')} AS bin, n, {r('s')} AS mean_predicted_score, {r('h')} AS empirical_fraud_rate FROM b")
add("calibration_gap_on_reviewed", lambda sp, d: dr.calibration_gap(_cal(sp, d)),
    f"{CAL} SELECT {r('avg(abs(s - h))')} AS mean_abs_calibration_error, {big('sum(n)')} AS n_reviewed FROM b")
add("action_mix_over_time", lambda sp, d: dr.action_mix_by_day(views.decisions(sp, d), "1997-01-01"),
    f"{D} SELECT date_trunc('day', scored_at) AS day, action, count(*) AS n FROM decisions "
    "WHERE scored_at >= TIMESTAMP '1997-01-01' GROUP BY 1, 2")
add("recent_decisions", lambda sp, d: dr.recent(views.decisions(sp, d), 30).select("id", "scored_at", "action"),
    f"{D} SELECT id, scored_at, action FROM decisions WHERE scored_at >= (SELECT max(scored_at) FROM decisions) - INTERVAL 30 DAY")

# --- features: drift and leak checks over the training period --------------------
CUT = "2024-01-21 00:00:00"
FEATURE_NUMERIC = [f for f in ALL_FEATURES if f not in CATEGORICAL]


def _feature_rows(sp, d):
    # read several times below, so computed and stored once
    return materialize(tidy(feats.point_in_time(views.txn(sp, d))))


def _feature_sides(sp, d):
    rows, at = _feature_rows(sp, d), F.col("ts") < F.lit(CUT).cast("timestamp")
    return rows.where(at), rows.where(~at)


F_SQL = f"WITH x AS MATERIALIZED ({features_sql(ALL_FEATURES, extra='ts, label_is_fraud, ')})"
_fref = f"ts < TIMESTAMP '{CUT}'"
add("feature_drift_all", lambda sp, d: dr.feature_drift(*_feature_sides(sp, d), FEATURE_NUMERIC, list(CATEGORICAL)).drop("caveat"),
    f"{F_SQL}, {_long(FEATURE_NUMERIC, 'x', _fref)}, {PSI_TAIL}, cats AS (SELECT amount_roundness AS v, {_fref} AS ref FROM x), "
    f"{CAT_TAIL}, a AS (SELECT feature, psi FROM psi UNION ALL SELECT 'amount_roundness', psi FROM catpsi) "
    f"SELECT feature, {r('psi')} AS psi, {SEVERITY} FROM a")
AUC_SQL = (f"{F_SQL}, t AS MATERIALIZED (SELECT * FROM x WHERE {_fref}), {_long(FEATURE_NUMERIC, 't', 'label_is_fraud')}, "
           "g AS (SELECT feature, value, count(*) AS n, count(*) FILTER (WHERE ref) AS pos FROM long WHERE value IS NOT NULL GROUP BY 1, 2 "
           "UNION ALL SELECT 'amount_roundness', rate, sum(n)::BIGINT, sum(pos)::BIGINT FROM (SELECT count(*) AS n, "
           "count(*) FILTER (WHERE label_is_fraud) AS pos, avg(label_is_fraud::INT) AS rate FROM t GROUP BY amount_roundness) q GROUP BY rate), "
           "c AS (SELECT *, sum(pos) OVER (PARTITION BY feature ORDER BY value DESC) AS cp FROM g), "
           "u AS (SELECT feature, coalesce(sum((n - pos) * (cp - pos + pos / 2.0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(n - pos), 0), 0.5) AS auc FROM c GROUP BY 1), "
           "b AS (SELECT feature, CASE WHEN feature = 'amount_roundness' THEN auc ELSE greatest(auc, 1 - auc) END AS auc FROM u) ")
add("single_feature_auc", lambda sp, d: mx.feature_auc(
    _feature_sides(sp, d)[0].withColumn("label", F.col("label_is_fraud").cast("int")).drop("label_is_fraud"),
    FEATURE_NUMERIC, list(CATEGORICAL)), AUC_SQL + f"SELECT feature, {r('auc')} AS auc, auc > 0.85 AS leaks FROM b")


# --- whole reports -----------------------------------------------------------------
def _monitoring(sp, d):
    return reports.monitoring_table(views.decisions(sp, d), views.review_labels(sp, d))


add("monitoring_report", _monitoring,
    f"{L}, {PENDING}, m AS (SELECT 'action_mix' AS section, action AS item, CAST(count(*) AS DOUBLE) AS value FROM decisions GROUP BY action "
    "UNION ALL SELECT 'alert_rate', strftime(scored_at, '%Y-%m-%d'), 100.0 * count(*) FILTER (WHERE action <> 'ALLOW') / count(*) FROM decisions GROUP BY 2 "
    "UNION ALL SELECT 'score_histogram', CAST(CAST(floor(risk_score * 20) AS BIGINT) + 1 AS VARCHAR), count(*) FROM decisions GROUP BY 2 "
    "UNION ALL SELECT 'latency_p95', source, quantile_cont(latency_ms, 0.95) FROM decisions GROUP BY source "
    "UNION ALL SELECT 'queue', 'depth', count(*) FROM pending UNION ALL SELECT 'queue', 'median_age_seconds', quantile_cont(age, 0.5) FROM pending "
    "UNION ALL SELECT 'precision', 'reviewed_pct', 100.0 * count(*) FILTER (WHERE disposition = 'CONFIRMED_FRAUD') / count(*) FROM review_labels) "
    f"SELECT section, item, {r('value', 1)} AS value FROM m", 1)


def _drift_report(sp, d):
    reference, current = _sides(sp, d)
    parts = reports.drift_report(reference, current, NUMERIC, ["source"], views.decisions(sp, d), views.review_labels(sp, d),
                                 "1996-01-01", score="risk_score")
    return reports.drift_table(parts)


add("drift_report", _drift_report,
    f"{PSI_SQL}, {CATS}, {CAT_TAIL}, {LABELS}, {CAL_TAIL}, t AS (SELECT 'feature' AS section, feature AS item, psi AS value FROM every_ "
    "UNION ALL SELECT 'feature', 'source', psi FROM catpsi UNION ALL SELECT 'calibration', 'mean_abs_error', avg(abs(s - h)) FROM b "
    f"UNION ALL SELECT 'recent', 'n', count(*) FROM x WHERE NOT ({_ref}) "
    "UNION ALL SELECT 'score', 'ks_statistic', max(abs(f - h)) FROM (SELECT sum(r) OVER (ORDER BY v) / sum(r) OVER () AS f, "
    "sum(c) OVER (ORDER BY v) / sum(c) OVER () AS h FROM (SELECT risk_score AS v, "
    f"count(*) FILTER (WHERE {_ref}) AS r, count(*) FILTER (WHERE NOT ({_ref})) AS c FROM x GROUP BY 1) g) k) "
    f"SELECT section, item, {r('value')} AS value FROM t")
