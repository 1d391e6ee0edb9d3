"""Registered queries that train or use models, and the stream scorer."""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import functions as F

from ..functions import messages
from ..functions.policy import Thresholds
from ..functions.registry import ALL_FEATURES, CATEGORICAL
from ..operators import features as feats
from ..operators import metrics as mx
from ..operators import model as md
from ..plans import scoring, training
from ..session import materialize, scratch
from ..sources import decision_log as dl
from ..sources import events as ev
from ..sources import legacy
from ..sources import testviews as views
from ..sources.tiered import TieredHistory
from ..streaming import payee_state, scorer, window_state
from .decisions import ALERTS, CAUGHT, GROUPED, RANK, S, scored
from .explore import clean
from .history import D1, DV, H1, M1, P, PAIR, _group, features_sql, over
from .inputs import DAYS
from .shared import TIES, TXN, r, tidy

QUERIES, SQL = {}, {}
# Thresholds low enough for the test tables' scores to raise every action.
LOW: Thresholds = {"cold": {"t_warn": 0.05, "t_review": 0.2, "t_block": 0.5},
                   "warm": {"t_warn": 0.05, "t_review": 0.2, "t_block": 0.5}}
_fits: dict = {}


def add(name, fn, sql=None, digits=6):
    QUERIES[name] = lambda spark, d: tidy(fn(spark, d), digits)
    if sql:
        SQL[name] = sql


def fitted(sp, d) -> training.Fitted:
    """Models for one data folder, trained once per application."""
    key = (sp.sparkContext.applicationId, d)
    if key not in _fits:
        # the view's amount partly decides its label by construction, so the leak guard is off here
        _fits[key] = training.fit(feats.point_in_time(views.txn(sp, d)), **DAYS, min_positives=1, check_leaks=False)
    return _fits[key]


add("model_evaluation", lambda sp, d: training.evaluate("combined", fitted(sp, d).scored_test))
add("bootstrap_intervals", lambda sp, d: training.long_table(
    "combined", mx.bootstrap_pr_auc(fitted(sp, d).scored_test).drop("text")))
add("ablation_without_pair_history", lambda sp, d: training.ablate(fitted(sp, d), check_leaks=False)[1])
add("calibrated_scores", lambda sp, d: fitted(sp, d).scored_test.select("txn_id", "is_cold", "raw_score", "risk_score"))
add("chosen_thresholds", lambda sp, d: sp.createDataFrame(
    [(k, *[v[t] for t in ("t_warn", "t_review", "t_block")]) for k, v in fitted(sp, d).thresholds.items()],
    "route string, t_warn double, t_review double, t_block double"))


def _scored(sp, d):
    f = fitted(sp, d)
    return materialize(md.score(f.rows.where("split = 'test'"), f.models, LOW))


add("scored_decisions", lambda sp, d: _scored(sp, d).select("txn_id", "is_cold", "risk_score", "risk_tier", "action", "model_version"))
add("reason_codes", lambda sp, d: md.reason_codes(_scored(sp, d), fitted(sp, d).models).select(
    "txn_id", F.posexplode("reason_codes").alias("rank", "c")).select("txn_id", "rank", "c.code", "c.message", "c.value"))
add("rescored_backtest", lambda sp, d: scoring.run_backtest(
    scoring.decisions(fitted(sp, d).rows, fitted(sp, d).rows.where("split = 'test'"), fitted(sp, d).models, LOW, "replay", "2024-02-01"),
    fitted(sp, d).models, fitted(sp, d).thresholds), digits=3)
add("batch_replay", lambda sp, d: scoring.replay(
    views.txn(sp, d), fitted(sp, d).models, LOW, dl.DecisionLog(sp, f"{scratch(sp)}/log"), "2024-02-01").select(
    "txn_id", "is_cold", "action", "risk_score", "source"))

_rules = ["payee_is_unseen", "amount_zscore_vs_payer_30d", "is_collect_request", "is_night", "payer_payee_txn_count"]
add("rules_baseline_score", lambda sp, d: md.rules_score(feats.point_in_time(views.txn(sp, d))).select("txn_id", "score"),
    f"SELECT txn_id, CAST(2 * payee_is_unseen::INT + 2 * (coalesce(amount_zscore_vs_payer_30d, 0) > 3)::INT + is_collect_request::INT "
    f"+ is_night::INT + (payer_payee_txn_count = 0)::INT AS BIGINT) AS score FROM ({features_sql(_rules)}) q")


def _rules_eval(sp, d):
    rows = md.rules_score(feats.point_in_time(views.txn(sp, d))).withColumn("label", F.col("label_is_fraud").cast("int"))
    return mx.score_only(materialize(rows.select("txn_id", "score", "label", "amount")))


_points = ("2 * payee_is_unseen::INT + 2 * (coalesce(amount_zscore_vs_payer_30d, 0) > 3)::INT + is_collect_request::INT "
           "+ is_night::INT + (payer_payee_txn_count = 0)::INT")
_scored_rules = (f"WITH scored AS (SELECT txn_id, label, amount, CAST({_points} AS BIGINT) AS score FROM "
                 f"({features_sql(_rules, extra='CAST(label_is_fraud AS INT) AS label, amount, ')}) q)")
add("rules_baseline_evaluation", _rules_eval, f"{_scored_rules}, {GROUPED}, {CAUGHT} SELECT a.*, m.* FROM ({ALERTS}) a, ({RANK}) m")


def _message_texts(sp, d):
    """Every feature of every row put into words: rows, and rows left without."""
    rows = feats.point_in_time(views.txn(sp, d))
    long = rows.select("txn_id", "amount_roundness", F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), (F.lit(None) if c in CATEGORICAL else F.col(c)).cast("double").alias("v"))
        for c in ALL_FEATURES])))
    text = messages.message(F.col("feature"), F.col("v"), F.col("amount_roundness"))
    return long.select("feature", text.alias("message")).groupBy("feature").agg(
        F.count("*").alias("n"), F.count_if(F.col("message").isNull()).alias("without_text"))


_each = ", ".join(f"('{c}')" for c in ALL_FEATURES)
add("reason_messages", _message_texts,
    f"SELECT f.feature, count(*) AS n, CAST(0 AS BIGINT) AS without_text FROM (VALUES {_each}) f(feature), events GROUP BY 1")


def _legacy_fit(sp, d):
    df = clean(sp, d)
    m = md.legacy_pipeline(trees=20).fit(df.where("row_id % 5 <> 0"))
    out = md.legacy_predict(m, df.where("row_id % 5 = 0").select("row_id", *legacy.FEATURES, legacy.TARGET))
    return mx.confusion(out.select(F.col("label").alias("predicted"), F.col(legacy.TARGET).alias("label")))


add("legacy_pipeline_evaluation", _legacy_fit)


# --- streams -----------------------------------------------------------------------
def _messages(sp, d, folder, files=3):
    rows = views.txn(sp, d)
    scorer.replay_in_order(rows, ev.write_messages, folder, files)
    # some deliveries are repeated, some are broken
    n = F.substring("txn_id", 2, 20).cast("long")
    ev.write_messages(rows.where(n % 50 == 0), folder)
    broken = rows.where(n % 100 == 0).select(F.concat(F.lit("not-valid-json "), "txn_id").alias("value"))
    odd = rows.where(n % 100 == 1).select(F.to_json(F.struct(F.to_json(F.struct("txn_id")).alias("event"))).alias("value"))
    broken.unionByName(odd).write.mode("append").text(folder)


_runs: dict = {}


def stream_run(sp, d):
    key = (sp.sparkContext.applicationId, d)
    if key not in _runs:
        base = scratch(sp)
        _messages(sp, d, f"{base}/in")
        f = fitted(sp, d)
        s = scorer.Scorer(TieredHistory(sp, f"{base}/history"), dl.DecisionLog(sp, f"{base}/log"), f.models, LOW,
                          f"{base}/dead", f"{base}/stats")
        q = s.start(ev.stream_messages(sp, f"{base}/in"), f"{base}/ckpt", available_now=True)
        q.awaitTermination()
        _runs[key] = (s, base)
    return _runs[key]


add("stream_routing", lambda sp, d: stream_run(sp, d)[0].log.read().select("txn_id", "is_cold"),
    f"WITH {TXN} SELECT txn_id, count(*) {over('payee_vpa')} < 3 AS is_cold FROM txn")
add("stream_decisions", lambda sp, d: stream_run(sp, d)[0].log.read().select("txn_id", "action", "risk_score", "source"))


def _stream_against_batch(sp, d):
    """Each row of the stream's log beside the batch replay of the same events."""
    cols = ("is_cold", "action", "risk_tier", "raw_score", "risk_score", "feature_snapshot")
    batch = scoring.replay(views.txn(sp, d), fitted(sp, d).models, LOW, None, "2024-02-01")
    both = stream_run(sp, d)[0].log.read().select("txn_id", *cols).join(
        batch.select("txn_id", *[F.col(c).alias(f"b_{c}") for c in cols]), "txn_id", "full")
    same = lambda *names: F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in names]), lambda x: x)
    return both.select("txn_id", same("is_cold", "feature_snapshot").alias("same_features"), same("raw_score", "risk_score").alias("same_scores"),
                       same("action", "risk_tier").alias("same_decision"))


add("stream_equals_batch", _stream_against_batch,
    f"WITH {TXN} SELECT DISTINCT txn_id, true AS same_features, true AS same_scores, true AS same_decision FROM txn")

_NEWEST = "2001-03-01"
_tiered_names = [c for g in "BCDE" for c in _group(g)]


def _tiered(sp, d):
    """Features of the newest rows of a history of years, from a snapshot and the rows since."""
    rows = materialize(views.txn_ties(sp, d))
    store = TieredHistory(sp, f"{scratch(sp)}/tiered", every_days=60, grain="year")
    for low, high in (("1900-01-01", "1998-01-01"), ("1998-01-01", "2000-09-01"), ("2000-09-01", _NEWEST)):
        part = rows.where((F.col("ts") >= low) & (F.col("ts") < high))
        store.append(part)
        store.roll_if_due(part.agg(F.max("ts")).first()[0].astimezone(timezone.utc))
    new = rows.where(F.col("ts") >= _NEWEST)
    base = store.base_for(new.agg(F.min("ts")).first()[0].astimezone(timezone.utc))
    return scoring.features_from(new, store, base).select("txn_id", *_tiered_names)


add("tiered_history_features", _tiered,
    f"SELECT * EXCLUDE (ts) FROM ({features_sql(_tiered_names, TIES, extra='ts, ', digits=3)}) q WHERE ts >= TIMESTAMP '{_NEWEST}'", digits=3)
add("stream_history", lambda sp, d: stream_run(sp, d)[0].history.read().select("txn_id", "ts", "amount"),
    f"WITH {TXN} SELECT txn_id, ts, {r('amount')} AS amount FROM txn")
add("stream_dead_letters", lambda sp, d: scorer.read_dead_letters(sp, stream_run(sp, d)[0].dead_letters).groupBy("reason", "retries").agg(
    F.count("*").alias("n")),
    f"WITH {TXN}, t AS (SELECT CAST(substring(txn_id, 2) AS BIGINT) % 100 AS m FROM txn) "
    "SELECT CASE m WHEN 0 THEN 'not a JSON object' ELSE 'missing field: timestamp, payer_vpa, payee_vpa, amount, txn_type, "
    "initiation_mode, device_id, payer_bank, payee_bank, payer_account_age_days, label_is_fraud' END AS reason, CAST(0 AS BIGINT) AS retries, count(*) AS n "
    "FROM t WHERE m < 2 GROUP BY 1")
add("stream_action_counts", lambda sp, d: sp.read.schema("action string, n long").json(stream_run(sp, d)[0].stats).groupBy("action").agg(
    F.sum("n").alias("n")))
add("stream_action_counts_total", lambda sp, d: sp.read.schema("action string, n long").json(stream_run(sp, d)[0].stats).agg(
    F.sum("n").alias("n")), f"WITH {TXN} SELECT CAST(count(DISTINCT txn_id) AS BIGINT) AS n FROM txn")


def _state(sp, d, read=lambda rows: payee_state.payee_reads(rows.withColumn("us", F.unix_micros("ts")))):
    """Three arrivals in time order; the state goes on from the checkpoint."""
    folder = scratch(sp)
    rows = views.txn(sp, d).select("txn_id", "payee_vpa", "payer_vpa", "device_id", "amount", "txn_type", "ts")
    us = F.unix_micros("ts")
    low, high = rows.agg(F.min(us), F.max(us)).first()
    step = (high - low) // 3 + 1
    name = "spark.sql.streaming.stateStore.providerClass"
    old = sp.conf.get(name)
    sp.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(3):
            lo = low + i * step
            rows.where((us >= lo) & (us < lo + step)).write.mode("append").parquet(f"{folder}/in")
            stream = sp.readStream.schema(rows.schema).parquet(f"{folder}/in")
            q = (read(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/ckpt").outputMode("append")
                 .trigger(availableNow=True).start(f"{folder}/out"))
            q.awaitTermination()
    finally:
        sp.conf.set(name, old)
    return sp.read.parquet(f"{folder}/out")


add("payee_state_stream", lambda sp, d: _state(sp, d).select(
    "txn_id", "payee_n", "payee_payers", "payee_p2m", "payee_sum", F.timestamp_micros("payee_first_us").alias("first_seen"), "late"),
    f"WITH {TXN} SELECT txn_id, count(*) {over('payee_vpa')} AS payee_n, count(DISTINCT payer_vpa) {over('payee_vpa')} AS payee_payers, "
    f"count(*) FILTER (WHERE txn_type = 'P2M') {over('payee_vpa')} AS payee_p2m, min(ts) {over('payee_vpa')} AS first_seen, "
    f"{r(f'coalesce(sum(x) {over("payee_vpa")}, 0)', 3)} AS payee_sum, false AS late FROM txn", digits=3)


def _last(name):
    return F.timestamp_micros(f"{name}_last_us").alias(f"{name}_last")


add("payer_state_stream", lambda sp, d: _state(sp, d, lambda rows: window_state.window_reads(rows, window_state.PAYER)).select(
    "txn_id", "payer_n_1h", "payer_n_24h", "payer_n_30d", "payer_n", "payer_sum_30d", "payer_payees_24h", _last("payer")),
    f"WITH {TXN} SELECT txn_id, count(*) {over(P, H1)} AS payer_n_1h, count(*) {over(P, D1)} AS payer_n_24h, count(*) {over(P, M1)} AS payer_n_30d, "
    f"count(*) {over(P)} AS payer_n, {r(f'coalesce(sum(x) {over(P, M1)}, 0)')} AS payer_sum_30d, count(DISTINCT payee_vpa) {over(P, D1)} AS payer_payees_24h, "
    f"max(ts) {over(P)} AS payer_last FROM txn")
add("device_state_stream", lambda sp, d: _state(sp, d, lambda rows: window_state.window_reads(rows, window_state.DEVICE)).select(
    "txn_id", "device_n_1h", "device_payers_30d", "device_n", _last("device")),
    f"WITH {TXN} SELECT txn_id, count(*) {over(DV, H1)} AS device_n_1h, count(DISTINCT payer_vpa) {over(DV, M1)} AS device_payers_30d, "
    f"count(*) {over(DV)} AS device_n, max(ts) {over(DV)} AS device_last FROM txn")
add("pair_state_stream", lambda sp, d: _state(sp, d, lambda rows: window_state.window_reads(rows, window_state.PAIR)).select(
    "txn_id", "pair_n", _last("pair")),
    f"WITH {TXN} SELECT txn_id, count(*) {over(PAIR)} AS pair_n, max(ts) {over(PAIR)} AS pair_last FROM txn")


# --- late and repeated events --------------------------------------------------------
_HORIZON = 5 * D1
_ID = "CAST(substring(txn_id, 2) AS BIGINT)"


def _deduped(sp, d):
    """Three arrivals. The second and third also bring rows of the one before again; rows held back from the first third come
    with the last one, beyond the horizon, and some of the second third within it."""
    folder = scratch(sp)
    rows = materialize(views.txn(sp, d).select("txn_id", "ts", "amount"))
    us, n = F.unix_micros("ts"), F.expr(_ID)
    low, high = rows.agg(F.min(us), F.max(us)).first()
    step = (high - low) // 3 + 1
    third = F.floor((us - low) / step).cast("int")
    held = ((third == 0) & (n % 97 == 0)) | ((third == 1) & (n % 97 == 1))
    for i in range(3):
        part = rows.where((third == i) & ~held)
        if i:
            part = part.unionByName(rows.where((third == i - 1) & ~held & (n % 10 == 0)))
        if i == 2:
            part = part.unionByName(rows.where(held))
        part.write.mode("append").parquet(f"{folder}/in")
        stream = sp.readStream.schema(rows.schema).parquet(f"{folder}/in")
        q = (scorer.without_repeats(stream, f"{_HORIZON} microseconds").writeStream.format("parquet")
             .option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start(f"{folder}/out"))
        q.awaitTermination()
    return sp.read.schema(rows.schema).parquet(f"{folder}/out")


add("stream_without_repeats", _deduped,
    f"WITH {TXN}, e AS (SELECT *, {_ID} AS n, min(us) OVER () AS lo, max(us) OVER () AS hi FROM txn), "
    "t AS (SELECT *, (us - lo) // ((hi - lo) // 3 + 1) AS third FROM e), "
    "w AS (SELECT max(us) FILTER (WHERE third = 1 AND n % 97 <> 1) // 1000 * 1000 - " + str(_HORIZON) + " AS mark FROM t) "
    f"SELECT txn_id, ts, {r('amount')} AS amount FROM t, w "
    "WHERE NOT (third = 0 AND n % 97 = 0) AND NOT (third = 1 AND n % 97 = 1 AND us <= mark)")


def _late(sp, d):
    """Events that arrive after all others are scored as of their own moment."""
    rows = materialize(views.txn(sp, d))
    late = F.expr(_ID) % 97 == 0
    store = TieredHistory(sp, f"{scratch(sp)}/late", grain="month")
    store.append(rows.where(~late))
    return scoring.features_from(rows.where(late), store, None).select("txn_id", *_tiered_names)


add("late_event_features", _late, f"SELECT * FROM ({features_sql(_tiered_names)}) q WHERE {_ID} % 97 = 0")
add("bootstrap_interval_holds", lambda sp, d: mx.bootstrap_pr_auc(scored(sp, d)).select(
    "pr_auc", F.col("pr_auc").between(F.col("ci_low"), F.col("ci_high")).alias("inside")),
    f"{S}, {GROUPED} SELECT pr_auc, true AS inside FROM ({RANK})")
