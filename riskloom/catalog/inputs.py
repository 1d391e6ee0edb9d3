"""Registered queries over readers, writers, validation and row shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import features as feats
from ..operators import frames as fr
from ..operators import metrics as mx
from ..operators import validate as va
from ..functions.registry import CATEGORICAL
from ..session import materialize, scratch
from ..sources import decision_log as dl
from ..sources import events as ev
from ..sources import legacy
from ..sources import testviews as views
from .decisions import D, FROM, TO, WINDOW
from .history import features_sql, over
from .shared import DECISIONS, LABELS, TXN, big, r, tidy

QUERIES, SQL = {}, {}


def add(name, fn, sql=None, digits=6):
    QUERIES[name] = lambda spark, d: tidy(fn(spark, d), digits)
    if sql:
        SQL[name] = sql


FIELDS = ("txn_id, ts, payer_vpa, payee_vpa, {amount} AS amount, txn_type, initiation_mode, device_id, payer_bank, payee_bank, "
          "{age} AS payer_account_age_days, label_is_fraud, label_typology").format(
    amount=r("amount"), age=big("payer_account_age_days"))
TXN_ROWS = f"WITH {TXN} SELECT {FIELDS} FROM txn"


def _files(kind):
    def run(sp, d):
        folder = scratch(sp)
        ev.write_events(views.txn(sp, d), folder)
        return ev.read_events(sp, f"{folder}/events.{kind}")
    return run


add("events_json_round_trip", _files("jsonl"), TXN_ROWS)
add("events_csv_round_trip", _files("csv"), TXN_ROWS)
add("message_codec", lambda sp, d: views.txn(sp, d).select(ev.encode().alias("event")).select(
    ev.decode("event").alias("e")).select("e.*").withColumnRenamed("timestamp", "ts"), TXN_ROWS)

# --- validation ---------------------------------------------------------------------
def _n():
    return F.substring("txn_id", 2, 20).cast("long")



def _bodies(sp, d, labels=True):
    rows = views.txn(sp, d)
    keep = ev.to_wire(rows.withColumn("txn_type", F.when(_n() % 11 == 0, "P2X").otherwise(F.col("txn_type")))
                      .withColumn("payer_vpa", F.when(_n() % 13 != 0, F.col("payer_vpa"))))
    if not labels:
        keep = keep.drop(*[c for c in keep.columns if c.startswith("label_")])
    body = F.to_json(F.struct(*keep.columns), {"timestampFormat": ev.TIME_FORMAT})
    body = F.when(_n() % 17 == 0, F.concat(F.lit('{"fraud_score":1,'), F.substring(body, 2, 100000))).otherwise(body)
    body = F.when(_n() % 19 == 0, F.regexp_replace(body, '"amount":[0-9.E]+', '"amount":"a lot"')).otherwise(body)
    return keep.select(F.when(_n() % 23 == 0, "not-valid-json").otherwise(body).alias("event"))


def _reasons(labels):
    def run(sp, d):
        good, bad = va.split_events(_bodies(sp, d), labels=labels)
        return bad.select("reason").unionByName(good.select(F.lit("valid").alias("reason"))).groupBy("reason").agg(
            F.count("*").alias("n"))
    return run


_CASES = """CASE WHEN n % 23 = 0 THEN 'not a JSON object' WHEN {extra} WHEN n % 13 = 0 THEN 'missing field: payer_vpa'
  WHEN n % 19 = 0 THEN 'bad value: amount' WHEN n % 11 = 0 THEN 'bad value: txn_type' ELSE 'valid' END AS reason"""
_VALID = f"WITH {TXN}, t AS (SELECT CAST(substring(txn_id, 2) AS BIGINT) AS n FROM txn) SELECT {{cases}}, count(*) AS n FROM t GROUP BY 1"
add("event_validation", _reasons(True), _VALID.format(cases=_CASES.format(
    extra="n % 17 = 0 THEN 'unknown field: fraud_score'")))
add("serving_input_validation", _reasons(False), _VALID.format(cases=_CASES.format(
    extra="n % 17 = 0 THEN 'unknown field: fraud_score, label_is_fraud, label_typology' "
          "WHEN true THEN 'unknown field: label_is_fraud, label_typology'")))
add("serving_input_without_labels", lambda sp, d: va.split_events(_bodies(sp, d, labels=False))[0].select(
    "txn_id", "ts", "amount", "payer_account_age_days"),
    f"WITH {TXN}, t AS (SELECT *, CAST(substring(txn_id, 2) AS BIGINT) AS n FROM txn) SELECT txn_id, ts, {r('amount')} AS amount, "
    f"{big('payer_account_age_days')} AS payer_account_age_days FROM t WHERE n % 23 <> 0 AND n % 17 <> 0 AND n % 13 <> 0 "
    "AND n % 19 <> 0 AND n % 11 <> 0")

LEGACY = """SELECT o_orderkey AS row_id, o_orderkey AS Merchant_id, CAST(NULL AS VARCHAR(10)) AS TransactionDate,
  CAST(o_custkey % 300 AS DOUBLE) AS AverageAmountTransactionDay, o_totalprice AS TransactionAmount,
  CASE WHEN o_orderkey % 7 < 3 THEN 'Y' ELSE 'N' END AS Is_declined, o_orderkey % 20 AS TotalNumberOfDeclinesDay,
  CASE WHEN o_custkey % 4 = 0 THEN 'Y' ELSE 'N' END AS isForeignTransaction,
  CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS isHighRiskCountry,
  CAST(o_custkey % 90 AS DOUBLE) AS DailyChargebackAvgAmt,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderkey % 111 AS DOUBLE) END AS Six_MonthAvgChbkAmt,
  o_orderkey % 10 AS Six_MonthChbkFreq,
  CASE WHEN o_totalprice > 200000 AND o_orderkey % 7 < 3 OR o_orderkey % 31 = 0 THEN 'Y' ELSE 'N' END AS isFradulent
FROM {orders} o"""
LEGACY_CTE = f"legacy AS ({LEGACY.format(orders='orders')})"


def legacy_view(sp, d):
    return sp.sql(LEGACY, orders=views.table(sp, d, "orders"))


def _legacy_csv(sp, d):
    path = f"{scratch(sp)}/legacy.csv"
    legacy_view(sp, d).drop("row_id").withColumn("TransactionDate", F.lit(None).cast("string")).write.option(
        "header", True).csv(path)
    return legacy.features_and_target(legacy.load(sp, path))


add("legacy_csv_load", _legacy_csv, f"WITH {LEGACY_CTE} SELECT " + ", ".join(
    [r(c) + f" AS {c}" if c in ("AverageAmountTransactionDay", "TransactionAmount", "DailyChargebackAvgAmt", "Six_MonthAvgChbkAmt")
     else c for c in legacy.FEATURES]) + ", isFradulent FROM legacy")


def _legacy_text(sp, d):
    df = legacy_view(sp, d)
    text = df.select("row_id", *[F.col(c).cast("string").alias(c) for c in legacy.FEATURES])
    return text.withColumn("TransactionAmount", F.when(F.col("row_id") % 9 == 0, "lots").otherwise(F.col("TransactionAmount"))).withColumn(
        "Is_declined", F.when(F.col("row_id") % 8 == 0, F.lit(" y ")).when(F.col("row_id") % 29 == 0, "MAYBE").otherwise(F.col("Is_declined")))


add("legacy_input_validation", lambda sp, d: va.check_legacy(_legacy_text(sp, d)).groupBy(
    F.coalesce("reason", F.lit("valid")).alias("reason"), "Is_declined").agg(F.count("*").alias("n")),
    f"WITH {LEGACY_CTE}, t AS (SELECT *, CASE WHEN row_id % 8 = 0 THEN 'Y' WHEN row_id % 29 = 0 THEN 'MAYBE' ELSE Is_declined END AS d "
    "FROM legacy) SELECT CASE WHEN Six_MonthAvgChbkAmt IS NULL THEN 'missing field: Six_MonthAvgChbkAmt' "
    "WHEN row_id % 9 = 0 THEN 'not a number: TransactionAmount' WHEN d = 'MAYBE' THEN 'not Y or N: Is_declined' "
    "ELSE 'valid' END AS reason, d AS Is_declined, count(*) AS n FROM t GROUP BY 1, 2")

# --- decision table -------------------------------------------------------------------


def _appended(table, day):
    def run(sp, d):
        log = table(sp, f"{scratch(sp)}/log", "year")
        rows = views.decisions(sp, d).select("txn_id", "id", "scored_at", "action", "source")
        first = rows.where("id % 3 <> 0")
        again = rows.where("id % 2 = 0").withColumn("action", F.lit("BLOCK"))
        log.append(first.unionByName(first.where("id % 5 = 0").withColumn(
            "scored_at", F.col("scored_at") + F.expr("INTERVAL 1 DAY"))).withColumnRenamed("scored_at", day))
        log.append(again.withColumnRenamed("scored_at", day))
        return log.read().select("txn_id", F.col(day).alias("scored_at"), "action", "source")
    return run


_APPENDED = (f"{D} SELECT txn_id, scored_at, CASE WHEN id % 3 <> 0 THEN action ELSE 'BLOCK' END AS action, source "
             "FROM decisions WHERE id % 3 <> 0 OR id % 2 = 0")
add("decision_log_append", _appended(dl.DecisionLog, "scored_at"), _APPENDED)
add("history_append", _appended(dl.EventHistory, "ts"), _APPENDED)


def _found(sp, d):
    """Each of a few ids looked up in the log, and how often it is there."""
    log = dl.DecisionLog(sp, f"{scratch(sp)}/log", "year")
    log.append(views.decisions(sp, d).select("txn_id", "scored_at", "action", "source"))
    log.append(views.decisions(sp, d).where("id % 2 = 0").select("txn_id", "scored_at", F.lit("BLOCK").alias("action"), "source"))
    ids = ["txn-1", "txn-2", "txn-7", "txn-none"]
    found = log.find(ids[0])
    for one in ids[1:]:
        found = found.unionByName(log.find(one))
    counts = sp.createDataFrame([(one, log.count(one)) for one in ids], "txn_id string, n long")
    return counts.join(found.drop("period"), "txn_id", "left")


add("decision_find", _found,
    f"{D} SELECT i.txn_id, count(d.txn_id) OVER (PARTITION BY i.txn_id) AS n, scored_at, action, source "
    "FROM (VALUES ('txn-1'), ('txn-2'), ('txn-7'), ('txn-none')) i(txn_id) LEFT JOIN decisions d USING (txn_id)")


def _labelled(sp, d):
    """Labels appended in two goes, some of them bad, read back; and what was refused."""
    store = dl.ReviewLabels(sp, f"{scratch(sp)}/labels")
    known, rows = views.decisions(sp, d), views.review_labels(sp, d)
    odd = F.col("decision_id") % 5 == 1
    first = rows.where("decision_id % 2 = 0").withColumn("disposition", F.when(odd, "MAYBE").otherwise(F.col("disposition")))
    second = rows.where("decision_id % 2 = 1").withColumn("decision_id", F.when(odd, -F.col("decision_id")).otherwise(F.col("decision_id")))
    refused = store.append(first, known).unionByName(store.append(second, known))
    shown = ("decision_id", "disposition", "reviewer_id", "reviewed_at")
    return store.read().select(*shown, F.lit("accepted").alias("reason")).unionByName(refused.select(*shown, "reason"))


add("review_labels_append", _labelled,
    f"WITH {DECISIONS}, {LABELS} SELECT CASE WHEN decision_id % 5 = 1 AND decision_id % 2 = 1 THEN -decision_id ELSE decision_id END AS decision_id, "
    "CASE WHEN decision_id % 5 = 1 AND decision_id % 2 = 0 THEN 'MAYBE' ELSE disposition END AS disposition, reviewer_id, reviewed_at, "
    "CASE WHEN decision_id % 5 <> 1 THEN 'accepted' WHEN decision_id % 2 = 0 THEN 'invalid disposition' ELSE 'unknown decision' END AS reason "
    "FROM review_labels")


def _audit(sp, d):
    log = dl.DecisionLog(sp, f"{scratch(sp)}/log", "month")
    rows = views.decisions(sp, d).select("txn_id", "id", "scored_at", "action", "source")
    log.append(rows.where("scored_at < '1998-01-01'"))
    before = materialize(log.fingerprint().withColumnsRenamed({"n": "n0", "content": "c0"}))
    log.append(rows.withColumn("action", F.lit("ALLOW")))
    after = log.fingerprint()
    same = before.join(after, "period")
    return same.agg(F.count("*").alias("periods"), F.count_if((F.col("n") == F.col("n0")) & (F.col("content") == F.col("c0")))
                    .alias("unchanged"))


add("decision_log_audit", _audit,
    f"{D} SELECT count(DISTINCT date_trunc('month', scored_at)) AS periods, count(DISTINCT date_trunc('month', scored_at)) AS unchanged "
    "FROM decisions WHERE scored_at < TIMESTAMP '1998-01-01'")


def _report(sp, d):
    folder = scratch(sp)
    rows = mx.typology_counts(views.txn(sp, d))
    dl.write_report(rows.withColumn("n", F.col("n") + 1), folder, "typologies", "2024-01-01")
    dl.write_report(rows, folder, "typologies", "2024-02-01")
    return dl.latest_report(sp, folder, "typologies", "typology string, n long")


add("report_sink_latest", _report,
    f"WITH {TXN} SELECT TIMESTAMP '2024-02-01' AS generated_at, coalesce(label_typology, 'legit') AS typology, count(*) AS n "
    "FROM txn GROUP BY 2")

# --- shaping --------------------------------------------------------------------------
DAYS = dict(train=(0, 19), val=(20, 24), test=(25, None))
SPLIT = ("split AS (SELECT *, CASE WHEN day <= 19 THEN 'train' WHEN day <= 24 THEN 'val' ELSE 'test' END AS split FROM "
         "(SELECT *, floor((us - min(us) OVER ()) / 86400000000.0) AS day FROM txn) q)")


def _split(sp, d):
    return fr.split_by_day(views.txn(sp, d), **DAYS)


add("temporal_split", lambda sp, d: _split(sp, d).select("txn_id", "split"), f"WITH {TXN}, {SPLIT} SELECT txn_id, split FROM split")
add("temporal_ranges", lambda sp, d: fr.split_ranges(_split(sp, d)),
    f"WITH {TXN}, {SPLIT} SELECT split, min(ts) AS first_ts, max(ts) AS last_ts FROM split GROUP BY split")


def _in_time(sp, d):
    rows = _split(sp, d)
    fr.assert_in_time(rows)
    return rows.groupBy("split").agg(F.count("*").alias("n"))


add("temporal_integrity", _in_time, f"WITH {TXN}, {SPLIT} SELECT split, count(*) AS n FROM split GROUP BY split")


def _with_mules(sp, d):
    return views.txn(sp, d).withColumn("label_typology", F.when(_n() % 5 == 0, "MULE_OUTBOUND").when(_n() % 7 != 0, F.col("label_typology")))


add("training_rows_without_mule_outbound", lambda sp, d: fr.for_training(_with_mules(sp, d)).select("txn_id", "label_typology"),
    f"WITH {TXN} SELECT txn_id, CASE WHEN CAST(substring(txn_id, 2) AS BIGINT) % 7 <> 0 THEN label_typology END AS label_typology "
    "FROM txn WHERE CAST(substring(txn_id, 2) AS BIGINT) % 5 <> 0")


def _cells(sp, d):
    ev_ = views.txn(sp, d)
    return fr.split_by_day(feats.cold_flags(ev_).join(ev_, "txn_id"), **DAYS)


_COLD = f"{SPLIT}, cold AS (SELECT *, count(*) {over('payee_vpa')} < 3 AS is_cold FROM split)"
add("split_route_counts", lambda sp, d: mx.cell_counts(_cells(sp, d)),
    f"WITH {TXN}, {_COLD} SELECT split, is_cold, count(*) AS n, count(*) FILTER (WHERE label_is_fraud) AS positives FROM cold GROUP BY 1, 2")
add("route_positives", lambda sp, d: fr.positives(_cells(sp, d).where("split = 'train'")),
    f"WITH {TXN}, {_COLD} SELECT is_cold, count(*) FILTER (WHERE label_is_fraud) AS positives FROM cold WHERE split = 'train' GROUP BY 1")
add("backtest_window", lambda sp, d: bt.window(views.decisions(sp, d), FROM, TO, "cold-v1").select("txn_id", "model_version"),
    f"{D}, {WINDOW} SELECT txn_id, model_version FROM win")


def _unsafe(sp, d):
    df = views.decisions(sp, d)
    odd = F.when(F.col("id") % 5 == 0, float("nan")).when(F.col("id") % 5 == 1, float("inf")).when(
        F.col("id") % 5 == 2, float("-inf")).otherwise(F.col("risk_score"))
    nested = df.select("txn_id", odd.alias("score"), F.struct(odd.alias("score"), F.col("action")).alias("s"),
                       F.array(odd, F.lit(1.0)).alias("a"))
    return fr.json_safe(nested).select("txn_id", "score", F.col("s.score").alias("nested"), "s.action",
                                       F.col("a")[0].alias("item"), F.col("a")[1].alias("one"))


_ok = r("CASE WHEN id % 5 > 2 THEN risk_score END")
add("json_safe_values", _unsafe,
    f"{D} SELECT txn_id, {_ok} AS score, {_ok} AS nested, action, {_ok} AS item, CAST(1.0 AS DOUBLE) AS one FROM decisions")


def _json_fields(sp, d):
    df = views.decisions(sp, d)
    body = F.to_json(F.struct("txn_id", F.when(F.col("id") % 4 != 0, F.col("amount")).alias("amount"), "label_is_fraud"))
    df = df.select("txn_id", body.alias("event"))
    return df.select("txn_id", fr.event_field("event", "label_is_fraud", "boolean").alias("label"),
                     fr.event_field("event", "amount", "double", 0.0).alias("amount"))


add("json_event_fields", _json_fields,
    f"{D} SELECT txn_id, label_is_fraud AS label, {r('CASE WHEN id % 4 <> 0 THEN amount ELSE 0.0 END')} AS amount FROM decisions")
_FRAME = ["payer_txn_count_24h", "amount_roundness", "no_such_feature", "payee_fanin_velocity", "is_night"]


def _frame(sp, d):
    rows = feats.point_in_time(views.txn(sp, d))
    return fr.model_frame(rows, _FRAME, keep=("txn_id",))


_inner = features_sql([c for c in _FRAME if c != "no_such_feature"])
add("model_frame", _frame,
    f"SELECT txn_id, CAST(payer_txn_count_24h AS DOUBLE) AS payer_txn_count_24h, CASE amount_roundness "
    + " ".join(f"WHEN '{v}' THEN {i}.0" for i, v in enumerate(CATEGORICAL["amount_roundness"]))
    + " END::DOUBLE AS amount_roundness, CAST(NULL AS DOUBLE) AS no_such_feature, payee_fanin_velocity, "
    f"CAST(is_night AS INT)::DOUBLE AS is_night FROM ({_inner}) q")
