"""Scoring of events into decisions, in batch; the stream uses the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.registry import ALL_FEATURES
from ..operators import features as ft
from ..operators import model as md
from ..operators.backtest import backtest
from ..schema import EVENT
from ..session import materialize
from ..sources.decision_log import BROADCAST_ROWS, DecisionLog
from ..sources.tiered import Base, TieredHistory

_NO_CODES = "array<struct<code:string,message:string,feature:string,value:string,contribution:double>>"


def _touched(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the history that share a party with the batch; only they can
    matter. The party lists of a micro-batch are broadcast once their size is
    known."""
    small = batch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    old = old.join(F.broadcast(batch.select("txn_id")) if small else batch.select("txn_id"), "txn_id", "left_anti")
    touched = F.lit(False)
    for c in ("payer_vpa", "payee_vpa", "device_id"):
        k = batch.select(c).distinct().withColumn(f"_{c}", F.lit(True))
        old = old.join(F.broadcast(k) if small else k, c, "left")
        touched = touched | F.col(f"_{c}").isNotNull()
    return old.where(touched)


def features_of(batch: DataFrame, history: DataFrame | None, carried: ft.Carried | None = None) -> DataFrame:
    """Features of the batch rows as of their own timestamps, given everything
    recorded before. Rows of the batch see each other by time, so the order
    inside a batch does not matter; a late row is cut by its own timestamp and
    earlier results are not revised. `carried` stands for older rows that are
    not in `history`."""
    cols = EVENT.names
    rows = batch.select(*cols).withColumn("_new", F.lit(True))
    if history is not None:
        rows = rows.unionByName(_touched(history.select(*cols), batch).select(*cols).withColumn("_new", F.lit(False)))
    return ft.point_in_time(rows, only="_new", carried=carried)


def features_from(batch: DataFrame, history: TieredHistory, base: Base | None) -> DataFrame:
    """`features_of` the batch from a snapshot and the rows since."""
    if base is None:
        return features_of(batch, history.since(None))
    keys = {c: batch.select(c).distinct() for c in ("payer_vpa", "payee_vpa")}
    pairs = history.totals(base, "pairs", keys["payer_vpa"]).unionByName(history.totals(base, "pairs_of_payee", keys["payee_vpa"]))
    return features_of(batch, history.since(base), ft.Carried(
        history.totals(base, "payers", keys["payer_vpa"]), history.totals(base, "payees", keys["payee_vpa"]),
        pairs.distinct(), history.totals(base, "owners", keys["payer_vpa"])))


def decisions(events: DataFrame, features: DataFrame, models, thresholds: policy.Thresholds, source: str,
              scored_at, lib_version: str = "1", thresholds_version: str = "1", batch: str | None = None) -> DataFrame:
    """Decision rows: event and feature snapshot as structs, scores, action,
    reasons (alerts only), versions and the micro-batch that made them."""
    scored = materialize(md.score(features, models, thresholds, thresholds_version))
    codes = md.reason_codes(scored, models)
    event = F.struct(*[F.col(c) for c in EVENT.names if c in events.columns])
    facts = events.select("txn_id", event.alias("event"))
    snapshot = F.struct(*[F.col(c) for c in ALL_FEATURES]).alias("feature_snapshot")
    rows = scored.select("txn_id", snapshot, "risk_score", "raw_score", "is_cold", "action", "risk_tier",
                         "model_version", "thresholds_version")
    return rows.join(facts, "txn_id").join(codes, "txn_id", "left").select(
        "txn_id", "event", "feature_snapshot", "risk_score", "raw_score", "is_cold", "action", "risk_tier",
        F.coalesce("reason_codes", F.array().cast(_NO_CODES)).alias("reason_codes"), "model_version",
        "thresholds_version", F.lit(lib_version).alias("feature_lib_version"), F.lit(0.0).alias("latency_ms"),
        F.lit(scored_at).cast("timestamp").alias("scored_at"), F.lit(source).alias("source"),
        F.lit(batch).cast("string").alias("batch"))


def replay(events: DataFrame, models, thresholds: policy.Thresholds, log: DecisionLog | None, scored_at,
           source: str = "replay") -> DataFrame:
    """Score a whole event set in one batch and log it."""
    rows = materialize(ft.first_per_txn(events))
    out = materialize(decisions(rows, ft.point_in_time(rows), models, thresholds, source, scored_at))
    if log is not None:
        log.append(out)
    return out


def rescore(logged: DataFrame, models, thresholds: policy.Thresholds) -> DataFrame:
    """Logged decisions scored again from their stored snapshots; no feature is
    recomputed. Adds new_risk_score and new_action."""
    flat = logged.select("txn_id", "is_cold", "action", F.col("event.amount").alias("amount"),
                         *([F.col("event.label_is_fraud").alias("label_is_fraud")]), "feature_snapshot.*")
    new = md.score(flat.drop("action"), models, thresholds).select(
        "txn_id", F.col("risk_score").alias("new_risk_score"), F.col("action").alias("new_action"), "is_cold", "amount",
        "label_is_fraud")
    return new.join(logged.select("txn_id", "action", "risk_score", "scored_at"), "txn_id")


def run_backtest(log: DataFrame, models, thresholds: policy.Thresholds) -> DataFrame:
    rows = materialize(rescore(log, models, thresholds))
    if rows.isEmpty():
        raise ValueError("no decisions in the window")
    return backtest(rows)


