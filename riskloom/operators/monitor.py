"""Queries over the decision table and its review labels.

Precision here is precision on reviewed cases only: reviewers see alerted
payments, so it says nothing about the model on payments that were allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DISPOSITIONS
from .ranking import percentiles, running_totals

PENDING = ("REVIEW", "BLOCK")


def _half_up(c, digits):
    scale = 10.0 ** digits
    return F.floor(c * scale + 0.5) / scale


def action_mix(decisions: DataFrame) -> DataFrame:
    n = decisions.groupBy("action").agg(F.count("*").alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(W.partitionBy())     # at most four rows
    return n.withColumn("pct", _half_up(share, 2)).orderBy(F.desc("n"))


def alert_rate(decisions: DataFrame) -> DataFrame:
    alert = F.col("action") != "ALLOW"
    per = decisions.groupBy(F.date_trunc("day", "scored_at").alias("day")).agg(
        F.count("*").alias("total"), F.count_if(alert).alias("alerts"))
    return per.withColumn("alert_rate_pct", _half_up(100.0 * F.col("alerts") / F.col("total"), 2)).orderBy("day")


def latency(decisions: DataFrame) -> DataFrame:
    p = percentiles(decisions, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, ("source",))
    return p.select("source", "n", *[_half_up(F.col(c), 2).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")]
                    ).orderBy("source")


def reviewed_precision(labels: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("disposition") == "CONFIRMED_FRAUD")
    return labels.agg(F.count("*").alias("n_reviewed"), hit.alias("n_confirmed_fraud")).withColumn(
        "precision_on_reviewed_pct",
        F.when(F.col("n_reviewed") > 0, _half_up(100.0 * F.col("n_confirmed_fraud") / F.col("n_reviewed"), 2)))


def reviewed_share(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count("*").alias("total_labels"),
                      F.avg(F.when(F.col("disposition") == "CONFIRMED_FRAUD", 1.0).otherwise(0.0)).alias("reviewed_precision"))


def pending(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    open_ = decisions.where(F.col("action").isin(*PENDING))
    return open_.join(labels.select(F.col("decision_id").alias("id")), "id", "left_anti")


def _aged(decisions, labels, now):
    rows = pending(decisions, labels)
    if now is None:
        return rows.crossJoin(F.broadcast(decisions.agg(F.max("scored_at").alias("_now")))).withColumn(
            "age", (F.unix_micros("_now") - F.unix_micros("scored_at")) / 1e6)
    return rows.withColumn("age", (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("scored_at")) / 1e6)


def queue_depth(decisions: DataFrame, labels: DataFrame, now=None) -> DataFrame:
    """Cases waiting for review and their median age; `now` defaults to the
    newest decision."""
    p = percentiles(_aged(decisions, labels, now).select("age"), "age", {"m": 0.5})
    return p.select(F.coalesce("n", F.lit(0)).alias("queue_depth"), _half_up(F.col("m"), 0).alias("median_age_seconds"))


def queue_page(decisions: DataFrame, labels: DataFrame, page: int = 1, size: int = 25) -> DataFrame:
    """One page of the review queue, newest first."""
    return (pending(decisions, labels).orderBy(F.desc("scored_at"), F.desc("id"))
            .offset((page - 1) * size).limit(size))


def queue_upper_median_age(decisions: DataFrame, labels: DataFrame, now=None) -> DataFrame:
    """The age at rank n div 2 (the upper of two middle ages); 0 when empty."""
    rows = _aged(decisions, labels, now).select("age")
    at = running_totals(rows, "age", {"n": F.lit(1)})
    at = at.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"))))
    k = F.floor(F.col("_n") / 2)
    hit = (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
    return at.agg(F.coalesce(F.max(F.when(hit, F.col("age"))), F.lit(0.0)).alias("median_age_seconds"),
                  F.coalesce(F.sum("n"), F.lit(0)).alias("queue_depth"))


def score_histogram(decisions: DataFrame) -> DataFrame:
    """Twenty equal buckets over [0, 1]; a score of 1 falls into bucket 21."""
    bucket = F.width_bucket("risk_score", F.lit(0.0), F.lit(1.0), F.lit(20))
    return decisions.groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n")).withColumn(
        "bucket_start", _half_up((F.col("bucket") - 1) * 0.05, 2)).orderBy("bucket")


def review_split(new: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New labels that may be appended, and the rejected ones with a reason."""
    known = decisions.select(F.col("id").alias("decision_id"))
    named = F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False))
    good = new.where(named).join(known, "decision_id", "left_semi")
    bad = new.where(~named).withColumn("reason", F.lit("invalid disposition")).unionByName(
        new.where(named).join(known, "decision_id", "left_anti").withColumn("reason", F.lit("unknown decision")))
    return good, bad


def dashboard(decisions: DataFrame, labels: DataFrame, drift_reports: DataFrame | None = None, now=None) -> dict:
    """All monitoring tables, the newest drift report and its top features."""
    out = {
        "alert_rate": alert_rate(decisions), "action_mix": action_mix(decisions),
        "score_histogram": score_histogram(decisions), "latency": latency(decisions),
        "queue": queue_depth(decisions, labels, now), "precision": reviewed_precision(labels),
    }
    if drift_reports is not None:
        newest = drift_reports.agg(F.max("generated_at").alias("generated_at"))
        latest = drift_reports.join(F.broadcast(newest), "generated_at")
        out["drift"] = latest
        out["top_drifted"] = latest.orderBy(F.desc("psi"), "feature").limit(10)
    return out
