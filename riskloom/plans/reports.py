"""The monitoring and drift reports as whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import drift as dr
from ..operators import monitor as mo


def _part(df: DataFrame, section: str, item: Column, value: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), F.col(value).cast("double").alias("value"))


def monitoring_table(decisions: DataFrame, labels: DataFrame, now=None) -> DataFrame:
    """Every monitoring query as (section, item, value) rows. Callers that hold
    a large decision table read it once by persisting it before."""
    t = mo.dashboard(decisions, labels, now=now)
    rate = t["alert_rate"].withColumn("rate", 100.0 * F.col("alerts") / F.col("total"))
    return reduce(DataFrame.unionByName, [
        _part(t["action_mix"], "action_mix", F.col("action"), "n"),
        _part(rate, "alert_rate", F.date_format("day", "yyyy-MM-dd"), "rate"),
        _part(t["score_histogram"], "score_histogram", F.col("bucket"), "n"),
        _part(t["latency"], "latency_p95", F.col("source"), "p95_ms"),
        _part(t["queue"], "queue", F.lit("depth"), "queue_depth"),
        _part(t["queue"], "queue", F.lit("median_age_seconds"), "median_age_seconds"),
        _part(t["precision"], "precision", F.lit("reviewed_pct"), "precision_on_reviewed_pct")])


def drift_report(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str], decisions: DataFrame,
                 labels: DataFrame, since, score: str = "risk_score") -> dict[str, DataFrame]:
    """Feature, score and calibration drift of a recent period; fails when the
    period is empty."""
    if current.isEmpty():
        raise ValueError("no recent decisions to compare")
    return {
        "features": dr.feature_drift(reference, current, numeric, categorical),
        "score": dr.score_drift(reference, current, score),
        "calibration": dr.reviewed_calibration(decisions, labels, since),
        "action_mix": dr.action_mix_by_day(decisions, since),
        "recent": current.agg(F.count("*").alias("n")),
    }


def drift_table(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        _part(parts["features"], "feature", F.col("feature"), "psi"),
        _part(parts["score"], "score", F.lit("ks_statistic"), "ks_statistic"),
        _part(dr.calibration_gap(parts["calibration"]), "calibration", F.lit("mean_abs_error"), "mean_abs_calibration_error"),
        _part(parts["recent"], "recent", F.lit("n"), "n")])
