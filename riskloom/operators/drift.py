"""Drift between a reference and a recent period: features, scores, calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import cuts, percentiles, piece, running_totals

MODERATE, SIGNIFICANT = 0.1, 0.25
BINS, EMPTY = 10, 1e-4
MIN_REVIEWED, CALIBRATION_BINS = 5, 5
# Why history features may look drifted after a cold start.
CAVEAT = ("Counts, ages and rates read low while a replay fills an empty history; large values then show the warm-up, "
          "not a change in the population.")


def long_form(df: DataFrame, names: list[str], points: dict[str, list] | None = None) -> DataFrame:
    """(feature, value) rows of the numeric columns, NULLs kept."""
    items = []
    for n in names:
        v = F.col(n).cast("double")
        items.append(F.struct(F.lit(n).alias("feature"), v.alias("value"),
                              *([piece(v, points[n]).alias("_piece")] if points else [])))
    return df.select(F.inline(F.array(*items)))


def severity(psi: Column) -> Column:
    return F.when(psi > SIGNIFICANT, "significant").when(psi > MODERATE, "moderate").otherwise("stable")


def _psi_sum(ref: Column, cur: Column, ref_total: Column, cur_total: Column) -> Column:
    def share(n, total):
        p = n / F.greatest(total, F.lit(1))
        return F.when(n == 0, EMPTY).otherwise(p)
    p, q = share(ref, ref_total), share(cur, cur_total)
    return F.sum((q - p) * F.ln(q / p))


def psi_numeric(reference: DataFrame, current: DataFrame, names: list[str], bins: int = BINS) -> DataFrame:
    """Population stability index per numeric feature.

    Bin edges are the reference deciles with equal ones merged; the last bin is
    closed on the right, values outside the reference range are left out, NULL
    is a bin of its own and a constant reference is one narrow bin."""
    points = dict(zip(names, cuts(reference, names, 16)))
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    at = percentiles(long_form(reference, names, points), "value", probs, ("feature",))
    merged = F.array_distinct(F.array_sort(F.array(*probs)))
    one = F.array(F.col("q0") - 1e-9, F.col("q0") + 1e-9)
    edges = at.select("feature", F.when(F.size(merged) < 2, one).otherwise(merged).alias("edges"))

    # the edge table has one row per feature
    rows = long_form(reference, names).withColumn("ref", F.lit(1)).unionByName(
        long_form(current, names).withColumn("ref", F.lit(0))).join(F.broadcast(edges), "feature", "left")
    v, last = F.col("value"), F.element_at("edges", -1)
    inner = F.size(F.filter("edges", lambda e: e <= v))
    bin_ = (F.when(v.isNull(), -1).when((v < F.col("edges")[0]) | (v > last), None)
            .otherwise(F.least(inner, F.size("edges") - 1)))
    counts = rows.where(F.col("edges").isNotNull()).groupBy("feature", "edges", bin_.alias("bin")).agg(
        F.sum("ref").alias("r"), F.sum(1 - F.col("ref")).alias("c")).where("bin is not null")
    size = F.size("edges") - 1
    slots = edges.select("feature", F.explode(F.concat(F.array(F.lit(-1)), F.sequence(F.lit(1), size))).alias("bin"))
    dense = slots.join(counts.drop("edges"), ["feature", "bin"], "left").fillna(0, ["r", "c"])
    total = W.partitionBy("feature")        # at most 11 rows per feature
    dense = dense.withColumn("rt", F.sum("r").over(total)).withColumn("ct", F.sum("c").over(total))
    found = dense.groupBy("feature").agg(_psi_sum(F.col("r"), F.col("c"), F.col("rt"), F.col("ct")).alias("psi"))
    every = reference.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    return every.join(found, "feature", "left").fillna(0.0, ["psi"])


def psi_categorical(reference: DataFrame, current: DataFrame, name: str) -> DataFrame:
    """The index over the union of both sides' categories."""
    r = reference.groupBy(F.col(name).cast("string").alias("v")).agg(F.count("*").alias("r"))
    c = current.groupBy(F.col(name).cast("string").alias("v")).agg(F.count("*").alias("c"))
    both = r.join(c, r.v.eqNullSafe(c.v), "full_outer").select(
        F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"))
    total = both.agg(F.sum("r").alias("rt"), F.sum("c").alias("ct"))
    return both.crossJoin(F.broadcast(total)).agg(
        F.coalesce(_psi_sum(F.col("r"), F.col("c"), F.col("rt"), F.col("ct")), F.lit(0.0)).alias("psi")).select(
        F.lit(name).alias("feature"), "psi")


def feature_drift(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    parts = [psi_numeric(reference, current, numeric)] + [psi_categorical(reference, current, c) for c in categorical]
    return reduce(DataFrame.unionByName, parts).withColumn("severity", severity(F.col("psi"))).withColumn(
        "caveat", F.lit(CAVEAT))


def top_drifted(drift: DataFrame, k: int = 10) -> DataFrame:
    return drift.orderBy(F.desc("psi"), "feature").limit(k)


def score_drift(reference: DataFrame, current: DataFrame, score="score", alpha: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic with its asymptotic p-value."""
    both = reference.select(F.col(score).alias("v"), F.lit(1).alias("a")).unionByName(
        current.select(F.col(score).alias("v"), F.lit(0).alias("a")))
    at = running_totals(both, "v", {"r": F.col("a"), "c": 1 - F.col("a")})
    size = both.where("v is not null").agg(F.sum("a").alias("n_reference"), F.sum(1 - F.col("a")).alias("n_recent"))
    at = at.crossJoin(F.broadcast(size))
    gap = F.abs((F.col("r_before") + F.col("r")) / F.col("n_reference") - (F.col("c_before") + F.col("c")) / F.col("n_recent"))
    out = at.groupBy("n_reference", "n_recent").agg(F.max(gap).alias("ks_statistic"))
    n = F.col("n_reference") * F.col("n_recent") / (F.col("n_reference") + F.col("n_recent"))
    x = F.sqrt(n) * F.col("ks_statistic")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(
        k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    p = F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return out.withColumn("ks_pvalue", p).withColumn("significant_drift", F.col("ks_pvalue") < alpha)


def reviewed_calibration(decisions: DataFrame, labels: DataFrame, since) -> DataFrame:
    """Predicted score against confirmed fraud share per score bin, reviewed
    cases with a definite disposition only; empty below five of them. Only
    alerted and reviewed payments appear, so it says nothing about the rest."""
    at = F.col("scored_at") >= F.lit(since).cast("timestamp")
    cases = decisions.where(at).select("id", F.col("risk_score").alias("score")).join(
        labels.where(F.col("disposition") != "UNCLEAR").select(
            F.col("decision_id").alias("id"), (F.col("disposition") == "CONFIRMED_FRAUD").cast("int").alias("hit")), "id")
    probs = {f"q{i}": i / CALIBRATION_BINS for i in range(CALIBRATION_BINS + 1)}
    edges = percentiles(cases.select("score"), "score", probs).select(
        "n", F.array_distinct(F.array_sort(F.array(*probs))).alias("edges")).where(F.col("n") >= MIN_REVIEWED)
    rows = cases.crossJoin(F.broadcast(edges))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    bin_ = F.size(F.filter(inner, lambda e: e <= F.col("score")))
    return rows.groupBy(bin_.cast("long").alias("bin")).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_predicted_score"),
        F.avg(F.col("hit").cast("double")).alias("empirical_fraud_rate"))


def calibration_gap(bins: DataFrame) -> DataFrame:
    return bins.agg(F.avg(F.abs(F.col("mean_predicted_score") - F.col("empirical_fraud_rate")))
                    .alias("mean_abs_calibration_error"), F.sum("n").alias("n_reviewed"))


def action_mix_by_day(decisions: DataFrame, since) -> DataFrame:
    return (decisions.where(F.col("scored_at") >= F.lit(since).cast("timestamp"))
            .groupBy(F.date_trunc("day", "scored_at").alias("day"), "action").agg(F.count("*").alias("n"))
            .orderBy("day", "action"))


def recent(decisions: DataFrame, days: int = 30, now=None) -> DataFrame:
    """Decisions of the last `days` days; fails when there are none."""
    now = decisions.agg(F.max("scored_at")).first()[0] if now is None else now
    start = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    out = decisions.where(F.col("scored_at") >= start)
    if out.isEmpty():
        raise ValueError(f"no decisions in the last {days} day(s)")
    return out
