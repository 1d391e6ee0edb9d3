"""Search for cost-optimal thresholds over binned scores.

Scores fall onto the candidate grid once (one map-side combined aggregate, at
most 201 bins per route); the three passes then read sums over those bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.policy import FALSE_ALARM, TIERS

STEP, LAST = 0.005, 200
MAX_ALERT_SHARE = 0.02
COLD_STRICTNESS = 1.15


def grid_bin(score: Column) -> Column:
    """Index of the highest candidate at or below the score."""
    b = F.floor(score / STEP)
    up, down = (b + 1) * STEP <= score, b * STEP > score
    return F.least(F.greatest(F.when(up, b + 1).when(down, b - 1).otherwise(b), F.lit(0)), F.lit(LAST)).cast("int")


def binned(df: DataFrame, route="route", score="score", label="label", amount="amount") -> DataFrame:
    """Per route and bin: rows, genuine rows and fraud value (dense grid)."""
    fraud = F.col(label) == 1
    got = df.groupBy(route, grid_bin(F.col(score)).alias("bin")).agg(
        F.count("*").alias("n"), F.count_if(~fraud).alias("legit"),
        F.sum(F.when(fraud, F.col(amount)).otherwise(0.0)).alias("value"))
    grid = got.select(route).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(LAST))))
    return _held(grid.join(got, [route, "bin"], "left").fillna(0, ["n", "legit", "value"]))


def _held(small: DataFrame) -> DataFrame:
    """Keep a table of at most 201 bins per route on the driver, so that the
    passes over it never scan the scored rows again."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def _with_sums(bins: DataFrame, route: str) -> DataFrame:
    below = W.partitionBy(route).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy(route).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    zero = F.lit(0.0)
    return bins.select(
        route, "bin", (F.col("bin") * STEP).alias("t"),
        *[F.coalesce(F.sum(c).over(below), zero).alias(f"{c}_below") for c in ("n", "legit", "value")],
        *[F.sum(c).over(above).alias(f"{c}_above") for c in ("n", "legit", "value")])


def _best(curve: DataFrame, route: str, name: str, order=("cost", "bin")) -> DataFrame:
    pick = curve.groupBy(route).agg(F.min_by(F.struct("bin", "t", "cost"), F.struct(*order)).alias("b"))
    return pick.select(route, F.col("b.bin").alias(f"{name}_bin"), F.col("b.t").alias(name),
                       F.col("b.cost").alias(f"{name}_cost"))


def review_curve(sums: DataFrame, route="route", max_share=MAX_ALERT_SHARE) -> DataFrame:
    """Cost of each review threshold: below it allowed, above it reviewed."""
    cost = F.col("value_below") - F.col("value_above") + FALSE_ALARM["REVIEW"] * F.col("legit_above")
    share = F.col("n_above") / (F.col("n_above") + F.col("n_below"))
    return sums.withColumn("cost", cost).withColumn("valid", share <= max_share)


def sweep_review(sums: DataFrame, route="route", max_share=MAX_ALERT_SHARE) -> DataFrame:
    """Cheapest threshold within the alert cap; where none fits, the cheapest of
    those with the fewest alerts."""
    at = review_curve(sums, route, max_share)
    at = at.withColumn("over", F.when(F.col("valid"), 0.0).otherwise(F.col("n_above").cast("double")))
    return _best(at, route, "t_review", ("over", "cost", "bin"))


def sweep_block(sums: DataFrame, review: DataFrame, route="route") -> DataFrame:
    """Cheapest block threshold above the review threshold (1.0 if none)."""
    at = sums.join(F.broadcast(review), route)
    edge = at.where(F.col("bin") == F.least(F.col("t_review_bin"), F.lit(LAST))).select(
        route, F.col("legit_above").alias("legit_r"), F.col("value_above").alias("value_r"),
        F.col("value_below").alias("value_b"))
    at = at.join(F.broadcast(edge), route).where(
        (F.col("bin") > F.col("t_review_bin")) | ((F.col("t_review_bin") == LAST) & (F.col("bin") == LAST)))
    reviewed = F.col("legit_r") - F.col("legit_above")
    cost = (F.col("value_b") - F.col("value_r") + FALSE_ALARM["REVIEW"] * reviewed
            + FALSE_ALARM["BLOCK"] * F.col("legit_above"))
    return review.join(_best(at.withColumn("cost", cost), route, "t_block"), route)


def sweep_warn(sums: DataFrame, chosen: DataFrame, route="route") -> DataFrame:
    """Cheapest warn threshold below the review threshold (0.0 if none)."""
    at = sums.join(F.broadcast(chosen), route)
    marks = at.groupBy(route).agg(
        F.max(F.when(F.col("bin") == F.col("t_review_bin"), F.col("legit_above"))).alias("legit_r"),
        F.max(F.when(F.col("bin") == F.col("t_block_bin"), F.col("legit_above"))).alias("legit_b"))
    at = at.join(F.broadcast(marks), route).where(
        (F.col("bin") < F.col("t_review_bin")) | ((F.col("t_review_bin") == 0) & (F.col("bin") == 0)))
    warned = F.greatest(F.col("legit_above") - F.col("legit_r"), F.lit(0))
    cost = (F.col("value_below") - F.col("value_above") + FALSE_ALARM["WARN"] * warned
            + FALSE_ALARM["REVIEW"] * (F.col("legit_r") - F.col("legit_b")) + FALSE_ALARM["BLOCK"] * F.col("legit_b"))
    return chosen.join(_best(at.withColumn("cost", cost), route, "t_warn"), route)


def optimize(df: DataFrame, route="route", **cols) -> DataFrame:
    """Review, then block, then warn threshold per route, one row each."""
    sums = _with_sums(binned(df, route, **cols), route)
    got = sweep_warn(sums, sweep_block(sums, sweep_review(sums, route), route), route)
    return got.select(route, *TIERS, F.col("t_warn_cost").alias("expected_cost"))


def stricter_cold(chosen: DataFrame, route="route") -> DataFrame:
    """Lift cold thresholds to at least the warm ones: times 1.15, capped at 1,
    re-sorted, only where some cold threshold is below its warm one."""
    warm = chosen.where(F.col(route) == "warm").select(*[F.col(t).alias(f"w_{t}") for t in TIERS])
    both = chosen.crossJoin(F.broadcast(warm))
    low = (F.col(route) == "cold") & (F.greatest(*[F.col(f"w_{t}") - F.col(t) for t in TIERS]) > 0)
    lifted = F.array_sort(F.array(*[
        F.least(F.lit(1.0), F.greatest(F.col(t) * COLD_STRICTNESS, F.col(f"w_{t}"))) for t in TIERS]))
    return both.select(route, *[F.when(low, lifted[i]).otherwise(F.col(t)).alias(t) for i, t in enumerate(TIERS)],
                       "expected_cost", low.alias("multiplier_applied"))


def as_thresholds(chosen: DataFrame, route="route") -> policy.Thresholds:
    """The two-row result as a plain document, checked for cold >= warm."""
    out = {r[route]: {t: r[t] for t in TIERS} for r in chosen.collect()}
    if {"cold", "warm"} <= set(out):
        assert all(out["cold"][t] >= out["warm"][t] for t in TIERS), out
    return out


def naive_cost(df: DataFrame, cutoff: float = 0.5, score="score", label="label", amount="amount") -> DataFrame:
    act = F.when(F.col(score) >= cutoff, "BLOCK").otherwise("ALLOW")
    return df.agg(F.sum(policy.cost(act, F.col(label) == 1, F.col(amount))).alias("cost"))


def operating_point(df: DataFrame, action: str = "action", label="label", amount="amount", groups=()) -> DataFrame:
    """Rates, recall, cost and friction of the actions taken."""
    act, fraud = F.col(action), F.col(label) == 1
    alert = act != "ALLOW"
    fee = F.when(~fraud, policy.cost(act, F.lit(False), F.col(amount))).otherwise(0.0)
    s = df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.count_if(alert).alias("alerts"), F.count_if(act.isin("REVIEW", "BLOCK")).alias("rb"),
        F.count_if(alert & fraud).alias("hits"), F.count_if(fraud).alias("frauds"),
        F.sum(F.when(fraud, F.col(amount)).otherwise(0.0)).alias("value"),
        F.sum(F.when(fraud & alert, F.col(amount)).otherwise(0.0)).alias("prevented_loss"),
        F.sum(policy.cost(act, fraud, F.col(amount))).alias("expected_cost"), F.sum(fee).alias("friction_cost"))

    def share(a, b):
        return F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(0.0)

    return s.select(
        *groups, share("alerts", "n").alias("alert_rate"), share("rb", "n").alias("review_block_rate"),
        share("hits", "alerts").alias("precision"), share("hits", "frauds").alias("recall"),
        share("prevented_loss", "value").alias("amount_weighted_recall"), "expected_cost", "prevented_loss",
        "friction_cost")


def threshold_curve(df: DataFrame, chosen: DataFrame, route="route", max_share=MAX_ALERT_SHARE, **cols) -> DataFrame:
    """Operating points at every fourth review candidate within the alert cap.

    Candidates and the chosen thresholds all lie on the grid, so the points are
    read from the bins and no row meets a candidate."""
    bins = binned(df, route, **cols)
    fraud_n = bins.withColumn("frauds", F.col("n") - F.col("legit"))
    valid = review_curve(_with_sums(bins, route), route, max_share).where("valid AND bin % 4 = 0").select(
        route, F.col("bin").alias("review_bin"), F.col("t").alias("t_review"))
    picks = F.broadcast(chosen.select(route, *[grid_bin(F.col(t)).alias(f"{t}_g") for t in TIERS]))
    points = valid.join(picks, route).select(
        route, "review_bin", "t_review", F.least("t_warn_g", "review_bin").alias("warn_bin"),
        F.greatest("t_block_g", "review_bin").alias("block_bin"))
    each = fraud_n.join(F.broadcast(points), route)      # 201 bins by at most 51 candidates per route
    act = policy.action_at(F.col("bin"), F.col("warn_bin"), F.col("review_bin"), F.col("block_bin"))
    alert = act != "ALLOW"
    fee = F.lit(0.0)
    for name, f in FALSE_ALARM.items():
        fee = F.when(act == name, F.col("legit") * f).otherwise(fee)
    s = each.groupBy(route, "t_review").agg(
        F.sum("n").alias("n"), F.sum(F.when(alert, F.col("n")).otherwise(0)).alias("alerts"),
        F.sum(F.when(act.isin("REVIEW", "BLOCK"), F.col("n")).otherwise(0)).alias("rb"),
        F.sum(F.when(alert, F.col("frauds")).otherwise(0)).alias("hits"), F.sum("frauds").alias("frauds"),
        F.sum("value").alias("value"), F.sum(F.when(alert, F.col("value")).otherwise(0.0)).alias("prevented_loss"),
        F.sum(fee).alias("friction_cost"))

    def share(a, b):
        return F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(0.0)

    missed = F.col("value") - F.col("prevented_loss")
    return s.select(
        route, "t_review", share("alerts", "n").alias("alert_rate"), share("rb", "n").alias("review_block_rate"),
        share("hits", "alerts").alias("precision"), share("hits", "frauds").alias("recall"),
        share("prevented_loss", "value").alias("amount_weighted_recall"),
        (missed - F.col("prevented_loss") + F.col("friction_cost")).alias("expected_cost"), "prevented_loss",
        "friction_cost")


def policy_report(df: DataFrame, thresholds: policy.Thresholds, cutoff: float = 0.5) -> DataFrame:
    """Chosen thresholds against the naive cutoff on scored, labelled rows."""
    acted = df.withColumn("action", policy.action(F.col("score"), F.col("is_cold"), thresholds))
    chosen = operating_point(acted).select(
        F.col("expected_cost").alias("chosen_cost"), "alert_rate", "precision", "amount_weighted_recall")
    return chosen.crossJoin(naive_cost(df, cutoff).withColumnRenamed("cost", "naive_cost"))
