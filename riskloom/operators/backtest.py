"""Replay of logged decisions under other thresholds or models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..schema import ACTIONS


def sibling_versions(version: str) -> tuple[str, str]:
    """Cold and warm models trained together share what follows the prefix."""
    if "-" not in version:
        return version, version
    rest = version.split("-", 1)[1]
    return f"cold-{rest}", f"warm-{rest}"


def window(decisions: DataFrame, start, end, version: str) -> DataFrame:
    """Decisions scored in [start, end) by the version or its sibling."""
    at = F.col("scored_at")
    return decisions.where((at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp"))
                           & F.col("model_version").isin(*sibling_versions(version)))


def summarize(df: DataFrame, action="action", label="label_is_fraud", amount="amount", groups=()) -> DataFrame:
    """One row of outcome figures. Rows without a label count only as rows, in
    the action mix and as excluded."""
    act, fraud, value = F.col(action), F.col(label), F.col(amount)
    known, alert = fraud.isNotNull(), act != "ALLOW"

    def total(cond: Column, v: Column) -> Column:
        return F.sum(F.when(cond, v).otherwise(0.0))

    s = df.groupBy(*groups).agg(
        F.count("*").alias("n_rows"), F.count_if(~known).alias("n_excluded_unknown_label"),
        *[F.count_if(act == a).alias(f"n_{a.lower()}") for a in ACTIONS],
        F.count_if(fraud).alias("n_fraud_known"), F.count_if(fraud & alert).alias("n_caught"),
        F.count_if(~fraud & alert).alias("n_false_positives"),
        total(fraud, value).alias("fraud_value_total"), total(fraud & alert, value).alias("fraud_value_caught"),
        total(known, policy.cost(act, fraud, value)).alias("expected_cost"))
    alerts = F.col("n_caught") + F.col("n_false_positives")
    return s.select(
        "*",
        F.when(F.col("fraud_value_total") != 0, F.col("fraud_value_caught") / F.col("fraud_value_total"))
        .alias("amount_weighted_recall"),
        F.when(alerts > 0, F.col("n_caught") / alerts).alias("precision"))


def net_benefit_curve(df: DataFrame, thresholds: policy.Thresholds, score="risk_score", label="label_is_fraud",
                      amount="amount") -> DataFrame:
    """Net benefit for warm review thresholds 0.01, 0.03 ... 0.99; the warm warn
    and block thresholds give way where the candidate passes them. Cold rows
    keep their thresholds."""
    known = df.where(F.col(label).isNotNull())
    steps = [0.01 + 0.02 * i for i in range(50)]
    warm = thresholds["warm"]
    # A row's action changes only where the candidate passes its score, so rows
    # are summed by the candidates at or below their score first: 51 bins.
    below = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                        lambda n, s: n + F.when(s <= F.col(score), 1).otherwise(0))
    cold_cost = policy.cost(policy.action(F.col(score), F.lit(True), thresholds), F.col(label), F.col(amount))
    bins = known.groupBy("is_cold", below.alias("bin"), (F.col(score) >= warm["t_warn"]).alias("warned"),
                         (F.col(score) >= warm["t_block"]).alias("blocked")).agg(
        F.sum(F.when(F.col(label), F.col(amount)).otherwise(0.0)).alias("value"),
        F.count_if(~F.col(label)).alias("legit"), F.sum(cold_cost).alias("cold_cost"))
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("t_review")) for i, s in enumerate(steps)])
    each = bins.select("*", F.inline(grid))
    at_review = F.col("bin") > F.col("i")                       # score >= candidate
    warned = at_review & (F.col("t_review") < warm["t_warn"]) | F.col("warned")
    blocked = F.when(F.col("t_review") > warm["t_block"], at_review).otherwise(F.col("blocked"))
    act = (F.when(~warned, "ALLOW").when(~at_review, "WARN").when(~blocked, "REVIEW").otherwise("BLOCK"))
    fee = F.lit(0.0)
    for name, f in policy.FALSE_ALARM.items():
        fee = F.when(act == name, F.col("legit") * f).otherwise(fee)
    cost = F.when(F.col("is_cold"), F.col("cold_cost")).otherwise(
        fee + F.when(act == "ALLOW", F.col("value")).otherwise(-F.col("value")))
    return each.groupBy("t_review").agg(F.sum(cost).alias("expected_cost")).withColumn(
        "net_benefit", -F.col("expected_cost"))


def backtest(rescored: DataFrame, **kw) -> DataFrame:
    """Logged actions (`action`) against rescored ones (`new_action`): both
    summaries side by side and the change in net benefit."""
    a, b = summarize(rescored, "action", **kw), summarize(rescored, "new_action", **kw)
    names = a.columns
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in names])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in names])
    return left.crossJoin(right).withColumn(
        "net_benefit_delta", F.col("a_expected_cost") - F.col("b_expected_cost"))
