"""Evaluation of scores against labels. `label` is 0/1, `score` higher = riskier.

Every metric works per group (bootstrap replicate, feature, route) when `groups`
names columns; `weight` counts a row more than once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bootstrap import replicate_metrics
from .ranking import cuts, percentiles, piece, running_totals, smallest

ALERT_RATES = (0.01, 0.02, 0.05)


def curve(df: DataFrame, groups=(), score="score", label="label", weight: str | None = None,
          points=None, following=False) -> DataFrame:
    """Counts per distinct score, highest first: n, pos and both above it."""
    w = F.col(weight) if weight else F.lit(1)
    return running_totals(df, score, {"n": w, "pos": w * F.col(label).cast("long")}, tuple(groups),
                          descending=True, points=points, following=following)


def _totals(points: DataFrame, groups) -> DataFrame:
    return points.groupBy(*groups).agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))


def rank_metrics(df: DataFrame, groups=(), score="score", label="label", weight=None, points=None) -> DataFrame:
    """PR-AUC (average precision) and ROC-AUC per group; NULL with one class only."""
    at = curve(df, groups, score, label, weight, points)
    hits = F.col("pos_before") + F.col("pos")
    seen = F.col("n_before") + F.col("n")
    neg = F.col("n") - F.col("pos")
    agg = at.groupBy(*groups).agg(
        F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"),
        F.sum(F.col("pos") * hits / seen).alias("ap"),
        F.sum(neg * (F.col("pos_before") + F.col("pos") / 2)).alias("pairs"))
    both = (F.col("all_pos") > 0) & (F.col("all_n") > F.col("all_pos"))
    return agg.select(*groups, F.col("all_n").alias("n_events"), F.col("all_pos").alias("n_positives"),
                      F.when(F.col("all_pos") > 0, F.col("ap") / F.col("all_pos")).alias("pr_auc"),
                      F.when(both, F.col("pairs") / (F.col("all_pos") * (F.col("all_n") - F.col("all_pos")))).alias("roc_auc"))


def pr_auc(df, **kw) -> DataFrame:
    return rank_metrics(df, **kw).drop("roc_auc")


def recall_at_fpr(df: DataFrame, target: float = 0.01, score="score", label="label") -> DataFrame:
    """Largest recall at a false positive rate within the target, over the
    corner points of the ROC curve (points inside a straight run are skipped,
    as the usual curve routine does)."""
    at = curve(df, score=score, label=label, following=True)
    neg, neg_next = F.col("n") - F.col("pos"), F.col("n_next") - F.col("pos_next")
    first, last = F.col("n_before") == 0, F.col("n_next").isNull()
    corner = first | last | (F.col("pos") != F.col("pos_next")) | (neg != neg_next)
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("n_before") + F.col("n") - tp
    at = at.crossJoin(F.broadcast(_totals(at, ())))
    inside = corner & (fp / (F.col("all_n") - F.col("all_pos")) <= target)
    return at.agg(F.coalesce(F.max(F.when(inside, tp / F.col("all_pos"))), F.lit(0.0)).alias("recall"))


def alerts_for(n: int, rate: float) -> int:
    return max(1, round(n * rate))


def caught(df: DataFrame, rates=ALERT_RATES, score="score", key="txn_id") -> DataFrame:
    """Flag the top share of scores per rate as `caught_0`, `caught_1`, ...

    Exactly max(1, round(n * rate)) rows each; ties at the cut go by key."""
    at = running_totals(df, score, {"n": F.lit(1)}, descending=True)
    total = df.where(F.col(score).isNotNull()).count()
    want = [alerts_for(total, r) for r in rates]
    cut = at.where(reduce(Column.__or__, [
        (F.col("n_before") < k) & (k <= F.col("n_before") + F.col("n")) for k in want])).collect()
    out = df
    for i, k in enumerate(want):
        edge = next(c for c in cut if c["n_before"] < k <= c["n_before"] + c["n"])
        take, tied = k - edge["n_before"], edge["n"]
        above, level = F.col(score) > edge[score], F.col(score) == edge[score]
        if take == tied:
            out = out.withColumn(f"caught_{i}", above | level)
        else:
            picked = smallest(df.where(level).select(key), key, take, tied).withColumn(f"_t{i}", F.lit(True))
            out = (out.join(picked, key, "left")
                   .withColumn(f"caught_{i}", above | (level & F.coalesce(F.col(f"_t{i}"), F.lit(False))))
                   .drop(f"_t{i}"))
    return out


def alert_metrics(df: DataFrame, rates=ALERT_RATES, score="score", label="label", amount="amount") -> DataFrame:
    """Precision and share of fraud value caught, one row per alert rate."""
    flagged = caught(df, rates, score)
    fraud = F.col(label) == 1
    value = F.coalesce(F.sum(F.when(fraud, F.col(amount))), F.lit(0.0)).alias("value")
    parts = [value]
    for i in range(len(rates)):
        c = F.col(f"caught_{i}")
        parts += [F.sum(F.when(c, 1).otherwise(0)).alias(f"n{i}"),
                  F.sum(F.when(c & fraud, 1).otherwise(0)).alias(f"h{i}"),
                  F.sum(F.when(c & fraud, F.col(amount)).otherwise(0.0)).alias(f"v{i}")]
    one = flagged.agg(*parts)
    return one.select("value", F.inline(F.array(*[F.struct(
        F.lit(float(r)).alias("rate"), F.col(f"n{i}").alias("n_alerts"), F.col(f"h{i}").alias("hits"),
        F.col(f"v{i}").alias("saved")) for i, r in enumerate(rates)]))).select(
        "rate", "n_alerts", (F.col("hits") / F.col("n_alerts")).alias("precision"),
        F.when(F.col("value") != 0, F.col("saved") / F.col("value")).alias("amount_weighted_recall"))


def typology_recall(df: DataFrame, rates=ALERT_RATES, score="score", label="label", typology="typology") -> DataFrame:
    flagged = caught(df, rates, score).where(F.col(label) == 1)
    per = flagged.groupBy(typology).agg(
        F.count("*").alias("n"),
        *[F.sum(F.when(F.col(f"caught_{i}"), 1).otherwise(0)).alias(f"h{i}") for i in range(len(rates))])
    return per.select(typology, "n", F.inline(F.array(*[
        F.struct(F.lit(float(r)).alias("rate"), F.col(f"h{i}").alias("hits")) for i, r in enumerate(rates)]))).select(
        "rate", typology, "n", (F.col("hits") / F.col("n")).alias("recall"))


def brier(df: DataFrame, score="score", label="label") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"))


def _bins(df: DataFrame, bins: int, score, label) -> DataFrame:
    inside = reduce(Column.__add__, [F.when(F.col(score) > i / bins, 1).otherwise(0) for i in range(1, bins)])
    return df.groupBy(inside.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(F.col(label).cast("double")).alias("observed"))


def calibration_error(df: DataFrame, bins: int = 10, score="score", label="label") -> DataFrame:
    b = _bins(df, bins, score, label)
    gap = F.abs(F.col("observed") - F.col("predicted"))
    return b.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, bins: int = 10, score="score", label="label") -> DataFrame:
    return _bins(df, bins, score, label)


def bootstrap_pr_auc(df: DataFrame, count: int = 1000, score="score", label="label", seed: int = 42) -> DataFrame:
    """PR-AUC with its 95 % bootstrap interval."""
    draws = replicate_metrics(df, count, score=score, label=label, seed=seed)
    return _interval(rank_metrics(df, score=score, label=label).select("pr_auc"), draws, "pr_auc")


def bootstrap_value_recall(df: DataFrame, rate: float = 0.01, count: int = 1000, score="score", label="label",
                           amount="amount", seed: int = 42) -> DataFrame:
    """Amount-weighted recall at a rate with its 95 % bootstrap interval. Rows
    of one score enter a replicate's cut in proportion to their share."""
    draws = replicate_metrics(df, count, rate, score, label, amount, seed)
    point = alert_metrics(df, (rate,), score, label, amount).select("amount_weighted_recall")
    return _interval(point, draws, "amount_weighted_recall")


def _interval(point: DataFrame, draws: DataFrame, name: str) -> DataFrame:
    # one row per replicate: small by construction
    span = draws.agg(F.expr(f"percentile({name}, array(0.025, 0.975))").alias("q"))
    out = point.crossJoin(span).select(name, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
    return out.withColumn("text", F.format_string("%.2f [%.2f-%.2f]", name, "ci_low", "ci_high"))


def confusion(df: DataFrame, groups=(), predicted="predicted", label="label", positive="Y") -> DataFrame:
    """Counts and the ratios built on them; ratios are 0 where undefined."""
    yes, truth = F.col(predicted) == positive, F.col(label) == positive
    c = df.groupBy(*groups).agg(
        F.count_if(yes & truth).alias("true_positive"), F.count_if(yes & ~truth).alias("false_positive"),
        F.count_if(~yes & truth).alias("false_negative"), F.count_if(~yes & ~truth).alias("true_negative"))
    tp, fp, fn, tn = (F.col(x) for x in ("true_positive", "false_positive", "false_negative", "true_negative"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    return c.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
                    ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def cell_counts(df: DataFrame, label="label_is_fraud") -> DataFrame:
    return df.groupBy("split", "is_cold").agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))


def feature_auc(df: DataFrame, numeric: list[str], categorical: list[str], label="label",
                limit: float = 0.85) -> DataFrame:
    """ROC-AUC of every feature on its own, in one job; `leaks` above the limit.

    Numeric features count in either direction and skip NULLs; a category is
    scored by its share of positives."""
    points = dict(zip(numeric, cuts(df, numeric, 16)))
    rows = df.select(F.col(label).alias("label"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"),
                 piece(F.col(n).cast("double"), points[n]).alias("_piece")) for n in numeric])))
    for c in categorical:
        rate = df.groupBy(c).agg(F.avg(F.col(label).cast("double")).alias("value"), F.count("*").alias("n"),
                                 F.sum(F.col(label).cast("long")).alias("pos"))
        spread = rate.select(F.lit(c).alias("feature"), "value", F.lit(0).alias("_piece"), F.inline(F.array(
            F.struct(F.lit(1).cast("long").alias("label"), F.col("pos").alias("w")),
            F.struct(F.lit(0).cast("long").alias("label"), (F.col("n") - F.col("pos")).alias("w")))))
        rows = rows.withColumn("w", F.lit(1).cast("long")) if "w" not in rows.columns else rows
        rows = rows.unionByName(spread)
    if "w" not in rows.columns:
        rows = rows.withColumn("w", F.lit(1).cast("long"))
    auc = rank_metrics(rows, ("feature",), "value", "label", "w")
    raw = F.coalesce(F.col("roc_auc"), F.lit(0.5))
    best = F.when(F.col("feature").isin(categorical), raw).otherwise(F.greatest(raw, 1 - raw))
    return auc.select("feature", best.alias("auc"), (best > limit).alias("leaks"))


def event_summary(events: DataFrame) -> DataFrame:
    """Counts, fraud share, parties and date range of an event set."""
    fraud = F.col("label_is_fraud")
    return events.agg(
        F.count("*").alias("event_count"), F.avg(fraud.cast("double")).alias("fraud_rate"),
        F.count_if(fraud).alias("fraud_event_count"), F.count_distinct("payer_vpa").alias("unique_payers"),
        F.count_distinct("payee_vpa").alias("unique_payees"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def typology_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("label_typology", F.lit("legit")).alias("typology")).agg(F.count("*").alias("n"))


def score_only(df: DataFrame, score="score", label="label") -> DataFrame:
    """Rank metrics of a bare score, as one row per alert rate."""
    return alert_metrics(df, score=score, label=label).crossJoin(F.broadcast(rank_metrics(df, score=score, label=label)))




def rolling_payers_by_class(events: DataFrame, per_payee: DataFrame) -> DataFrame:
    """Median and 95th percentile of the payees' largest rolling fan-in, for
    payees seen in mule fan-in rows and for payees seen in genuine rows."""
    classes = events.where(F.col("label_typology").isin("MULE_FANIN", "legit")).select(
        "payee_vpa", F.col("label_typology").alias("class")).distinct()
    return percentiles(classes.join(per_payee, "payee_vpa"), "most_payers", {"median": 0.5, "p95": 0.95}, ("class",))


def new_payees_by_window(events: DataFrame, days: int, size: int = 10) -> DataFrame:
    """Genuine payees by the window of days (from day 1) of their first
    appearance; windows without any are kept with 0."""
    first = events.where("label_typology = 'legit'").groupBy("payee_vpa").agg(F.min("ts").alias("first_ts"))
    start = events.agg(F.min("ts").alias("_start"))
    day = F.floor((F.unix_micros("first_ts") - F.unix_micros("_start")) / 86_400_000_000)
    got = first.crossJoin(F.broadcast(start)).select(day.alias("day")).where((F.col("day") >= 1) & (F.col("day") < days))
    got = got.groupBy(F.floor((F.col("day") - 1) / size).alias("window")).agg(F.count("*").alias("new_payees"))
    count = max(1, -(-(days - 1) // size))
    every = events.sparkSession.range(count).select(F.col("id").alias("window"), (F.col("id") * size + 1).alias("first_day"),
                                                    F.least(F.col("id") * size + size, F.lit(days - 1)).alias("last_day"))
    return every.join(got, "window", "left").fillna(0, ["new_payees"])
