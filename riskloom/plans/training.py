"""From labelled feature rows to models, thresholds and an evaluation table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.registry import ALL_FEATURES, COLD_FEATURES
from ..operators import metrics as mx
from ..operators import model as md
from ..operators import thresholds as th
from ..operators.frames import (MIN_POSITIVES, TEST_DAYS, TRAIN_DAYS, VAL_DAYS, assert_in_time, for_training,
                                require_positives, split_by_day)
from ..session import materialize

WARM_PR_AUC_MIN = 0.75


@dataclass
class Fitted:
    models: dict[str, md.RouteModel]
    thresholds: policy.Thresholds
    rows: DataFrame                 # feature rows with their split
    scored_test: DataFrame
    cells: DataFrame


@dataclass
class Trained(Fitted):
    metrics: DataFrame = None
    ablation: md.RouteModel | None = None


def _scored(model: md.RouteModel, rows: DataFrame) -> DataFrame:
    return md.predict(model, rows).withColumn("score", F.col("risk_score")).withColumn(
        "label", F.col("label_is_fraud").cast("int")).withColumn("typology", F.col("label_typology"))


def long_table(name: str, wide: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(model, metric, at, value) rows of a metrics frame."""
    at = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    values = [c for c in wide.columns if c not in keys]
    return wide.select(F.lit(name).alias("model"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), at.alias("at"), F.col(c).cast("double").alias("value")) for c in values])))


def evaluate(name: str, scored: DataFrame, bootstrap: int = 0, calibrated: bool = True) -> DataFrame:
    """Every metric of one scored, labelled test set as a long table."""
    parts = [long_table(name, mx.rank_metrics(scored)), long_table(name, mx.recall_at_fpr(scored)),
             long_table(name, mx.alert_metrics(scored), ("rate",)),
             long_table(name, mx.typology_recall(scored), ("rate", "typology"))]
    if calibrated:
        for kind, column in (("raw", "raw_score"), ("calibrated", "score")):
            label = f"{name}_{kind}"
            parts += [long_table(label, mx.brier(scored, score=column)),
                      long_table(label, mx.calibration_error(scored, score=column)),
                      long_table(label, mx.reliability(scored, score=column), ("bin",))]
    if bootstrap:
        parts += [long_table(f"{name}_pr_auc_ci", mx.bootstrap_pr_auc(scored, bootstrap).drop("text")),
                  long_table(f"{name}_value_recall_ci", mx.bootstrap_value_recall(scored, count=bootstrap).drop("text"))]
    return reduce(DataFrame.unionByName, parts)


def fit(features: DataFrame, train=TRAIN_DAYS, val=VAL_DAYS, test=TEST_DAYS, trees: int = md.TREES,
        min_positives: int = MIN_POSITIVES, version: str = "v1", check_leaks: bool = True) -> Fitted:
    """Split in time, train and calibrate both routes, pick thresholds on the
    validation rows and score the test rows.

    `features` is read many times: it is stored once first."""
    features = materialize(features)
    start = features.agg(F.min(F.unix_micros("ts"))).first()[0]
    rows = split_by_day(features, F.timestamp_micros(F.lit(start).cast("long")), train, val, test).where("split IS NOT NULL")
    assert_in_time(rows)
    fit_rows = for_training(rows.where("split = 'train'"))
    require_positives(fit_rows, min_positives)
    models, validated, tested = {}, [], []
    for route, cold, columns in (("cold", True, COLD_FEATURES), ("warm", False, ALL_FEATURES)):
        mine = F.col("is_cold") == F.lit(cold)
        v = rows.where((F.col("split") == "val") & mine)
        m = models[route] = md.train(fit_rows.where(mine), v, columns, trees=trees, version=f"{route}-{version}",
                                     check=check_leaks)
        validated.append(_scored(m, v).withColumn("route", F.lit(route)))
        tested.append(_scored(m, rows.where((F.col("split") == "test") & mine)))
    # the combined set is the cold and the warm rows together
    thresholds = th.as_thresholds(th.stricter_cold(th.optimize(validated[0].unionByName(validated[1]))))
    return Fitted(models, thresholds, rows, materialize(tested[0].unionByName(tested[1])), mx.cell_counts(rows))


def ablate(fitted: Fitted, trees: int = md.TREES, check_leaks: bool = True) -> tuple[md.RouteModel, DataFrame]:
    """The warm model without pair history, and the share of PR-AUC it keeps."""
    fewer = [f for f in ALL_FEATURES if f not in md.PAIR_HISTORY]
    warm = fitted.rows.where("NOT is_cold")
    m = md.train(for_training(warm.where("split = 'train'")), warm.where("split = 'val'"), fewer, trees=trees,
                 version="ablation", check=check_leaks)
    less = mx.rank_metrics(materialize(_scored(m, warm.where("split = 'test'"))))
    full = mx.rank_metrics(fitted.scored_test.where("NOT is_cold")).select(F.col("pr_auc").alias("_full"))
    return m, less.crossJoin(F.broadcast(full)).withColumn("pr_auc_retained", F.col("pr_auc") / F.col("_full")).drop("_full")


def run(features: DataFrame, train=TRAIN_DAYS, val=VAL_DAYS, test=TEST_DAYS, trees: int = md.TREES,
        min_positives: int = MIN_POSITIVES, bootstrap: int = 0, ablation: bool = False, version: str = "v1",
        check_leaks: bool = True) -> Trained:
    """`fit` plus the evaluation of every route, of both together, of the rules
    baseline and, if asked, of the ablation."""
    f = fit(features, train, val, test, trees, min_positives, version, check_leaks)
    scored = f.scored_test
    parts = [evaluate("cold", scored.where("is_cold"), bootstrap),
             evaluate("warm", scored.where("NOT is_cold"), bootstrap),
             evaluate("combined", scored, calibrated=False),
             evaluate("rules_baseline", md.rules_score(scored), calibrated=False)]
    out = Trained(f.models, f.thresholds, f.rows, scored, f.cells)
    if ablation:
        out.ablation, kept = ablate(f, trees, check_leaks)
        parts.append(long_table("ablation_no_pair_history", kept))
    out.metrics = materialize(reduce(DataFrame.unionByName, parts))
    return out


def quality_gate(metrics: DataFrame, minimum: float = WARM_PR_AUC_MIN) -> float:
    """The warm PR-AUC, or an error when it fell below the minimum."""
    got = metrics.where("model = 'warm' AND metric = 'pr_auc'").first()["value"]
    if got is None or got < minimum:
        raise ValueError(f"quality gate failed: warm PR-AUC {got} is below {minimum}")
    return got
