"""Cold and warm classifiers, calibration, scoring and reason codes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import messages, policy
from ..functions.registry import CATEGORICAL
from ..session import dealt, ship
from ..sources import legacy
from .metrics import rank_metrics
from .ranking import cuts

SEED = 42
TREES, PATIENCE = 2000, 100     # trees at most; growing stops when so many in a row bring no better average precision
FIRST_FIT = 150                 # trees of the first fit; one that ends too early is grown anew, twice as far
JUDGED_ROWS = 50_000_000        # rows times lengths of the ensemble that one pass of the judging takes
DOMINANCE = 0.50            # a feature above this share of importance is a suspected leak
GAP = -1.0                  # stands in for a missing value; its flag column tells the two apart
SOLE = "is_p2p"             # says too little to be shown alone
TOP_REASONS = 5
ALERTS_PER_TASK = 10_000    # each becomes a row per feature
# The pair-history features left out of the ablation model.
PAIR_HISTORY = ("days_since_payer_last_paid_payee", "days_since_payer_last_paid_payee_is_missing",
                "payer_payee_txn_count")


@dataclass
class RouteModel:
    features: list[str]
    trees: GBTClassificationModel
    calibrator: IsotonicRegressionModel
    baseline: list[float]           # typical genuine value per feature
    version: str = "v1"

    def save(self, path: str, spark: SparkSession) -> None:
        self.trees.write().overwrite().save(f"{path}/trees")
        self.calibrator.write().overwrite().save(f"{path}/calibrator")
        spark.createDataFrame([(self.features, self.baseline, self.version)],
                              "features array<string>, baseline array<double>, version string"
                              ).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "RouteModel":
        about = spark.read.schema("features array<string>, baseline array<double>, version string"
                                  ).json(f"{path}/about").first()
        return cls(about["features"], GBTClassificationModel.load(f"{path}/trees"),
                   IsotonicRegressionModel.load(f"{path}/calibrator"), about["baseline"], about["version"])


def feature_array(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """The model's inputs as one array column, gaps filled."""
    values = []
    for n in columns:
        c = F.col(n)
        if n in CATEGORICAL:
            c = F.array_position(F.array(*[F.lit(v) for v in CATEGORICAL[n]]), c) - 1
        values.append(F.coalesce(c.cast("double"), F.lit(GAP)))
    return df.withColumn(out, F.array(*values))


def _vector(df: DataFrame, columns: list[str]) -> DataFrame:
    return feature_array(df, columns, "_x").withColumn("_v", array_to_vector("_x")).drop("_x")


def train(train_rows: DataFrame, val_rows: DataFrame, columns: list[str], label: str = "label_is_fraud",
          trees: int = TREES, version: str = "v1", check: bool = True) -> RouteModel:
    """Boosted trees with positives weighted by the class ratio, as many of them
    as rank the validation rows best, then isotonic calibration on those rows."""
    y = F.col(label).cast("double")
    counts = train_rows.agg(F.sum(y).alias("pos"), F.count("*").alias("n")).first()
    pos = counts["pos"] or 0.0
    weight = (counts["n"] - pos) / pos if pos else 1.0
    both = train_rows.select(*columns, y.alias("y"), F.lit(False).alias("held_out")).unionByName(
        val_rows.select(*columns, y.alias("y"), F.lit(True).alias("held_out")))
    both = _vector(both, columns).select(
        "_v", "y", "held_out", F.when(F.col("y") == 1, weight).otherwise(1.0).alias("weight")).persist()
    try:
        gbt = GBTClassifier(featuresCol="_v", labelCol="y", weightCol="weight", maxDepth=6, stepSize=0.05,
                            subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=50, seed=SEED)
        fitted = grow(gbt, both.where("NOT held_out"), both.where("held_out"), trees)
        if check:
            check_dominance(fitted, columns)
        scored = both.where("held_out").select("_v", "y")
        calibrator = calibrate(_raw(fitted, scored).select("raw_score", "y"), "y")
        genuine = both.where("NOT held_out AND y = 0").select(vector_to_array("_v").alias("x"))
        mean = genuine.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(columns))]).first()
    finally:
        both.unpersist()
    return RouteModel(list(columns), fitted, calibrator, [float(v or 0.0) for v in mean], version)


def grow(gbt: GBTClassifier, train_rows: DataFrame, val_rows: DataFrame, trees: int) -> GBTClassificationModel:
    """Up to `trees` trees, of which the first stay, up to the one after which the average precision on the validation rows
    is highest. Without a positive there, every length ranks alike and the first stays."""
    n = min(trees, FIRST_FIT)
    while True:
        fitted = gbt.copy({gbt.maxIter: n}).fit(train_rows)
        best, stopped = chosen_length(average_precisions(fitted, val_rows))
        if stopped or n == trees:
            return first_trees(fitted, best)
        n = min(trees, 2 * n)


def chosen_length(precisions: list[float]) -> tuple[int, bool]:
    """The length with the highest value, the shortest of equal ones, and whether PATIENCE more trees stayed below it."""
    best = 0
    for k, value in enumerate(precisions):
        if value > precisions[best]:
            best = k
        elif k - best >= PATIENCE:
            return best + 1, True
    return best + 1, False


def first_trees(fitted: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first `n` trees of a fit."""
    if n >= fitted.getNumTrees:
        return fitted
    java, sc = fitted._java_obj, SparkSession.active().sparkContext
    kept = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    trees = java.trees()
    for i in range(n):
        kept[i], weights[i] = trees[i], fitted.treeWeights[i]
    short = GBTClassificationModel(sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        fitted.uid, kept, weights, fitted.numFeatures, fitted.numClasses))
    return short.setFeaturesCol(fitted.getFeaturesCol())


def leaf_values(fitted: GBTClassificationModel) -> np.ndarray:
    """What each leaf adds to the margin: a row per tree, its leaves in the order of their indices."""
    found = [[w * float(v) for v in re.findall(r"Predict: (\S+)", t.toDebugString)]
             for t, w in zip(fitted.trees, fitted.treeWeights)]
    out = np.zeros((len(found), max(map(len, found))))
    for i, values in enumerate(found):
        out[i, :len(values)] = values
    return out


def _margins(values: np.ndarray, low: int, high: int):
    """(n, score, label): the margin of each row after n trees, low < n <= high."""
    trees = np.arange(high)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                leaves = np.asarray(part.column(0).flatten()).reshape(part.num_rows, -1)[:, :high].astype(np.int64)
                score = np.cumsum(values[trees, leaves], axis=1)[:, low:]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(low + 1, high + 1, dtype=np.int32), part.num_rows)), pa.array(score.ravel()),
                    pa.array(np.repeat(np.asarray(part.column(1)), high - low))], names=["n", "score", "label"])
    return run


def average_precisions(fitted: GBTClassificationModel, rows: DataFrame) -> list[float]:
    """Average precision on the rows (`_v`, `y`) of the first tree, the first two and so on; 1 where no row is positive."""
    ship(__name__)
    values, total = leaf_values(fitted), rows.count()
    leaves = fitted.copy({fitted.leafCol: "_leaf"}).transform(rows.select("_v", "y")).select(
        vector_to_array("_leaf").alias("leaf"), F.col("y").cast("long").alias("label"))
    at_once = max(1, JUDGED_ROWS // max(1, total))
    found = {}
    for low in range(0, len(values), at_once):
        high = min(len(values), low + at_once)
        last = leaves.mapInArrow(_margins(values, high - 1, high), "n int, score double, label long")
        judged = leaves.mapInArrow(_margins(values, low, high), "n int, score double, label long").withColumnRenamed("n", "trees")
        found |= {r["trees"]: r["pr_auc"] for r in rank_metrics(judged, ("trees",), points=cuts(last, ["score"])[0]).collect()}
    return [1.0 if found.get(n) is None else found[n] for n in range(1, len(values) + 1)]


def check_dominance(fitted, columns: list[str], limit: float = DOMINANCE) -> None:
    shares = list(fitted.featureImportances.toArray())
    top = max(range(len(shares)), key=shares.__getitem__)
    if shares[top] > limit:
        raise ValueError(f"{columns[top]} holds {shares[top]:.1%} of the importance, above {limit:.0%}: possible leak")


def calibrate(scored: DataFrame, label: str, raw: str = "raw_score") -> IsotonicRegressionModel:
    return IsotonicRegression(featuresCol=raw, labelCol=label, predictionCol="risk_score").fit(scored)


def _raw(trees, df: DataFrame) -> DataFrame:
    out = trees.transform(df)
    return out.withColumn("raw_score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def predict(model: RouteModel, df: DataFrame, raw: str = "raw_score", risk: str = "risk_score") -> DataFrame:
    """Add the raw and the calibrated score of one model to every row."""
    missing = [c for c in model.features if c not in df.columns]
    if missing:
        raise ValueError(f"feature columns missing: {missing}")
    out = _raw(model.trees, _vector(df, model.features)).drop("_v")
    cal = model.calibrator.copy({model.calibrator.featuresCol: "raw_score", model.calibrator.predictionCol: "risk_score"})
    out = cal.transform(out)
    return out.withColumnsRenamed({"raw_score": raw, "risk_score": risk}) if (raw, risk) != ("raw_score", "risk_score") else out


def score(features: DataFrame, models: dict[str, RouteModel], thresholds: policy.Thresholds,
          thresholds_version: str = "1") -> DataFrame:
    """Scores, tier and action of every feature row.

    Both models run on each row and the route picks one, so the feature plan
    under it is evaluated once, not once per route."""
    out = predict(models["cold"], features, "_cold_raw", "_cold_risk")
    out = predict(models["warm"], out, "_warm_raw", "_warm_risk")
    cold = F.col("is_cold")
    out = out.withColumn("raw_score", F.when(cold, F.col("_cold_raw")).otherwise(F.col("_warm_raw")))
    out = out.withColumn("risk_score", F.when(cold, F.col("_cold_risk")).otherwise(F.col("_warm_risk")))
    tier = policy.risk_tier(F.col("risk_score"), cold, thresholds)
    return out.drop("_cold_raw", "_cold_risk", "_warm_raw", "_warm_risk").withColumn("risk_tier", tier).withColumn(
        "action", policy.action_of(F.col("risk_tier"))).withColumn(
        "model_version", F.when(cold, models["cold"].version).otherwise(models["warm"].version)).withColumn(
        "thresholds_version", F.lit(thresholds_version))


def reason_codes(scored: DataFrame, models: dict[str, RouteModel], top: int = TOP_REASONS) -> DataFrame:
    """Up to `top` reasons per alerted row: (txn_id, reason_codes).

    A feature's contribution is how far the model's margin falls when the
    feature is set to its typical genuine value. Rows that were allowed are
    dropped before anything is computed."""
    parts = []
    alerts = scored.where(F.col("action") != "ALLOW")
    sizes = dict(alerts.groupBy("is_cold").agg(F.count("*")).collect())         # two rows, three with NULL
    for route, cold in (("cold", True), ("warm", False)):
        m = models[route]
        rows = alerts.where(F.col("is_cold") == F.lit(cold))
        rows = feature_array(rows, m.features, "_x").select(
            "txn_id", "_x", "amount_roundness", *[c for c in m.features if c != "amount_roundness"])
        shown = F.array(*[F.col(c).cast("double") if c not in CATEGORICAL else F.lit(None).cast("double") for c in m.features])
        base = F.array(*[F.lit(b) for b in m.baseline])
        margin = vector_to_array("rawPrediction")[1]
        rows = rows.select("txn_id", "amount_roundness", "_x", shown.alias("_shown"))
        rows = m.trees.transform(rows.withColumn("_v", array_to_vector("_x"))).select(
            "txn_id", "amount_roundness", "_x", "_shown", margin.alias("_margin"))
        # taken before a row is repeated per feature, so that one row is shuffled and not one for each of them
        rows = dealt(rows, sizes.get(cold, 0), "txn_id", per_task=ALERTS_PER_TASK)
        rows = rows.withColumn("_whole", F.max("_margin").over(W.partitionBy("txn_id"))).drop("_margin")
        slots = F.sequence(F.lit(0), F.lit(len(m.features) - 1))
        each = rows.withColumn("_j", F.explode(slots))
        swapped = F.transform("_x", lambda x, i: F.when(i == F.col("_j"), base[i]).otherwise(x))
        each = m.trees.transform(each.withColumn("_v", array_to_vector(swapped)))
        names = F.array(*[F.lit(c) for c in m.features])
        each = each.withColumn("contribution", F.col("_whole") - margin).where("contribution > 0").select(
            "txn_id", names[F.col("_j")].alias("feature"), F.col("_shown")[F.col("_j")].alias("v"),
            F.col("amount_roundness").alias("category"), "contribution")
        parts.append(each)
    return top_reasons(parts[0].unionByName(parts[1]), top)


def top_reasons(contributions: DataFrame, top: int = TOP_REASONS) -> DataFrame:
    """(txn_id, feature, v, category, contribution) rows to ranked codes."""
    order = W.partitionBy("txn_id").orderBy(F.desc(F.abs("contribution")), "feature")
    best = (contributions.where("contribution > 0").withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= top))
    value = F.when(F.col("feature").isin(*CATEGORICAL), F.col("category")).otherwise(F.col("v").cast("string"))
    code = F.struct(F.col("_rank"), F.col("feature").alias("code"),
                    messages.message(F.col("feature"), F.col("v"), F.col("category")).alias("message"),
                    F.col("feature"), value.alias("value"), F.col("contribution"))
    codes = best.groupBy("txn_id").agg(F.array_sort(F.collect_list(code)).alias("_codes"))      # at most `top` each
    alone = (F.size("_codes") == 1) & (F.col("_codes")[0]["code"] == SOLE)
    listed = F.transform("_codes", lambda c: c.dropFields("_rank"))
    return codes.select("txn_id", F.when(alone, F.filter(listed, lambda c: F.lit(False))).otherwise(listed).alias("reason_codes"))


def rules_score(df: DataFrame, out: str = "score") -> DataFrame:
    """A transparent score without a model: five rules, higher is riskier."""
    def one(c):
        return F.when(c, 1).otherwise(0)

    return df.withColumn(out, 2 * one(F.col("payee_is_unseen"))
                         + 2 * one(F.coalesce("amount_zscore_vs_payer_30d", F.lit(0.0)) > 3)
                         + one(F.col("is_collect_request")) + one(F.col("is_night"))
                         + one(F.col("payer_payee_txn_count") == 0))


# --- the older card-style model ------------------------------------------------
def legacy_pipeline(trees: int = 200, seed: int = SEED) -> Pipeline:
    """Scaled numbers and one-hot Y/N columns into a random forest."""
    yn, num = list(legacy.YES_NO), list(legacy.NUMERIC)
    return Pipeline(stages=[
        VectorAssembler(inputCols=num, outputCol="_num"),
        StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True),
        StringIndexer(inputCols=yn + [legacy.TARGET], outputCols=[f"_i_{c}" for c in yn] + ["_target"],
                      stringOrderType="alphabetDesc"),
        OneHotEncoder(inputCols=[f"_i_{c}" for c in yn], outputCols=[f"_h_{c}" for c in yn], dropLast=True),
        VectorAssembler(inputCols=["_scaled"] + [f"_h_{c}" for c in yn], outputCol="_x"),
        RandomForestClassifier(featuresCol="_x", labelCol="_target", numTrees=trees, seed=seed, maxDepth=10),
    ])


def legacy_importances(fitted: PipelineModel, top: int = 3) -> list[tuple[str, float]]:
    """The largest importances by input column."""
    names = list(legacy.NUMERIC) + list(legacy.YES_NO)
    ranked = sorted(zip(names, fitted.stages[-1].featureImportances.toArray()), key=lambda p: -p[1])
    return [(n, round(float(v), 4)) for n, v in ranked[:top]]


def legacy_predict(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """`label` (Y/N) and `fraud_probability` per row; the target column may be absent."""
    labels = fitted.stages[2].labelsArray[-1]
    if legacy.TARGET not in df.columns:
        df = df.withColumn(legacy.TARGET, F.lit(labels[0]))
    out = fitted.transform(df)
    yes = labels.index("Y")
    return out.withColumn("label", F.array(*[F.lit(x) for x in labels])[F.col("prediction").cast("int")]).withColumn(
        "fraud_probability", vector_to_array("probability")[yes])


