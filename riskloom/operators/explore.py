"""Exploration and preparation of tabular data, and the older model fits."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import cuts, percentiles, piece, running_totals, text_cuts

SEED = 42


def drop_nulls(df: DataFrame) -> DataFrame:
    return df.dropna()


def null_counts(df: DataFrame) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier equal row."""
    per = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return per.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def flag_duplicates(df: DataFrame, order: str) -> DataFrame:
    """`duplicated` on every row that equals one with a smaller `order` value."""
    rest = [c for c in df.columns if c != order]
    first = df.groupBy(*[F.col(c).alias(f"_{c}") for c in rest]).agg(F.min(order).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in rest])
    return df.join(first, same).select(*df.columns, (F.col(order) > F.col("_first")).alias("duplicated"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per numeric column."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"),
                 piece(F.col(c).cast("double"), p).alias("_piece"))
        for c, p in zip(columns, cuts(df, columns, 16))])))
    q = percentiles(long, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ("column",)).drop("n")
    m = long.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                   F.min("value").alias("min"), F.max("value").alias("max"))
    return m.join(q, "column")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with count and share of all rows."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return n.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_all")).alias("share"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Position of each value among the sorted distinct values, from 0."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    text = isinstance(df.schema[column].dataType, T.StringType)
    points = text_cuts(values, column, values.count()) if text else None
    codes = running_totals(values, column, {"n": F.lit(1)}, points=points).select(column, F.col("n_before").alias(out))
    return df.join(codes, column, "left")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, as rows."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def correlation_matrix(df: DataFrame, columns: list[str]):
    v = VectorAssembler(inputCols=columns, outputCol="_v").transform(df.select(*columns).dropna())
    return Correlation.corr(v, "_v").first()[0]


def share_by_value(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df, column).withColumn("pct", F.floor(F.col("share") * 10000 + 0.5) / 100).drop("share")


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Row-normalised crosstab in long form, per cent."""
    n = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    total = df.groupBy(rows).agg(F.count("*").alias("_all"))
    return n.join(total, rows).select(rows, columns, "n", (F.col("n") * 100 / F.col("_all")).alias("pct"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last is closed."""
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1))
    return (df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span))
            .groupBy(F.when(width > 0, at).otherwise(0).cast("long").alias("bin"), (F.col("_lo")).alias("_l"), width.alias("_w"))
            .agg(F.count("*").alias("n")).select("bin", (F.col("_l") + F.col("bin") * F.col("_w")).alias("low"), "n"))


def box_plot(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whiskers (furthest rows within 1.5 quartile ranges) and outliers."""
    q = percentiles(df.select(column), column, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    v, reach = F.col(column), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return df.select(column).crossJoin(F.broadcast(q)).groupBy("q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = SEED) -> DataFrame:
    """`is_test` for a fixed share of every class, chosen by a hash of the key.

    The exact share per class comes from the running order of the hash."""
    h = df.withColumn("_h", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)).cast("double"))
    at = running_totals(h, "_h", {"n": F.lit(1)}, (label,))
    size = h.groupBy(label).agg(F.count("*").alias("_all"))
    cut = at.join(size, label).where(F.col("n_before") + F.col("n") <= F.bround(F.col("_all") * test_share)).groupBy(label).agg(
        F.max("_h").alias("_cut"))
    return h.join(F.broadcast(cut), label, "left").withColumn(
        "is_test", F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))).drop("_h", "_cut")


def oversample(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """Repeat rows of smaller classes until every class is as large as the
    largest: each row equally often, plus one more for those first in hash order."""
    h = df.withColumn("_h", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)).cast("double"))
    at = running_totals(h, "_h", {"n": F.lit(1)}, (label,))
    size = h.groupBy(label).agg(F.count("*").alias("_all"))
    top = size.agg(F.max("_all").alias("_top"))
    need = size.crossJoin(F.broadcast(top)).select(
        label, F.floor(F.col("_top") / F.col("_all")).alias("_times"), (F.col("_top") % F.col("_all")).alias("_more"))
    cut = at.join(need, label).where(F.col("n_before") + F.col("n") <= F.col("_more")).groupBy(label).agg(F.max("_h").alias("_cut"))
    need = need.join(cut, label, "left")        # one row per class
    times = F.col("_times") + F.coalesce((F.col("_h") <= F.col("_cut")).cast("int"), F.lit(0))
    return (h.join(F.broadcast(need), label).withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))
            .drop("_h", "_times", "_more", "_cut"))


CLASSIFIERS = {
    "naive_bayes": lambda: NaiveBayes(modelType="gaussian", featuresCol="_v", labelCol="_y"),
    "decision_tree": lambda: DecisionTreeClassifier(maxDepth=10, seed=SEED, featuresCol="_v", labelCol="_y"),
    "random_forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, seed=SEED, featuresCol="_v", labelCol="_y"),
}


def fit(df: DataFrame, columns: list[str], label: str, kind: str):
    pipe = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_v"), CLASSIFIERS[kind]()])
    return pipe.fit(df.withColumn("_y", F.col(label).cast("double")))


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_v", "rawPrediction", "probability")


def cross_validate(df: DataFrame, columns: list[str], label: str, kind: str, key: str, folds: int = 5) -> DataFrame:
    """Accuracy per fold; folds by a hash of the key."""
    rows = df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(folds)))
    parts = []
    for k in range(folds):
        m = fit(rows.where(F.col("fold") != k), columns, label, kind)
        out = predict(m, rows.where(F.col("fold") == k))
        hit = (F.col("prediction") == F.col(label).cast("double")).cast("double")
        parts.append(out.agg(F.lit(k).cast("long").alias("fold"), F.count("*").alias("n"), F.avg(hit).alias("accuracy")))
    return reduce(DataFrame.unionByName, parts)


def classification_report(df: DataFrame, predicted: str = "prediction", label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    pairs = df.groupBy(F.col(predicted).cast("double").alias("p"), F.col(label).cast("double").alias("t")).agg(F.count("*").alias("n"))
    side = F.inline(F.array(
        F.struct(F.col("p").alias("class"), F.col("n").alias("given"), F.lit(0).cast("long").alias("support"),
                 F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("t").alias("class"), F.lit(0).cast("long").alias("given"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("hits"))))
    c = pairs.select(side).groupBy("class").agg(F.sum("given").alias("given"), F.sum("support").alias("support"),
                                               F.sum("hits").alias("hits"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    p, r = ratio(F.col("hits"), F.col("given")), ratio(F.col("hits"), F.col("support"))
    return c.select("class", p.alias("precision"), r.alias("recall"),
                    ratio(2 * F.col("hits"), F.col("given") + F.col("support")).alias("f1_score"), "support")


def sensitivity_specificity(df: DataFrame, predicted: str = "prediction", label: str = "label") -> DataFrame:
    """Share of class 0 and of class 1 predicted right, and the Hamming loss."""
    p, t = F.col(predicted).cast("double"), F.col(label).cast("double")
    return df.agg((F.count_if((p == 0) & (t == 0)) / F.count_if(t == 0)).alias("sensitivity"),
                  (F.count_if((p == 1) & (t == 1)) / F.count_if(t == 1)).alias("specificity"),
                  (F.count_if(p != t) / F.count("*")).alias("hamming_loss"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls, about how many distinct values,
    smallest, largest and, for numbers, mean and deviation."""
    aggs = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c, num = F.col(f.name), isinstance(f.dataType, T.NumericType)
        aggs += [F.count_if(c.isNull()).alias(f"u{i}"), F.approx_count_distinct(c).alias(f"d{i}"),
                 F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}"),
                 (F.avg(c) if num else F.avg(F.lit(None).cast("double"))).cast("double").alias(f"m{i}"),
                 (F.stddev_samp(c) if num else F.avg(F.lit(None).cast("double"))).alias(f"s{i}")]
    return df.agg(*aggs).select(F.inline(F.array(*[F.struct(
        F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("rows"),
        F.col(f"u{i}").alias("nulls"), F.col(f"d{i}").alias("distinct_about"), F.col(f"a{i}").alias("smallest"),
        F.col(f"b{i}").alias("largest"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
        for i, f in enumerate(df.schema.fields)])))
