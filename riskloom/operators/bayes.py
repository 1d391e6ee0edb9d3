"""Gaussian naive Bayes from sums, so that all folds of a cross-validation come from one pass.

Counts, sums and sums of squares are kept per class and fold, around the columns' means. The model that leaves a fold out
is the sums of all folds less those of that fold: no row is read again per fold, and scoring needs one row per fold and
class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the largest variance that is added to all, so that a constant column does not divide by zero.
SMOOTHING = 1e-9


def fold_of(key: str, folds: int) -> Column:
    """A fold by hash of the key."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % folds


def _sums(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in columns]).alias("s"),
                                 F.array(*[F.sum(F.col(c) * F.col(c)) for c in columns]).alias("q"))


def _centred(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(f"mean of {c}") for c in columns])          # one row
    wide = df.crossJoin(F.broadcast(means))
    return wide.withColumns({c: F.col(c).cast("double") - F.col(f"mean of {c}") for c in columns}).drop(*means.columns)


def models(sums: DataFrame, width: int, fold: str | None = None) -> DataFrame:
    """Per fold, the classes as an array of (class, prior, mean, variance) learnt from all other folds; one model of all
    rows if `fold` is not named. `sums` has a row per class and fold, of `width` columns."""
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - F.coalesce(y, F.lit(0.0)))
    added = [F.array(*[F.sum(F.col(c)[i]) for i in range(width)]).alias(c) for c in ("s", "q")]
    total = sums.groupBy("y").agg(F.sum("n").alias("n"), *added)
    if fold is not None:
        own = sums.select(fold, "y", F.col("n").alias("_n"), F.col("s").alias("_s"), F.col("q").alias("_q"))
        grid = total.crossJoin(F.broadcast(sums.select(fold).distinct())).join(own, [fold, "y"], "left")      # folds x classes
        zero = F.transform("s", lambda _: F.lit(0.0))
        total = grid.select(fold, "y", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n"), minus(F.col("s"), F.coalesce("_s", zero)).alias("s"),
                            minus(F.col("q"), F.coalesce("_q", zero)).alias("q")).where("n > 0")
    by = [fold] if fold is not None else []
    pooled = [F.array(*[F.sum(F.col(c)[i]) for i in range(width)]).alias(c + c) for c in ("s", "q")]
    listed = total.groupBy(*by).agg(F.sum("n").alias("all"), *pooled, F.array_sort(F.array_agg(F.struct("y", "n", "s", "q"))).alias("classes"))
    spread = F.array_max(F.zip_with("qq", "ss", lambda q, s: q / F.col("all") - (s / F.col("all")) * (s / F.col("all"))))
    variance = lambda c: F.zip_with(c["q"], c["s"], lambda q, s: q / c["n"] - (s / c["n"]) * (s / c["n"]) + F.col("extra"))
    return listed.withColumn("extra", SMOOTHING * spread).select(*by, F.transform("classes", lambda c: F.struct(
        c["y"].alias("y"), F.log(c["n"] / F.col("all")).alias("prior"), F.transform(c["s"], lambda s: s / c["n"]).alias("mean"),
        variance(c).alias("var"))).alias("model"))


def predict(rows: DataFrame, columns: list[str], model: DataFrame, fold: str | None = None) -> DataFrame:
    """`rows` with `prediction`: the class of the highest posterior, the smaller one of equals."""
    joined = rows.join(F.broadcast(model), fold) if fold is not None else rows.crossJoin(F.broadcast(model))
    x = F.array(*[F.col(c) for c in columns])

    def score(c):
        terms = F.zip_with(F.zip_with(x, c["mean"], lambda v, m: (v - m) * (v - m)), c["var"], lambda d, var: F.log(2 * math.pi * var) + d / var)
        return c["prior"] - F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2

    best = F.array_max(F.transform("model", lambda c: F.struct(score(c).alias("s"), (-c["y"]).alias("y"))))
    return joined.withColumn("prediction", -best["y"]).drop("model")


def cross_validate(df: DataFrame, columns: list[str], label: str, key: str, folds: int = 5) -> DataFrame:
    """fold, n and accuracy of each fold under the model of the others. Rows with a NULL column or label take no part."""
    rows = _centred(df.select(fold_of(key, folds).alias("fold"), F.col(label).cast("long").alias("y"), *columns).dropna(), columns)
    model = models(_sums(rows, columns, ["fold", "y"]), len(columns), "fold")
    right = (F.col("prediction") == F.col("y")).cast("double")
    return predict(rows, columns, model, "fold").groupBy("fold").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))
