"""Registered exploration and preparation queries over the card-style view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayes
from ..operators import explore as ex
from ..operators import neighbours as nb
from ..session import materialize
from ..sources import legacy
from .inputs import LEGACY_CTE, legacy_view
from .shared import r, tidy

QUERIES, SQL = {}, {}
L = f"WITH {LEGACY_CTE}"
NUM = ["AverageAmountTransactionDay", "TransactionAmount", "DailyChargebackAvgAmt", "Six_MonthAvgChbkAmt"]
CLEAN = f"{LEGACY_CTE}, clean AS (SELECT * FROM legacy WHERE Six_MonthAvgChbkAmt IS NOT NULL)"


def add(name, fn, sql=None, digits=6):
    QUERIES[name] = lambda spark, d: tidy(fn(spark, d), digits)
    if sql:
        SQL[name] = sql


def rows(sp, d):
    return legacy_view(sp, d).drop("TransactionDate", "Merchant_id")


def clean(sp, d):
    return ex.drop_nulls(rows(sp, d))


add("rows_without_nulls", lambda sp, d: clean(sp, d).select("row_id", "Six_MonthAvgChbkAmt"),
    f"WITH {CLEAN} SELECT row_id, {r('Six_MonthAvgChbkAmt')} AS Six_MonthAvgChbkAmt FROM clean")
add("null_counts", lambda sp, d: ex.null_counts(rows(sp, d).select(*NUM, "isFradulent")),
    f"{L} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM legacy" for c in [*NUM, "isFradulent"]))
DUP = ["DailyChargebackAvgAmt", "Six_MonthChbkFreq", "isFradulent"]
add("duplicate_count", lambda sp, d: ex.duplicate_count(rows(sp, d).select(*DUP)),
    f"{L} SELECT (SELECT count(*) FROM legacy) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(DUP)} FROM legacy) q) AS duplicates")
add("duplicate_flags", lambda sp, d: ex.flag_duplicates(rows(sp, d).select("row_id", *DUP), "row_id").select("row_id", "duplicated"),
    f"{L} SELECT row_id, row_number() OVER (PARTITION BY {', '.join(DUP)} ORDER BY row_id) > 1 AS duplicated FROM legacy")
add("describe_numeric", lambda sp, d: ex.describe(rows(sp, d), NUM),
    f"{L} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, {r(f'avg({c})', 3)} AS mean, {r(f'stddev_samp({c})', 3)} AS std, "
        f"{r(f'min({c})', 3)} AS min, {r(f'max({c})', 3)} AS max, {r(f'quantile_cont({c}, 0.25)', 3)} AS p25, "
        f"{r(f'quantile_cont({c}, 0.5)', 3)} AS p50, {r(f'quantile_cont({c}, 0.75)', 3)} AS p75 FROM legacy" for c in NUM), 3)
add("value_counts", lambda sp, d: ex.value_counts(rows(sp, d), "Six_MonthAvgChbkAmt"),
    f"{L} SELECT {r('Six_MonthAvgChbkAmt')} AS Six_MonthAvgChbkAmt, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS share "
    "FROM legacy GROUP BY legacy.Six_MonthAvgChbkAmt")
add("distinct_values", lambda sp, d: ex.distinct_values(rows(sp, d), "isHighRiskCountry"),
    f"{L} SELECT DISTINCT isHighRiskCountry FROM legacy")
add("label_encoding_text", lambda sp, d: ex.label_encode(rows(sp, d).select("row_id", "Is_declined"), "Is_declined", "code"),
    f"{L} SELECT row_id, Is_declined, dense_rank() OVER (ORDER BY Is_declined) - 1 AS code FROM legacy")
add("label_encoding_numeric", lambda sp, d: ex.label_encode(
    rows(sp, d).select("row_id", "TransactionAmount"), "TransactionAmount", "code").select("row_id", "code"),
    f"{L} SELECT row_id, dense_rank() OVER (ORDER BY TransactionAmount) - 1 AS code FROM legacy")
add("correlation_pairs", lambda sp, d: ex.correlations(clean(sp, d), NUM),
    f"WITH {CLEAN} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM clean" for a in NUM for b in NUM))
add("share_by_value", lambda sp, d: ex.share_by_value(rows(sp, d), "isHighRiskCountry"),
    f"{L} SELECT isHighRiskCountry, count(*) AS n, {r('count(*) * 100.0 / sum(count(*)) OVER ()', 2)} AS pct FROM legacy GROUP BY 1")
add("crosstab_by_target", lambda sp, d: ex.crosstab(rows(sp, d), "isForeignTransaction", "isFradulent"),
    f"{L} SELECT isForeignTransaction, isFradulent, count(*) AS n, "
    f"{r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY isForeignTransaction)')} AS pct FROM legacy GROUP BY 1, 2")
add("histogram_table", lambda sp, d: ex.histogram(rows(sp, d), "TransactionAmount", 10),
    f"{L}, s AS (SELECT min(TransactionAmount) AS lo, (max(TransactionAmount) - min(TransactionAmount)) / 10 AS w FROM legacy) "
    f"SELECT bin, {r('any_value(lo) + bin * any_value(w)', 3)} AS low, count(*) AS n FROM (SELECT CAST(least(floor((TransactionAmount - lo) / w), 9) AS BIGINT) AS bin, lo, w "
    "FROM legacy, s) q GROUP BY bin", 3)
add("box_plot_table", lambda sp, d: ex.box_plot(rows(sp, d), "TransactionAmount"),
    f"{L}, q AS (SELECT quantile_cont(TransactionAmount, 0.25) AS q1, quantile_cont(TransactionAmount, 0.5) AS median, "
    "quantile_cont(TransactionAmount, 0.75) AS q3 FROM legacy), t AS (SELECT *, TransactionAmount BETWEEN q1 - 1.5 * (q3 - q1) AND "
    f"q3 + 1.5 * (q3 - q1) AS ok FROM legacy, q) SELECT {r('any_value(q1)', 3)} AS q1, {r('any_value(median)', 3)} AS median, "
    f"{r('any_value(q3)', 3)} AS q3, {r('min(TransactionAmount) FILTER (WHERE ok)', 3)} AS whisker_low, "
    f"{r('max(TransactionAmount) FILTER (WHERE ok)', 3)} AS whisker_high, count(*) FILTER (WHERE NOT ok) AS outliers FROM t", 3)
add("stratified_split_sizes", lambda sp, d: ex.stratified_split(rows(sp, d), "row_id", "isFradulent").groupBy(
    "isFradulent", "is_test").agg(F.count("*").alias("n")),
    f"{L}, c AS (SELECT isFradulent, count(*) AS n, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS t FROM legacy GROUP BY 1) "
    "SELECT isFradulent, true AS is_test, t AS n FROM c UNION ALL SELECT isFradulent, false, n - t FROM c")
add("oversampled_sizes", lambda sp, d: ex.oversample(rows(sp, d), "row_id", "isFradulent").groupBy("isFradulent").agg(
    F.count("*").alias("n"), F.count_distinct("row_id").alias("rows")),
    f"{L}, c AS (SELECT isFradulent, count(*) AS rows FROM legacy GROUP BY 1) SELECT isFradulent, (SELECT max(rows) FROM c) AS n, rows FROM c")
_pred = "CASE WHEN TransactionAmount > 200000 THEN 1 ELSE 0 END"


def _predicted(sp, d):
    return rows(sp, d).select(F.expr(_pred).alias("prediction"), (F.col("isFradulent") == "Y").cast("int").alias("label"))


P = f"{L}, p AS (SELECT {_pred} AS p, (isFradulent = 'Y')::INT AS t FROM legacy)"
add("classification_report", lambda sp, d: ex.classification_report(_predicted(sp, d)),
    f"{P}, k AS (SELECT unnest([0, 1]) AS c), s AS (SELECT c, count(*) FILTER (WHERE p = c) AS g, count(*) FILTER (WHERE t = c) AS support, "
    "count(*) FILTER (WHERE p = c AND t = c) AS h FROM p, k GROUP BY c) "
    f"SELECT CAST(c AS DOUBLE) AS class, {r('coalesce(h / nullif(g, 0), 0)')} AS precision, {r('coalesce(h / nullif(support, 0), 0)')} AS recall, "
    f"{r('coalesce(2 * h / nullif(g + support, 0), 0)')} AS f1_score, support FROM s")
add("sensitivity_specificity_hamming", lambda sp, d: ex.sensitivity_specificity(_predicted(sp, d)),
    f"{P} SELECT {r('count(*) FILTER (WHERE p = 0 AND t = 0) / count(*) FILTER (WHERE t = 0)')} AS sensitivity, "
    f"{r('count(*) FILTER (WHERE p = 1 AND t = 1) / count(*) FILTER (WHERE t = 1)')} AS specificity, "
    f"{r('count(*) FILTER (WHERE p <> t) / count(*)')} AS hamming_loss FROM p")
add("column_profile", lambda sp, d: ex.profile(rows(sp, d)).drop("distinct_about", "smallest", "largest", "type"),
    f"{L} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, "
        + (f"{r(f'avg({c})', 3)} AS mean, {r(f'stddev_samp({c})', 3)} AS std" if c not in (*legacy.YES_NO, legacy.TARGET)
           else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std") + " FROM legacy"
        for c in ("row_id", *legacy.FEATURES, legacy.TARGET)), 3)


def _model_rows(sp, d):
    df = clean(sp, d)
    yn = {c: (F.col(c) == "Y").cast("int") for c in (*legacy.YES_NO, legacy.TARGET)}
    return df.withColumns(yn)


def _fold(kind):
    return lambda sp, d: ex.cross_validate(_model_rows(sp, d), list(legacy.FEATURES), legacy.TARGET, kind, "row_id", 5)


def _fit(kind):
    def run(sp, d):
        # stored once: the fit reads its rows several times, and the split ranks the whole table
        df = materialize(ex.stratified_split(_model_rows(sp, d), "row_id", legacy.TARGET))
        m = ex.fit(df.where("NOT is_test"), list(legacy.FEATURES), legacy.TARGET, kind)
        return ex.classification_report(ex.predict(m, df.where("is_test")), label=legacy.TARGET)
    return run


for _kind in ("naive_bayes", "decision_tree", "random_forest"):
    add(f"fit_{_kind}", _fit(_kind))
add("cross_validation_accuracy", _fold("naive_bayes"))


# --- all folds of a Gaussian naive Bayes from one pass of sums --------------------------
_cols = list(legacy.FEATURES)


def _nb_sql():
    k = range(len(_cols))
    value = lambda c: f"({c} = 'Y')::DOUBLE" if c in legacy.YES_NO else f"CAST({c} AS DOUBLE)"
    each = lambda f: ", ".join(f(i) for i in k)
    var = lambda i: f"(q{i} / n - power(s{i} / n, 2) + extra)"
    return f"""WITH {CLEAN}, raw AS (
  SELECT row_id, CAST('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS fold, (isFradulent = 'Y')::BIGINT AS y,
    {each(lambda i: f"{value(_cols[i])} AS r{i}")} FROM clean),
x AS (SELECT row_id, fold, y, {each(lambda i: f"r{i} - avg(r{i}) OVER () AS x{i}")} FROM raw),
m AS (
  SELECT f.fold, x.y, count(*) AS n, {each(lambda i: f"sum(x{i}) AS s{i}, sum(x{i} * x{i}) AS q{i}")}
  FROM (SELECT DISTINCT fold FROM x) f JOIN x ON x.fold <> f.fold GROUP BY f.fold, x.y),
e AS (
  SELECT fold, sum(n) AS total, 1e-9 * greatest({each(lambda i: f"sum(q{i}) / sum(n) - power(sum(s{i}) / sum(n), 2)")}) AS extra FROM m GROUP BY fold),
p AS (
  SELECT x.row_id, x.fold, x.y, m.y AS guess, ln(n / total) - 0.5 * ({" + ".join(f"ln(2 * pi() * {var(i)}) + power(x{i} - s{i} / n, 2) / {var(i)}" for i in k)}) AS score
  FROM x JOIN m ON m.fold = x.fold JOIN e ON e.fold = x.fold),
b AS (SELECT row_id, fold, y, guess FROM p QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, guess) = 1)
SELECT fold, count(*) AS n, {r('avg((guess = y)::INT)')} AS accuracy FROM b GROUP BY fold"""


add("cross_validation_naive_bayes", lambda sp, d: bayes.cross_validate(_model_rows(sp, d), _cols, legacy.TARGET, "row_id"), _nb_sql())

# --- nearest neighbours and synthetic minority rows -------------------------------------
_space = ["TransactionAmount", "AverageAmountTransactionDay", "TotalNumberOfDeclinesDay", "DailyChargebackAvgAmt"]


def _minority(sp, d):
    return clean(sp, d).where("isFradulent = 'Y'")


def _synthetic(sp, d):
    """The class sizes that the synthetic rows lead to, and whether each lies on the segment between its two rows."""
    made = nb.synthetic_minority(clean(sp, d), "row_id", legacy.TARGET, "Y", _space)
    own = _minority(sp, d)
    ends = made.join(own.select(F.col("row_id").alias("base"), *[F.col(c).alias(f"a_{c}") for c in _space]), "base").join(
        own.select(F.col("row_id").alias("neighbour"), *[F.col(c).alias(f"b_{c}") for c in _space]), "neighbour")
    between = F.forall(F.array(*[F.col(c).between(F.least(f"a_{c}", f"b_{c}") - 1e-6, F.greatest(f"a_{c}", f"b_{c}") + 1e-6) for c in _space]), lambda x: x)
    return ends.agg(F.count("*").alias("made"), F.count_if(between).alias("between"), F.count_distinct("base").alias("bases"))


_d2 = " + ".join(f"(CAST(a.{c} AS DOUBLE) - b.{c}) * (CAST(a.{c} AS DOUBLE) - b.{c})" for c in _space)
add("minority_neighbours", lambda sp, d: nb.nearest_neighbours(_minority(sp, d), "row_id", _space),
    f"WITH {CLEAN}, y AS (SELECT * FROM clean WHERE isFradulent = 'Y'), p AS (SELECT a.row_id AS id, b.row_id AS neighbour, {_d2} AS d2 "
    "FROM y a JOIN y b ON a.row_id <> b.row_id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, neighbour) AS rank FROM p) "
    f"SELECT id, rank, neighbour, {r('sqrt(d2)', 3)} AS distance FROM k WHERE rank <= 5", 3)
add("synthetic_minority_rows", _synthetic,
    f"WITH {CLEAN}, c AS (SELECT count(*) FILTER (WHERE isFradulent = 'N') AS n, count(*) FILTER (WHERE isFradulent = 'Y') AS y FROM clean) "
    "SELECT n - y AS made, n - y AS between, least(y, n - y) AS bases FROM c")
