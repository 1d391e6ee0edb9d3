"""Shaping of feature rows for models: columns, splits, guards, JSON safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import ALL_FEATURES, CATEGORICAL, COLD_FEATURES

# Inclusive day ranges from the first event; the test range has no end.
TRAIN_DAYS, VAL_DAYS, TEST_DAYS = (0, 59), (60, 74), (75, None)
MIN_POSITIVES = 50
NO_TRAINING = "MULE_OUTBOUND"


def model_frame(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly `columns` in that order. Absent ones are NULL; categories become
    their index, unknown categories NULL."""
    out = []
    for n in columns:
        c = F.col(n) if n in df.columns else F.lit(None)
        if n in CATEGORICAL:
            at = F.array_position(F.array(*[F.lit(v) for v in CATEGORICAL[n]]), c.cast("string"))
            c = F.when(at > 0, at - 1)
        out.append(c.cast("double").alias(n))
    return df.select(*keep, *out)


def route_columns(is_cold: bool) -> list[str]:
    return COLD_FEATURES if is_cold else ALL_FEATURES


def split_by_day(df: DataFrame, start=None, train=TRAIN_DAYS, val=VAL_DAYS, test=TEST_DAYS) -> DataFrame:
    """Add `split` by whole days since the first event (or `start`). Days in no
    range get NULL."""
    if start is None:
        df = df.crossJoin(F.broadcast(df.agg(F.min("ts").alias("_start"))))
        first = F.col("_start")
    else:
        first = F.lit(start).cast("timestamp")
    day = F.floor((F.unix_micros("ts") - F.unix_micros(first)) / 86_400_000_000)
    out = F.lit(None).cast("string")
    for name, (lo, hi) in (("test", test), ("val", val), ("train", train)):
        inside = day >= lo if hi is None else day.between(lo, hi)
        out = F.when(inside, name).otherwise(out)
    return df.withColumn("split", out).drop("_start")


def split_ranges(df: DataFrame) -> DataFrame:
    return df.where("split IS NOT NULL").groupBy("split").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def assert_in_time(df: DataFrame) -> None:
    """Training ends before validation starts, validation before test."""
    r = {row["split"]: row for row in split_ranges(df).collect()}      # three rows
    for a, b in (("train", "val"), ("val", "test")):
        assert r[a]["last_ts"] < r[b]["first_ts"], f"{a} ends {r[a]['last_ts']}, {b} starts {r[b]['first_ts']}"


def for_training(df: DataFrame) -> DataFrame:
    """Outbound mule rows are kept out of training only; rows without a
    typology stay."""
    return df.where(~F.col("label_typology").eqNullSafe(F.lit(NO_TRAINING)))


def positives(df: DataFrame, label="label_is_fraud") -> DataFrame:
    return df.groupBy("is_cold").agg(F.sum(F.col(label).cast("long")).alias("positives"))


def require_positives(df: DataFrame, minimum: int = MIN_POSITIVES, label="label_is_fraud") -> None:
    """Refuse to train when either route has too few positive rows."""
    got = {r["is_cold"]: r["positives"] for r in positives(df, label).collect()}
    cold, warm = got.get(True, 0) or 0, got.get(False, 0) or 0
    if min(cold, warm) < minimum:
        raise ValueError(f"refusing to train: {cold} cold and {warm} warm positives, {minimum} needed of each")


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _clean(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _finite(c)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _clean(v, kind.valueType))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL, in nested values too."""
    return df.select(*[_clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def from_snapshot(df: DataFrame, snapshot: str = "feature_snapshot", keep: tuple[str, ...] = ()) -> DataFrame:
    """The stored feature snapshot as columns again; NULL means missing."""
    return df.select(*keep, F.col(f"{snapshot}.*"))


def event_field(json_column: str, name: str, kind: str, default=None) -> Column:
    """A field of a JSON event text; NULL when absent, which is not false."""
    v = F.get_json_object(json_column, f"$.{name}").try_cast(kind)
    return v if default is None else F.coalesce(v, F.lit(default).cast(kind))
