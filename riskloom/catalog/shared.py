"""Pieces used by the registered queries and by their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import testviews as views


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles half up the same way the SQL side does, and give integral
    columns one type."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.floor(c * 10.0 ** digits + 0.5) / 10.0 ** digits
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of the rounding in `tidy`."""
    scale = "1" + "0" * digits + ".0"
    return f"floor(CAST({expr} AS DOUBLE) * {scale} + 0.5) / {scale}"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


TXN = f"txn AS (SELECT *, epoch_us(ts) AS us, CAST(amount AS DECIMAL(18,6)) AS x FROM ({views.TXN.format(events='events')}) v)"
TIES = (f"txn AS (SELECT *, epoch_us(ts) AS us, CAST(amount AS DECIMAL(18,6)) AS x "
        f"FROM ({views.TXN_TIES.format(orders='orders')}) v)")
DECISIONS = f"decisions AS ({views.DECISIONS.format(orders='orders')})"
LABELS = f"review_labels AS ({views.REVIEW_LABELS.format(decisions='decisions')})"
