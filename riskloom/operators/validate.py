"""Strict checks of incoming rows: each row is valid or rejected with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT, INITIATION_MODES, LABEL_COLUMNS, TXN_TYPES, WIRE_TIME
from ..sources import legacy

_DOMAINS = {"txn_type": TXN_TYPES, "initiation_mode": INITIATION_MODES}


def _first_reason(checks: list[tuple[Column, Column | str]]) -> Column:
    out = F.lit(None).cast("string")
    for bad, why in reversed(checks):
        out = F.when(bad, why if isinstance(why, Column) else F.lit(why)).otherwise(out)
    return out


def check_events(df: DataFrame, body: str, labels: bool) -> DataFrame:
    """Parse JSON event bodies; adds `e` (the event struct) and `reason`, NULL
    where the row is valid. With `labels=False` (serving input) label fields
    are unknown fields and therefore rejected."""
    fields = {WIRE_TIME if f.name == "ts" else f.name: f for f in EVENT if labels or f.name not in LABEL_COLUMNS}
    needed = [n for n in fields if n != "label_typology"]

    def judge(m: Column) -> Column:
        allowed = F.array(*[F.lit(n) for n in fields])
        extra = F.array_except(F.map_keys(m), allowed)
        missing = F.filter(F.array(*[F.lit(n) for n in needed]), lambda n: m[n].isNull())
        cast = {n: m[n] if f.dataType.simpleString() == "string" else m[n].try_cast(f.dataType) for n, f in fields.items()}
        checks = [
            (m.isNull(), "not a JSON object"),
            (F.size(extra) > 0, F.concat(F.lit("unknown field: "), F.array_join(F.array_sort(extra), ", "))),
            (F.size(missing) > 0, F.concat(F.lit("missing field: "), F.array_join(missing, ", "))),
        ]
        checks += [(m[n].isNotNull() & c.isNull(), f"bad value: {n}") for n, c in cast.items()]
        checks += [(~m[n].isin(*values), f"bad value: {n}") for n, values in _DOMAINS.items()]
        return F.struct(_first_reason(checks).alias("reason"),
                        F.struct(*[c.alias(fields[n].name) for n, c in cast.items()]).alias("e"))

    # Bound as a lambda variable, the body is parsed once however often a field is read.
    parsed = F.from_json(F.col(body), "map<string,string>")
    return df.withColumn("_c", F.transform(F.array(parsed), judge)[0]).select("*", "_c.reason", "_c.e").drop("_c")


def split_events(df: DataFrame, body: str = "event", labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid events as columns, rejected bodies with their reason)."""
    checked = check_events(df, body, labels)
    return checked.where("reason IS NULL").select("e.*"), checked.where("reason IS NOT NULL").select(body, "reason")


def check_rows(df: DataFrame) -> DataFrame:
    """`reason` for event rows that already have columns: required and domains."""
    required = [f.name for f in EVENT if f.name != "label_typology" and f.name in df.columns]
    checks = [(F.col(n).isNull(), f"missing field: {n}") for n in required]
    checks += [(~F.col(n).isin(*v), f"bad value: {n}") for n, v in _DOMAINS.items()]
    return df.withColumn("reason", _first_reason(checks))


def check_legacy(df: DataFrame) -> DataFrame:
    """Older inputs given as text: all present, numbers numeric, Y/N after
    trimming and upper-casing. Valid rows come with cleaned columns."""
    checks = [(F.col(c).isNull(), f"missing field: {c}") for c in legacy.FEATURES]
    checks += [(F.col(c).try_cast("double").isNull(), f"not a number: {c}") for c in legacy.NUMERIC]
    checks += [(~F.upper(F.trim(c)).isin("Y", "N"), f"not Y or N: {c}") for c in legacy.YES_NO]
    clean = {c: F.col(c).try_cast("double") for c in legacy.NUMERIC}
    clean |= {c: F.upper(F.trim(c)) for c in legacy.YES_NO}
    return df.withColumn("reason", _first_reason(checks)).withColumns(clean)
