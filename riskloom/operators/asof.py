"""Point-in-time reads: what was known about a key strictly before a moment.

Every windowed read is rewritten as a running total. A row that belongs to the
window [t - w, t) adds its value when it happens and takes it away w later, so
one sorted pass with an ever-growing frame ending 1 microsecond before the row
answers any number of window lengths in linear time. Distinct counts work the
same way: per pair of key and counterpart, a stretch of rows that are at most w
apart counts once, from its first row to w after its last.

Skew: keys above a share of the table are cut into time slices. Each slice is
its own sort group and starts from a carried row holding the totals of the
slices before it, so no single task sees a whole hot key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import DAY, HOUR, MONTH
from ..session import compiled, materialize

HOT_ROWS = 1_000_000      # below this many rows a key is never split
HOT_SHARE = 1e-5          # a key is hot above this share of all rows

_AT, _STEP, _SLICE = "_at", "_step", "_slice"


@dataclass(frozen=True)
class Track:
    """A running value: the sum, minimum or maximum of the changes so far."""
    name: str
    dtype: str = "long"
    op: str = "sum"


@dataclass
class Move:
    """Changes that take effect `after` microseconds past their row."""
    after: int = 0
    changes: dict[str, Column] = field(default_factory=dict)
    where: Column | None = None


def _fold(op: str, col: Column) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max}[op](col)


def _slice_of(at: Column, hot: str | None, width: int) -> Column:
    return F.when(F.col(hot), F.floor(at / F.lit(width))).otherwise(F.lit(0)).cast("long")


def running(df: DataFrame, key: list[str], tracks: list[Track], moves: list[Move],
            hot: str | None = None, width: int = HOUR) -> DataFrame:
    """Add every track's value strictly before each row of `df` (column `us`).

    The first move must be the row itself (`after=0`)."""
    compiled(df.sparkSession)
    payload = [c for c in df.columns if c not in key and c != "us"]
    # Changes are worked out once per row, before the row is repeated per move.
    values = {(i, n): c for i, m in enumerate(moves) for n, c in m.changes.items()}
    kinds = {t.name: t.dtype for t in tracks}
    held = [(F.when(moves[i].where, c) if i == 0 and moves[0].where is not None else c)
            .cast(kinds[n]).alias(f"~{i}{n}") for (i, n), c in values.items()]
    # Which moves a row makes; the first is the row itself.
    made = [F.lit(0)] + [F.lit(i) if m.where is None else F.when(m.where, i) for i, m in enumerate(moves[1:], 1)]
    steps = df.select("*", *held, F.explode(F.array_compact(F.array(*made))).alias(_STEP))

    def change(t: Track) -> str:
        picks = [f"WHEN {i} THEN `~{i}{t.name}`" for i in range(len(moves)) if (i, t.name) in values]
        return f"CASE {_STEP} {' '.join(picks)} END AS `~{t.name}`"

    lags = " ".join(f"WHEN {i} THEN {m.after}L" for i, m in enumerate(moves))
    rows = steps.selectExpr(
        *[f"`{k}`" for k in key], f"us + CASE {_STEP} {lags} END AS {_AT}", _STEP,
        *[f"CASE {_STEP} WHEN 0 THEN `{c}` END AS `{c}`" for c in payload if c != hot],
        *([hot] if hot else []), *[change(t) for t in tracks])
    part = list(key)
    if hot:
        part.append(_SLICE)
        rows = rows.withColumn(_SLICE, _slice_of(F.col(_AT), hot, width))
        rows = rows.unionByName(_carried(rows, key, tracks, hot, width), allowMissingColumns=True)
    before = W.partitionBy(*part).orderBy(_AT).rangeBetween(W.unboundedPreceding, -1)
    reads = []
    for t in tracks:
        value = _fold(t.op, F.col("~" + t.name)).over(before)
        reads.append((F.coalesce(value, F.lit(0).cast(t.dtype)) if t.op == "sum" else value).alias(t.name))
    return (rows.select(*key, _AT, _STEP, *payload, *reads)
            .where(F.col(_STEP) == 0).drop(_STEP).withColumnRenamed(_AT, "us"))


def _carried(rows: DataFrame, key, tracks, hot, width) -> DataFrame:
    """One row per hot key and slice: the folded changes of all earlier slices."""
    per = (rows.where(hot).groupBy(*key, _SLICE)
           .agg(*[_fold(t.op, F.col("~" + t.name)).cast(t.dtype).alias("~" + t.name) for t in tracks]))
    earlier = W.partitionBy(*key).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    return per.select(
        *key, (F.col(_SLICE) * width - 1).alias(_AT), F.lit(-1).alias(_STEP), F.lit(True).alias(hot), _SLICE,
        *[_fold(t.op, F.col("~" + t.name)).over(earlier).cast(t.dtype).alias("~" + t.name) for t in tracks])


def neighbours(df: DataFrame, key: list[str], name: str, hot: str | None = None,
               width: int = HOUR) -> DataFrame:
    """Per row of a key's history: `<name>_n` and `<name>_last_us` strictly
    before it, and the gaps in microseconds to the rows next to it in
    (us, txn_id) order (`<name>_gap_prev`, `<name>_gap_next`)."""
    rows = df.withColumn(_STEP, F.lit(0)).withColumn("~n", F.lit(1).cast("long"))
    part = list(key)
    if hot:
        part.append(_SLICE)
        rows = rows.withColumn(_SLICE, _slice_of(F.col("us"), hot, width))
        rows = rows.unionByName(_edges(rows, key, hot), allowMissingColumns=True)
    order = W.partitionBy(*part).orderBy("us", "txn_id")
    before = W.partitionBy(*part).orderBy("us").rangeBetween(W.unboundedPreceding, -1)
    return (rows
            .withColumn(f"{name}_gap_prev", F.col("us") - F.lag("us").over(order))
            .withColumn(f"{name}_gap_next", F.lead("us").over(order) - F.col("us"))
            .withColumn(f"{name}_n", F.coalesce(F.sum("~n").over(before), F.lit(0)))
            .withColumn(f"{name}_last_us", F.max("us").over(before))
            .where(F.col(_STEP) == 0).drop(_STEP, "~n", _SLICE))


def _edges(rows: DataFrame, key, hot) -> DataFrame:
    """Per slice of a hot key, the nearest row on either side of the slice; the
    one before it also carries the count of all earlier rows."""
    per = rows.where(hot).groupBy(*key, _SLICE).agg(
        F.sum("~n").alias("~n"), F.max("us").alias("hi"), F.min("us").alias("lo"))
    past = W.partitionBy(*key).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    future = W.partitionBy(*key).orderBy(F.desc(_SLICE)).rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*key, _SLICE, F.max("hi").over(past).alias("hi"), F.sum("~n").over(past).alias("~n"),
                     F.min("lo").over(future).alias("lo"))
    sides = F.array(F.struct(F.col("hi").alias("us"), F.col("~n")),
                    F.struct(F.col("lo").alias("us"), F.lit(0).cast("long").alias("~n")))
    return per.select(*key, _SLICE, F.lit(-1).alias(_STEP), F.lit(True).alias(hot),
                      F.inline(sides)).where("us is not null")


def opens(gap_prev: str, window: int | None) -> Column:
    """1 where a counterpart starts to count as seen within `window`."""
    gap = F.col(gap_prev)
    fresh = gap.isNull() if window is None else gap.isNull() | (gap > window)
    return F.when(fresh, 1).otherwise(0).cast("long")


def closes(gap_next: str, window: int) -> Column:
    gap = F.col(gap_next)
    return gap.isNull() | (gap > window)


# --- hot keys ---------------------------------------------------------------
def hot_keys(events: DataFrame, columns=("payer_vpa", "payee_vpa", "device_id"),
             min_rows: int = HOT_ROWS, share: float = HOT_SHARE, total: int | None = None) -> dict[str, list]:
    """Keys above max(min_rows, share of all rows), per column. At most 1/share
    keys per column can qualify, which bounds what reaches the driver. `total`:
    the number of rows, where it is known."""
    total = events.count() if total is None else total
    limit = max(min_rows, int(total * share))
    if total < limit:
        return {c: [] for c in columns}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("k")) for c in columns])
    found = (events.select(F.inline(pairs)).groupBy("c", "k").count()
             .where(F.col("count") >= limit).collect())
    out = {c: [] for c in columns}
    for r in found:
        out[r["c"]].append(r["k"])
    return out


def flag_hot(df: DataFrame, column: str, keys: list, name: str) -> DataFrame:
    """Mark rows whose key is in the bounded list (broadcast, at most 1/share keys)."""
    listed = df.sparkSession.createDataFrame([(k, True) for k in keys], f"{column} string, {name} boolean")
    return (df.join(F.broadcast(listed), column, "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(False))))


def settle(df: DataFrame, hot: str | None) -> DataFrame:
    """Hot stages read their input twice, so it is stored once."""
    return materialize(df) if hot else df
