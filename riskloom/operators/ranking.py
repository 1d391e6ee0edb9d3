"""Running totals and exact percentiles over the order of a value.

A window without a partition would sort the whole table in one task. Instead
equal values are summed first, the value range is cut at about equal shares
(bounded list of cut points on the driver), each piece runs its own window, and
the totals of the pieces before it are added from a table of one row per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_PIECES = 256
_PIECE = "_piece"


def pieces_for(df: DataFrame) -> int:
    return max(2, min(MAX_PIECES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cuts(df: DataFrame, columns: list[str], pieces: int | None = None) -> list[list[float]]:
    """Cut points per numeric column, one pass with mergeable sketches. They
    only balance the work; results do not depend on them."""
    n = pieces or pieces_for(df)
    probs = [i / n for i in range(1, n)]
    found = df.select(*[F.col(c).cast("double") for c in columns]).approxQuantile(columns, probs, 0.25 / n)
    return [sorted(set(f)) for f in found]


def piece(value: Column, points: list) -> Column:
    """How many cut points lie at or below the value, by binary search."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(points[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(points))


def running_totals(df: DataFrame, value: str, measures: dict[str, Column], groups: tuple[str, ...] = (),
                   descending: bool = False, points: list | None = None, following: bool = False) -> DataFrame:
    """One row per group and distinct value with each measure's sum at that
    value and `<measure>_before`, the sum over all values earlier in the order.

    `following` adds `<measure>_next`, the sum at the next value. A column
    `_piece` that is already present is used instead of `points`."""
    df = df.where(F.col(value).isNotNull())
    if _PIECE not in df.columns:
        points = cuts(df, [value])[0] if points is None else points
        df = df.withColumn(_PIECE, piece(F.col(value), points))
    names = list(measures)
    at = df.groupBy(*groups, _PIECE, value).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    edge = F.max_by if descending else F.min_by
    per = at.groupBy(*groups, _PIECE).agg(
        *[F.sum(n).alias(f"_s_{n}") for n in names],
        edge(F.struct(*names), F.col(value)).alias("_first"))
    order = F.desc(_PIECE) if descending else F.asc(_PIECE)
    by_piece = W.partitionBy(*groups).orderBy(order)
    per = per.select(
        *groups, _PIECE,
        *[F.coalesce(F.sum(f"_s_{n}").over(by_piece.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_c_{n}")
          for n in names],
        F.lead("_first").over(by_piece).alias("_ahead"))
    within = W.partitionBy(*groups, _PIECE).orderBy(F.desc(value) if descending else F.asc(value))
    joined = at.join(per, [*groups, _PIECE])
    out = [F.coalesce(F.sum(n).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col(f"_c_{n}")
           for n in names]
    cols = [c.alias(f"{n}_before") for n, c in zip(names, out)]
    if following:
        cols += [F.coalesce(F.lead(n).over(within), F.col(f"_ahead.{n}")).alias(f"{n}_next") for n in names]
    return joined.select(*groups, value, *names, *cols)


def percentiles(df: DataFrame, value: str, probs: dict[str, float], groups: tuple[str, ...] = (),
                points: list | None = None) -> DataFrame:
    """Exact interpolated percentiles per group, with the row count `n`."""
    at = running_totals(df, value, {"n": F.lit(1)}, groups, points=points)
    total = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count("*").alias("_n"))
    at = at.join(total, list(groups)) if groups else at.crossJoin(F.broadcast(total))
    aggs = []
    for i, p in enumerate(probs.values()):
        for side, fn in (("lo", F.floor), ("hi", F.ceil)):
            rank = fn(F.lit(p) * (F.col("_n") - 1))
            hit = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}{i}"))
    got = at.groupBy(*groups).agg(F.max("_n").alias("n"), *aggs)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        h = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return got.select(*groups, "n", *out)


def text_cuts(df: DataFrame, column: str, rows: int) -> list[str]:
    """Cut points of a text column of about `rows` rows, from a bounded sample."""
    n = pieces_for(df)
    share = min(1.0, 64 * n / max(rows, 1))
    keys = sorted({r[0] for r in df.select(column).sample(share, 17).limit(256 * n).collect() if r[0] is not None})
    return sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []


def smallest(df: DataFrame, column: str, count: int, rows: int) -> DataFrame:
    """The `count` rows of `df` (about `rows` in all) with the smallest distinct
    `column`, found without sorting the table in one place."""
    cut = df.withColumn(_PIECE, piece(F.col(column), text_cuts(df, column, rows)))
    sizes = dict(sorted((r[0], r[1]) for r in cut.groupBy(_PIECE).count().collect()))
    whole, left = [], count
    for p, size in sizes.items():
        if size > left:
            break
        whole.append(p)
        left -= size
    partial = next((p for p in sizes if p not in whole), None)
    rank = F.row_number().over(W.partitionBy(_PIECE).orderBy(column))
    full = cut.where(F.col(_PIECE).isin(whole)) if whole else cut.where(F.lit(False))
    if not left or partial is None:
        return full.drop(_PIECE)
    rest = cut.where(F.col(_PIECE) == partial).withColumn("_rank", rank).where(F.col("_rank") <= left)
    return full.unionByName(rest.drop("_rank")).drop(_PIECE)
