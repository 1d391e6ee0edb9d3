"""Sliding medians of keys too large for one task.

Each row asks for one or two ranks among the values of its window. The values of
a key are cut at about equal shares; running counts per bin, read at the row's
time, tell which bin holds the rank and the rank left inside it. Rows whose rank
falls on a cut value are answered; the others go on inside their bin. Bins
shrink with every round until they are short lists. Rows are never gathered by
key: each round is a keyed running count over time slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .asof import HOUR, Move, Track, running
from .median import sliding_median

FAN = 32                # value ranges per round
SHORT = 256             # bins of at most this many rows are searched as lists
_SHIFT = 128            # room for the bin number in the path; at most nine rounds


def split_median(rows: DataFrame, key: str, value: str, window: int | None, out: str, hot: str,
                 width: int = HOUR, fan: int = FAN, short: int = SHORT) -> DataFrame:
    """`sliding_median` for rows of which some keys are flagged `hot`."""
    cold = rows.where(~F.col(hot)).repartition(key).sortWithinPartitions(key, "us")
    big = rows.where(hot)
    found = hot_median(big.select(key, "us", "txn_id", value), key, value, window, width, fan, short)
    return sliding_median(cold, key, value, window, out).unionByName(
        big.join(found.withColumnRenamed("median", out), "txn_id", "left"))


def _counted(rows: DataFrame, group: list[str], changes: dict[str, Column], window: int | None, width: int) -> DataFrame:
    """Counts inside the window before each row; probes do not count."""
    real = ~F.col("is_probe")
    moves = [Move(0, changes, real)]
    if window is not None:
        moves.append(Move(window, {n: -c for n, c in changes.items()}, real))
    return running(rows.withColumn("_hot", F.lit(True)), group, [Track(n) for n in changes], moves, "_hot", width)


def _find(counts: list[str], k: Column) -> Column:
    """(bin, rank left inside it) of the k-th value given the counts per bin."""
    arr = F.array(*[F.col(c) for c in counts])
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("bin"), F.lit(0).cast("long").alias("left"))

    def step(s, i):
        upto = s["seen"] + arr[i]
        hit = F.struct(s["seen"].alias("seen"), i.alias("bin"), (k - s["seen"]).alias("left"))
        go = F.struct(upto.alias("seen"), F.lit(-1).alias("bin"), F.lit(0).cast("long").alias("left"))
        return F.when(s["bin"] >= 0, s).when(upto > k, hit).otherwise(go)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(counts) - 1)), start, step)


def hot_median(rows: DataFrame, key: str, value: str, window: int | None, width: int = HOUR,
               fan: int = FAN, short: int = SHORT) -> DataFrame:
    """(txn_id, median) over [us - window, us), all time without a window, for
    every row that has one. A row without a value only asks."""
    rows = rows.withColumnRenamed(key, "_key")
    group = ["_key", "path"]
    sized = _counted(rows.withColumn("is_probe", F.col(value).isNull()), ["_key"],
                     {"n": F.lit(1)}, window, width).where("n > 0")
    n = F.col("n")
    ask = materialize(sized.select(
        "_key", F.lit(0).cast("long").alias("path"), "us", "txn_id",
        F.explode(F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2)))).alias("k")))
    data = materialize(rows.where(F.col(value).isNotNull()).select(
        "_key", F.lit(0).cast("long").alias("path"), "us", F.col(value).alias("x")))
    answers = []
    while True:
        top = data.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        if top <= short:
            break
        cut = data.groupBy(*group).agg(F.array_sort(F.array_distinct(F.percentile_approx(
            "x", [i / fan for i in range(1, fan)], 10_000))).alias("cut"))
        place = (F.size(F.filter("cut", lambda p: p <= F.col("x"))) + F.size(F.filter("cut", lambda p: p < F.col("x"))))
        data = materialize(data.join(cut, group).withColumn("bin", place).drop("cut"))
        both = data.select(*group, "us", "bin", F.lit(False).alias("is_probe")).unionByName(
            ask.select(*group, "us", "txn_id", "k", F.lit(True).alias("is_probe")), allowMissingColumns=True)
        bins = {f"c{i}": F.when(F.col("bin") == i, 1).otherwise(0) for i in range(2 * fan - 1)}
        read = _counted(both, group, bins, window, width).where("is_probe")
        read = materialize(read.select(*group, "us", "txn_id", _find(list(bins), F.col("k")).alias("f")))
        # odd bins are single cut values: the answer itself
        on_cut = read.where("f.bin % 2 = 1")
        exact = data.where("bin % 2 = 1").select(*group, "bin", "x").distinct()
        answers.append(on_cut.select(*group, F.col("f.bin").alias("bin"), "txn_id").join(exact, [*group, "bin"])
                       .select("txn_id", "x"))
        deeper = F.col("path") * _SHIFT + F.col("f.bin") + 1
        ask = materialize(read.where("f.bin % 2 = 0").select(
            "_key", deeper.alias("path"), "us", "txn_id", F.col("f.left").alias("k")))
        data = materialize(data.where("bin % 2 = 0").select(
            "_key", (F.col("path") * _SHIFT + F.col("bin") + 1).alias("path"), "us", "x").join(
            ask.select(*group).distinct(), group, "left_semi"))
    lists = data.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("x", "us"))).alias("l"))      # at most `short`
    low = F.lit(-(1 << 62)) if window is None else F.col("us") - window
    inside = F.filter("l", lambda e: (e["us"] >= low) & (e["us"] < F.col("us")))
    answers.append(ask.join(lists, group).select("txn_id", inside[F.col("k").cast("int")]["x"].alias("x")))
    return reduce(DataFrame.unionByName, answers).groupBy("txn_id").agg(F.avg("x").alias("median"))
