"""Poisson bootstrap of ranking metrics, all replicates as one vector per group of equal rows.

Rows alike in score, label and (for frauds) amount are counted first. The times that n such rows enter a replicate sum up to a
Poisson draw of mean n, so a group needs one draw per replicate however many rows it has, and nothing is multiplied by
the replicates before it is summed. Draws come from a counter-based generator keyed by the group and the seed: a lost task
repeats them exactly. Groups lie in score order over range partitions; a first pass sums each partition, a second one
starts from the sums of the partitions before it. What reaches the driver is partitions x replicates numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship

#: Partitions at most, as each sends three vectors to the driver; groups drawn at once.
PARTS, ROWS = 256, 2000
_SUMS = "part int, n array<double>, pos array<double>, value array<double>"


def draws(keys: np.ndarray, n: np.ndarray, count: int, seed: int) -> np.ndarray:
    """How often the n rows of each group enter each replicate: groups x count."""
    out = np.empty((len(keys), count))
    for i, (k, m) in enumerate(zip(keys.view(np.uint64).tolist(), n.tolist())):
        out[i] = np.random.Generator(np.random.Philox(key=[k, seed])).poisson(m, count)
    return out


def _slices(batches, count, seed):
    """(part, scores, draws, draws of positives, value of positives) of up to ROWS groups."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part, score, pos, amount, n, key = (np.asarray(c) for c in b.slice(i, ROWS).columns)
            drawn = draws(key, n, count, seed)
            hit = drawn * (pos != 0)[:, None]
            yield int(part[0]), score, drawn, hit, hit * amount[:, None]


def _partition_sums(count, seed):
    def run(batches):
        part, total = None, np.zeros((3, count))
        for part, _, *drawn in _slices(batches, count, seed):
            total += [x.sum(0) for x in drawn]
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in total]],
                                             names=["part", "n", "pos", "value"])
    return run


def _metrics(before, want, count, seed):
    """Average precision and value within the first `want` rows, each as a sum over the partition's score groups."""
    def run(batches):
        at, out, part, open_, last = None, np.zeros((2, count)), None, None, None

        def close(groups):
            nonlocal at
            n, pos, value = groups                             # each: groups x count
            upto_n, upto_pos = at[0] + n.cumsum(0), at[1] + pos.cumsum(0)
            out[0] += (pos * np.divide(upto_pos, upto_n, out=np.zeros_like(n), where=upto_n > 0)).sum(0)
            share = np.divide(want - (upto_n - n), n, out=np.zeros_like(n), where=n > 0).clip(0, 1)
            out[1] += (value * share).sum(0)
            at = (upto_n[-1], upto_pos[-1])

        for part, score, *drawn in _slices(batches, count, seed):
            at = before[part] if at is None else at
            fresh = np.r_[True, score[1:] != score[:-1]]
            if open_ is not None and score[0] == last:         # the group goes on from the slice before
                drawn = [np.concatenate([o, x]) for o, x in zip(open_, drawn)]
                fresh = np.r_[True, False, fresh[1:]]
            elif open_ is not None:
                close(open_)
            starts = np.flatnonzero(fresh)
            groups = [np.add.reduceat(x, starts) for x in drawn]
            if len(starts) > 1:
                close([g[:-1] for g in groups])
            open_, last = [g[-1:] for g in groups], score[-1]
        if part is not None:
            close(open_)
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64())) for x in out], names=["ap", "value"])
    return run


def replicate_metrics(df: DataFrame, count: int = 1000, rate: float = 0.01, score="score", label="label", amount: str | None = None,
                      seed: int = 42) -> DataFrame:
    """replicate, pr_auc and amount_weighted_recall (of the top `rate` of the replicate's rows; those of one score enter in
    proportion) per replicate. NULL where a replicate has no positive, or no positive amount."""
    ship(__name__)
    spark = df.sparkSession
    pos = F.coalesce(F.col(label) == 1, F.lit(False))
    worth = F.when(pos, F.coalesce(F.col(amount).cast("double"), F.lit(0.0))).otherwise(0.0) if amount else F.lit(0.0)
    rows = df.select(F.col(score).cast("double").alias("s"), pos.cast("int").alias("pos"), worth.alias("amount"))
    groups = rows.groupBy("s", "pos", "amount").agg(F.count("*").alias("n")).withColumn("key", F.xxhash64("s", "pos", "amount"))
    parts = min(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(groups.repartitionByRange(parts, F.desc("s")).sortWithinPartitions(F.desc("s"), "pos", "amount")
                         .select(F.spark_partition_id().alias("part"), "s", "pos", "amount", "n", "key"))
    sums = sorted(placed.mapInArrow(_partition_sums(count, seed), _SUMS).collect(), key=lambda r: r["part"])
    before, run = {}, np.zeros((3, count))
    for r in sums:
        before[r["part"]] = (run[0], run[1])
        run = run + np.array([r["n"], r["pos"], r["value"]])
    want = np.maximum(1, np.round(run[0] * rate))          # halves to even, as elsewhere
    found = placed.mapInArrow(_metrics(before, want, count, seed), "ap array<double>, value array<double>").collect()
    ap, value = np.zeros((2, count)) if not found else np.sum([[r["ap"], r["value"]] for r in found], axis=0)
    ratio = lambda x, of: [a / b if b > 0 else None for a, b in zip(x.tolist(), of.tolist())]
    return spark.createDataFrame(list(zip(range(1, count + 1), ratio(ap, run[1]), ratio(value, run[2]))),
                                 "replicate long, pr_auc double, amount_weighted_recall double")
