"""Event history whose reading cost does not grow with its age.

Rows are kept by the day of their event time. From time to time the history is rolled: totals per payer, payee, pair and
owner of everything before a day are written as a snapshot, built from the one before and the rows since. A batch then
reads the newest snapshot that ends a full window before its earliest row, in the buckets of its own parties only, and
the rows since; nothing older is opened. Rows that arrive after a roll but belong before it are told apart by the epoch
(the number of rolls so far) they were written in, and are read beside every snapshot that lacks them.

A transaction id counts as known while its event is among the rows read, that is for a full window at least, and for
good where no snapshot is old enough. Rows written by a repeated micro-batch carry its name and are not in its own way."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import EVENT
from ..session import materialize, scratch
from .decision_log import BROADCAST_ROWS, EventHistory

WINDOW_DAYS = 30
_INDEX = "epoch int, as_of timestamp, buckets int, path string"
# Totals per side: key columns, the column that deals out buckets, and the folds.
_N, _LAST = "sum(n) AS n", "max(last_us) AS last_us"
SIDES = {
    "payers": (["payer_vpa"], "payer_vpa", [_N, _LAST]),
    "owners": (["payer_vpa", "device_id"], "payer_vpa", [_N, _LAST]),
    "pairs": (["payer_vpa", "payee_vpa"], "payer_vpa", [_N, _LAST]),
    "payees": (["payee_vpa"], "payee_vpa", [_N, "min(first_us) AS first_us", "sum(p2m) AS p2m", f"CAST(sum(total) AS {C.TOTAL}) AS total",
                                            f"CAST(sum(squares) AS {C.SQUARES}) AS squares"]),
}
# pairs are looked up from both ends
PLACES = {**{side: (side, bucket) for side, (_, bucket, _) in SIDES.items()}, "pairs_of_payee": ("pairs", "payee_vpa")}


@dataclass(frozen=True)
class Base:
    """A snapshot: totals of all rows before `as_of` that were there when epoch `epoch` began."""
    epoch: int
    as_of: datetime
    buckets: int
    path: str


def _totals(rows: DataFrame) -> DataFrame:
    """Each event as the change it makes to its keys' totals."""
    us = C.micros("ts")
    return rows.select("payer_vpa", "payee_vpa", "device_id", F.lit(1).cast("long").alias("n"), us.alias("first_us"), us.alias("last_us"),
                       F.when(F.col("txn_type") == "P2M", 1).otherwise(0).cast("long").alias("p2m"),
                       C.exact("amount").alias("total"), C.exact_square("amount").alias("squares"))


class TieredHistory(EventHistory):
    def __init__(self, spark: SparkSession, path: str, every_days: int = 30, keep: int = 3, rows_per_bucket: int = 200_000, grain: str = "day"):
        """`every_days`: how far apart snapshots are; `keep`: how many of them late rows can be read against; `grain`: the
        time span of one folder."""
        super().__init__(spark, f"{path}/rows", grain)
        self.root, self.every, self.keep, self.rows_per_bucket = path, every_days, keep, rows_per_bucket

    # ---- snapshots ----

    def bases(self) -> list[Base]:
        """Snapshots by epoch."""
        try:
            rows = self.spark.read.schema(_INDEX).json(f"{self.root}/index").collect()     # one row per roll
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((Base(r.epoch, r.as_of.astimezone(timezone.utc), r.buckets, r.path) for r in rows), key=lambda b: b.epoch)

    def base_for(self, earliest: datetime) -> Base | None:
        """The newest kept snapshot that ends a window before the moment."""
        fit = [b for b in self.bases()[-self.keep:] if b.as_of + timedelta(days=WINDOW_DAYS) <= earliest]
        return fit[-1] if fit else None

    def since(self, base: Base | None) -> DataFrame | None:
        """The rows a snapshot does not hold; all rows without one. Only their folders are opened."""
        rows = self.read()
        if rows is None or base is None:
            return rows
        start = F.lit(base.as_of).cast("timestamp")
        recent = (F.col("period") >= F.to_date(F.date_trunc(self.grain, start))) & (F.col("ts") >= start)
        return rows.where(recent | (F.col("epoch") >= base.epoch))

    def totals(self, base: Base, side: str, keys: DataFrame | None = None) -> DataFrame:
        """Totals of a side, of all keys or of those in `keys` (one distinct column), whose buckets alone are opened."""
        _, bucket = PLACES[side]
        rows = self.spark.read.parquet(f"{base.path}/{side}")
        if keys is not None:
            wanted = [r[0] for r in keys.select(F.pmod(F.xxhash64(bucket), F.lit(base.buckets)).cast("int").alias("b")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(wanted)).join(keys, bucket, "left_semi")
        return rows.drop("bucket")

    def roll(self, as_of: datetime) -> Base:
        """Write the totals of all rows before a day, from the newest snapshot and the rows since."""
        known = self.bases()
        last = known[-1] if known else None
        if last and as_of <= last.as_of:
            raise ValueError(f"already rolled to {last.as_of}")
        # one stored table, as every side reads it; rows of the snapshot come in as the totals they are
        moved = materialize(_totals(self.since(last).where(F.col("ts") < F.lit(as_of))))
        new = {}
        for side, (keys, _, folds) in SIDES.items():
            rows = moved
            if last:
                rows = rows.unionByName(self.totals(last, side).drop("payers"), allowMissingColumns=True)
            new[side] = rows.groupBy(*keys).agg(*map(F.expr, folds))
        new["pairs"] = materialize(new["pairs"])
        new["payees"] = new["payees"].join(new["pairs"].groupBy("payee_vpa").agg(F.count("*").alias("payers")), "payee_vpa")
        buckets = max(1, -(-new["pairs"].count() // self.rows_per_bucket))
        path = f"{self.root}/snapshots/{scratch(self.spark).rsplit('/', 1)[1]}"
        for place, (side, bucket) in PLACES.items():
            (new[side].withColumn("bucket", F.pmod(F.xxhash64(bucket), F.lit(buckets)).cast("int"))
             .repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{place}"))
        base = Base((last.epoch if last else 0) + 1, as_of, buckets, path)
        # the snapshot counts from here on; one that broke off before is never read
        self.spark.createDataFrame([(base.epoch, base.as_of, base.buckets, base.path)], _INDEX).write.mode("append").json(f"{self.root}/index")
        return base

    def roll_if_due(self, newest: datetime) -> Base | None:
        """Roll to the last multiple of `every_days` that ends a window before the newest row."""
        days = int((newest - timedelta(days=WINDOW_DAYS)).timestamp() // 86_400) // self.every * self.every
        as_of = datetime.fromtimestamp(days * 86_400, timezone.utc)
        known = self.bases()
        # a first snapshot has to hold something
        if known and as_of <= known[-1].as_of or self.read() is None or self.read().where(F.col("ts") < F.lit(as_of)).isEmpty():
            return None
        return self.roll(as_of)

    # ---- batches ----

    def append(self, batch: DataFrame, base: Base | None = None, name: str | None = None) -> None:
        """Rows whose id is not known yet; `base` must be one that `base_for` gives for the batch or an older one."""
        if batch.isEmpty():
            return
        rest = F.struct(*EVENT.names)
        rows = batch.groupBy("txn_id").agg(F.min_by(rest, F.struct("ts", F.xxhash64(F.to_json(rest)))).alias("r")).select("r.*")
        stored = self.since(base)
        if stored is not None:
            ids = rows.select("txn_id")
            small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            rows = rows.join(stored.select("txn_id").join(F.broadcast(ids) if small else ids, "txn_id", "left_semi"), "txn_id", "left_anti")
        epoch = max([b.epoch for b in self.bases()], default=0)
        rows = rows.withColumns({"batch": F.lit(name).cast("string"), "epoch": F.lit(epoch), "period": self._period()})
        rows.hint("rebalance", "epoch", "period").write.mode("append").partitionBy("epoch", "period").parquet(self.path)
