"""The append-only decision table and the other idempotent writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.monitor import review_split
from ..schema import SOURCES

BROADCAST_ROWS = 1_000_000


class AppendOnly:
    """A Parquet table keyed by txn_id where the first row of a key wins.

    Only appending is offered: rows are never updated or removed. One writer
    at a time; a batch that was cut short can be written again."""

    day_of = "ts"

    def __init__(self, spark: SparkSession, path: str, grain: str = "day"):
        """`grain` is the time span of one partition folder, e.g. day or month."""
        self.spark, self.path, self.grain = spark, path, grain

    def read(self) -> DataFrame | None:
        """The table, or None before the first append. A folder whose first
        append broke off holds neither data nor the marker of a finished
        write; one that was emptied later, or cannot be read, is an error."""
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as error:
            kind = error.getCondition()
            if kind == "PATH_NOT_FOUND" or kind == "UNABLE_TO_INFER_SCHEMA" and not self._written():
                return None
            raise

    def _written(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(self.path, "_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def new_rows(self, batch: DataFrame, own_periods: bool = False) -> DataFrame:
        """The batch without repeats and without keys that are already stored;
        with `own_periods`, keys are looked for in the batch's own periods only,
        for writers that know where a repeat of a row would be."""
        rest = F.struct(*batch.columns)
        first = batch.groupBy("txn_id").agg(
            F.min_by(rest, F.struct(self.day_of, F.xxhash64(F.to_json(rest)))).alias("r")).select("r.*")
        stored = self.read()
        if stored is None:
            return first
        if own_periods:
            # one value per time folder that the batch writes to
            spans = [r[0] for r in first.select(self._period()).distinct().collect()]
            stored = stored.where(F.col("period").isin(spans))
        ids = first.select("txn_id")
        # A micro-batch is checked against the stored key column in place; a
        # large one is left to a shuffled join.
        small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        known = stored.select("txn_id").join(F.broadcast(ids) if small else ids, "txn_id", "left_semi")
        return first.join(known, "txn_id", "left_anti")

    def _period(self):
        return F.to_date(F.date_trunc(self.grain, self.day_of)).alias("period")

    def append(self, batch: DataFrame, own_periods: bool = False) -> None:
        if batch.isEmpty():
            return
        rows = self.new_rows(batch, own_periods).select("*", self._period())
        # rebalance splits large periods over tasks and gathers small ones
        rows.hint("rebalance", "period").write.mode("append").partitionBy("period").parquet(self.path)

    def fingerprint(self) -> DataFrame:
        """Row count and content hash per period; equal before and after any
        append for the periods it did not touch."""
        df = self.read()
        rows = F.xxhash64(F.to_json(F.struct(*[c for c in df.columns if c != "period"])))
        return df.groupBy("period").agg(F.count("*").alias("n"), F.bit_xor(rows).alias("content"))


class EventHistory(AppendOnly):
    """The stored events that features are computed from."""


class DecisionLog(AppendOnly):
    day_of = "scored_at"

    def append(self, batch: DataFrame, own_periods: bool = False) -> None:
        bad = batch.where(~F.col("source").isin(*SOURCES) | F.col("source").isNull())
        if not bad.isEmpty():
            raise ValueError(f"source must be one of {SOURCES}")
        super().append(batch, own_periods)

    def find(self, txn_id: str) -> DataFrame:
        return self.read().where(F.col("txn_id") == txn_id)

    def count(self, txn_id: str) -> int:
        stored = self.read()
        return 0 if stored is None else self.find(txn_id).count()


class ReviewLabels:
    """The reviewers' labels: every accepted label is a row, later ones stand beside earlier ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        return AppendOnly(self.spark, self.path).read()

    def append(self, labels: DataFrame, decisions: DataFrame) -> DataFrame:
        """Append the labels that name a known disposition and decision; the others come back with their reason."""
        good, bad = review_split(labels, decisions)
        rows = good.select("*", F.to_date("reviewed_at").alias("period"))
        if not rows.isEmpty():
            rows.hint("rebalance", "period").write.mode("append").partitionBy("period").parquet(self.path)
        return bad


def write_report(df: DataFrame, folder: str, name: str, generated_at) -> str:
    """Append a report table as JSON, stamped with its time."""
    path = f"{folder}/{name}"
    df.withColumn("generated_at", F.lit(generated_at).cast("timestamp")).write.mode("append").json(path)
    return path


def latest_report(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    df = spark.read.schema(f"{schema}, generated_at timestamp").json(f"{folder}/{name}")
    return df.join(F.broadcast(df.agg(F.max("generated_at").alias("generated_at"))), "generated_at")
