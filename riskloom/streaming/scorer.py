"""Stream scoring: the batch plan run on each micro-batch.

Delivery is at least once and the outcome is one decision per transaction: the
source offsets live in the checkpoint, repeated messages are dropped inside the
batch and against both tables, and a batch that is run again after a crash
writes what is still missing. There is no watermark: every event is scored as of
its own timestamp against what is recorded by then.

With a `TieredHistory`, a batch opens the rows of about the last two windows, the
snapshot buckets of its own parties and one period of the log, however old the
tables are; with an `EventHistory` it reads all of both."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import policy
from ..functions.columns import AMOUNT
from ..operators.features import first_per_txn
from ..operators.validate import split_events
from ..plans.scoring import decisions, features_from, features_of
from ..session import materialize
from ..sources.decision_log import DecisionLog, EventHistory
from ..sources.events import encode
from ..sources.tiered import TieredHistory


def _told(events: DataFrame, reason: str) -> DataFrame:
    return events.select(encode().alias("event"), F.lit(reason).alias("reason"))


class Scorer:
    """Everything a micro-batch needs; `step` is the foreachBatch function."""

    def __init__(self, history: EventHistory, log: DecisionLog, models, thresholds: policy.Thresholds,
                 dead_letters: str, stats: str | None = None, source: str = "worker",
                 now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.history, self.log, self.models, self.thresholds = history, log, models, thresholds
        self.dead_letters, self.stats, self.source, self.now = dead_letters, stats, source, now

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """Rows that cannot be scored are set aside one by one. Any other error
        goes up and fails the query: nothing is lost, since the checkpoint
        starts the same batch again."""
        messages = materialize(batch.select("event"))
        good, bad = split_events(messages, labels=True)
        self._bury(bad, batch_id, "rejected")
        fits = F.col("amount").try_cast(AMOUNT).isNotNull()      # also keeps NaN out of the sums other rows read
        self._bury(_told(good.where(~fits), "amount out of range"), batch_id, "out_of_range")
        self._score(good.where(fits), batch_id)

    def _score(self, good: DataFrame, batch_id: int) -> None:
        events = materialize(first_per_txn(good))
        run = events.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        name = f"{run}/{batch_id}"
        tiered = isinstance(self.history, TieredHistory)
        if tiered:
            span = events.agg(F.min("ts"), F.max("ts")).first()
            if span[0] is None:
                return
            base = self.history.base_for(span[0].astimezone(timezone.utc))
            at = self._begun(events.sparkSession, name)
            fresh = self._unknown(events, base, name)
            wide = features_from(fresh, self.history, base)
        else:
            at = self.now()
            fresh = events if self.log.read() is None else events.join(
                self.log.new_rows(events.withColumn("scored_at", F.col("ts"))).select("txn_id"), "txn_id", "left_semi")
            wide = features_of(fresh, self.history.read())
        out = materialize(decisions(fresh, wide, self.models, self.thresholds, self.source, at, batch=name))
        scored = F.col("action").isNotNull()
        unscored = out.where(~scored).select("event.*")
        self._bury(_told(unscored, "no score"), batch_id, "unscored")
        kept = events.join(unscored.select("txn_id"), "txn_id", "left_anti")
        if tiered:
            # a repeated batch has the moment of its first run, so its rows can only be in that one period
            self.log.append(out.where(scored), own_periods=True)
            self.history.append(kept, base, name)
            self.history.roll_if_due(span[1].astimezone(timezone.utc))
        else:
            self.log.append(out.where(scored))
            self.history.append(kept)
        if self.stats:
            # counted from the log, so a batch that is repeated after the log was written counts the same rows
            logged = self.log.read()
            logged = out.where(scored) if logged is None else logged      # nothing was ever scored
            if tiered and "period" in logged.columns:
                logged = logged.where(F.col("period") == F.to_date(F.date_trunc(self.log.grain, F.lit(at).cast("timestamp"))))
            logged.where(F.col("batch") == name).groupBy("action").agg(F.count("*").alias("n")).write.mode(
                "overwrite").json(f"{self.stats}/batch_id={batch_id}")

    def _unknown(self, events: DataFrame, base, name: str) -> DataFrame:
        """Rows that no other batch has recorded. What this batch itself recorded
        before it broke off is scored again, the same way."""
        known = self.history.since(base)
        if known is None:
            return events
        others = known.where(~F.col("batch").eqNullSafe(F.lit(name))).select("txn_id")
        return materialize(events.join(others, "txn_id", "left_anti"))

    def _begun(self, spark, name: str) -> datetime:
        """The moment of the batch's first run, noted before anything is written."""
        path = f"{self.log.path}-begun/{name}"
        try:
            first = spark.read.schema("at timestamp").json(path).agg(F.min("at")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            first = None
        if first is not None:
            return first.astimezone(timezone.utc)
        at = self.now()
        spark.createDataFrame([(at,)], "at timestamp").write.mode("overwrite").json(path)
        return at

    def _bury(self, rows: DataFrame, batch_id: int, kind: str) -> None:
        # overwriting the batch's own folder keeps a repeated batch from doubling it
        rows.withColumn("retries", F.lit(0)).write.mode("overwrite").json(
            f"{self.dead_letters}/batch_id={batch_id}/{kind}")

    def start(self, messages: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = messages.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()


def read_dead_letters(spark, path: str) -> DataFrame:
    return spark.read.schema("event string, reason string, retries int").option(
        "recursiveFileLookup", True).json(path)


def throughput(query: StreamingQuery) -> list[tuple[int, float]]:
    """(batch id, rows per second) of the batches the query still remembers."""
    return [(p["batchId"], p["processedRowsPerSecond"]) for p in query.recentProgress if p["numInputRows"]]


def without_repeats(events: DataFrame, horizon: str) -> DataFrame:
    """A stream with repeated deliveries dropped inside a bounded time horizon."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["txn_id"])


def replay_in_order(events: DataFrame, write: Callable[[DataFrame, str], None], path: str, files: int,
                    limit: int | None = None) -> None:
    """Write an event set as message files in event-time order, `files` time
    slices one after the other, optionally only the first `limit` events."""
    rows = events
    if limit is not None:
        rows = rows.orderBy("ts", "txn_id").limit(limit)
    rows = materialize(rows)
    span = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if span[0] is None:
        return
    width = (span[1] - span[0]) // files + 1
    for i in range(files):
        at = F.unix_micros("ts")
        lo = span[0] + i * width
        write(rows.where((at >= lo) & (at < lo + width)), path)
