"""Windowed as-of reads kept in the state store: per payer, pair or device.

The state of a key is its rows of the longest window and some slack, and totals of all time. A row is answered from the
rows strictly before its moment, whatever order they arrived in: counts and sums are differences of running totals at the
two ends of each window, distinct counterparts the stretches of rows at most a window apart that are open at the moment.
So rows of equal moments never see each other, also across micro-batches, and a row that is late by no more than the slack is
answered exactly.

Keys are dealt to slots by hash, and slots to buckets. A bucket is one group of the stream, a slot one entry of its state, and
all keys of a slot are answered at once: the calls to the state store go with the slots a batch touches, not with its keys.
Rows leave the state with the next row of their slot or, where none comes, by an event-time timer of the bucket, which looks
through it once in a window and slack.

The watermark trails the newest event by the slack. Rows later than that are not answered here: the state that they
would need is gone; they go through the batch plan."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import DAY, HOUR, MONTH
from ..session import ship

ship(__name__)

#: Amounts are kept as whole millionths, so that a sum loses nothing when a row leaves it.
GRID = 1_000_000
BUCKETS, SLOTS = 128, 16
#: Stands for no moment.
NEVER = -(1 << 62)


@dataclass(frozen=True)
class Side:
    """What is read for a key: counts, sums of amounts and distinct `other`s, each as name -> window."""
    key: tuple[str, ...]
    other: str
    counts: dict[str, int]
    sums: dict[str, int]
    distinct: dict[str, int]
    name: str

    @property
    def horizon(self) -> int:
        return max([0, *self.counts.values(), *self.sums.values(), *self.distinct.values()])

    @property
    def schema(self) -> str:
        longs = [f"{self.name}_n", f"{self.name}_last_us", *self.counts, *self.distinct]
        return ", ".join(["txn_id string", *[f"{c} long" for c in longs], *[f"{c} double" for c in self.sums]])


PAYER = Side(("payer_vpa",), "payee_vpa", {"payer_n_1h": HOUR, "payer_n_24h": DAY, "payer_n_30d": MONTH}, {"payer_sum_30d": MONTH},
             {"payer_payees_24h": DAY}, "payer")
PAIR = Side(("payer_vpa", "payee_vpa"), "device_id", {}, {}, {}, "pair")
DEVICE = Side(("device_id",), "payer_vpa", {"device_n_1h": HOUR}, {}, {"device_payers_30d": MONTH}, "device")


class Moments:
    """Moments of many keys: how many lie before a moment of a key, those of all smaller keys included."""

    def __init__(self, key: np.ndarray, us: np.ndarray):
        self.known = np.unique(us)
        self.at = np.sort(key * (len(self.known) + 1) + np.searchsorted(self.known, us))

    def before(self, key: np.ndarray, us: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, key * (len(self.known) + 1) + np.searchsorted(self.known, us, "left"), "left")


def stretches(key: np.ndarray, us: np.ndarray, other: np.ndarray, window: int) -> tuple[Moments, Moments]:
    """When a key's counterpart starts and stops to count: it counts at t if started before t and not stopped before t."""
    by = np.lexsort((us, other, key))
    k, t, o = key[by], us[by], other[by]
    apart = (k[1:] != k[:-1]) | (o[1:] != o[:-1]) | (t[1:] - t[:-1] > window)
    first, last = np.r_[True, apart], np.r_[apart, True]
    return Moments(k[first], t[first]), Moments(k[last], t[last] + window)


def answers(side: Side, key: np.ndarray, us: np.ndarray, micros: np.ndarray, other: np.ndarray, asks: np.ndarray,
            at: np.ndarray) -> dict[str, list]:
    """Windowed reads of the keys `asks` at the moments `at`, from rows sorted by (key, us)."""
    held = Moments(key, us)
    before = held.before(asks, at)
    out = {name: before - held.before(asks, at - w) for name, w in side.counts.items()}
    if side.sums:
        # whole numbers of any size where 64 bits might not do
        large = len(micros) * int(np.abs(micros).max(initial=0)) >= 1 << 62
        running = np.concatenate([[0], np.cumsum(micros.astype(object) if large else micros)])
        for name, w in side.sums.items():
            out[name] = [x / GRID for x in (running[before] - running[held.before(asks, at - w)]).tolist()]
    for name, w in side.distinct.items():
        starts, stops = stretches(key, us, other, w)
        first = lambda m: np.searchsorted(m.at, asks * (len(m.known) + 1), "left")
        out[name] = (starts.before(asks, at) - first(starts)) - (stops.before(asks, at) - first(stops))
    return out


def packed(columns: dict) -> bytes:
    """Columns as the bytes of an Arrow stream."""
    rows = pa.record_batch(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(found: tuple | None, columns: dict) -> list:
    """The columns of `packed`; empty ones of the given types where nothing is stored."""
    if found is None:
        return [pa.array([], kind) for kind in columns.values()]
    rows = pa.ipc.open_stream(bytes(found[0])).read_next_batch()
    return [rows.column(c) for c in columns]


_TOTALS = {"key": pa.string(), "n": pa.int64(), "last_us": pa.int64(), "gone_last_us": pa.int64()}
_RECENT = {"key": pa.int64(), "us": pa.int64(), "micros": pa.int64(), "other": pa.string()}


class WindowHistory(StatefulProcessor):
    def __init__(self, side: Side, slack: int):
        self.side, self.slack = side, slack
        self.reach = side.horizon + slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # per slot: totals of its keys, and their rows with the key's place among the totals
        self.totals = handle.getMapState("totals", "slot int", "packed binary")
        self.recent = handle.getMapState("recent", "slot int", "packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["slot", "us", "txn_id"])
        if not list(self.handle.listTimers()):
            self.handle.registerTimer((int(batch["us"].max()) + self.reach) // 1000 + 1)
        yield pd.concat([self._slot(int(slot), part) for slot, part in batch.groupby("slot", sort=False)])

    def _load(self, slot: int) -> tuple[list, ...]:
        keys, *totals = unpacked(self.totals.getValue((slot,)), _TOTALS)
        *rows, other = unpacked(self.recent.getValue((slot,)), _RECENT)
        return (keys.to_pylist(), *[x.to_numpy(zero_copy_only=False) for x in (*totals, *rows)], other.to_pylist())

    def _slot(self, slot: int, batch: pd.DataFrame) -> pd.DataFrame:
        side = self.side
        keys, n, last, gone, key, us, micros, other = self._load(slot)
        at = batch["us"].to_numpy(np.int64)
        codes, found = pd.factorize(batch["key"])
        place = {k: i for i, k in enumerate(keys)}
        asks = np.array([place.setdefault(k, len(place)) for k in found], np.int64)[codes]
        new = len(place) - len(keys)
        n, last, gone = (np.concatenate([x, np.full(new, y, np.int64)]) for x, y in ((n, 0), (last, NEVER), (gone, NEVER)))
        key, us = np.concatenate([key, asks]), np.concatenate([us, at])
        micros = np.concatenate([micros, (batch["amount"] * GRID).round().astype("int64").to_numpy()])
        other = np.array([x or "" for x in [*other, *batch["other"].tolist()]], object)
        by = np.lexsort((us, key))
        key, us, micros, other = key[by], us[by], micros[by], other[by]
        out = answers(side, key, us, micros, pd.factorize(other)[0], asks, at)
        held = Moments(key, us)
        pos, start = held.before(asks, at), np.searchsorted(key, asks, "left")
        np.add.at(n, asks, 1)
        # what is no longer held lies before everything that can still be asked
        out[f"{side.name}_n"] = n[asks] - (np.searchsorted(key, asks, "right") - start) + (pos - start)
        newest = np.where(pos > start, us[np.maximum(pos - 1, 0)], gone[asks])
        out[f"{side.name}_last_us"] = pd.array(newest, "Int64")
        out[f"{side.name}_last_us"][newest == NEVER] = pd.NA
        out["txn_id"] = batch["txn_id"].to_numpy()
        np.maximum.at(last, key, us)
        self._keep(slot, list(place), n, last, gone, key, us, micros, other)
        return pd.DataFrame(out)[[c.split()[0] for c in side.schema.split(", ")]]

    def _keep(self, slot: int, keys, n, last, gone, key, us, micros, other, until: int = NEVER) -> bool:
        """Hold the rows that a row within the slack can still ask for; whether there are any."""
        kept = us >= np.maximum(last, until)[key] - self.reach
        np.maximum.at(gone, key[~kept], us[~kept])
        self.totals.updateValue((slot,), (packed({"key": pa.array(keys, pa.string()), "n": n, "last_us": last, "gone_last_us": gone}),))
        if kept.any():
            rows = {"key": key[kept], "us": us[kept], "micros": micros[kept], "other": pa.array(other[kept], pa.string())}
            self.recent.updateValue((slot,), (packed(rows),))
        elif self.recent.containsKey((slot,)):
            self.recent.removeKey((slot,))
        return bool(kept.any())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Rows that nothing can ask for again leave, whether or not their key had another row."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        left = False
        for (slot,) in list(self.recent.keys()):
            keys, n, last, gone, place, us, micros, other = self._load(slot)
            left |= self._keep(slot, keys, n, last, gone.copy(), place, us, micros, np.array(other, object), now)
        if left:
            self.handle.registerTimer((now + self.reach) // 1000 + 1)
        return iter([])

    def close(self) -> None:
        pass


def window_reads(events: DataFrame, side: Side, slack: int = DAY) -> DataFrame:
    """As-of reads of one side for a stream of events with `ts`. Needs the RocksDB state store provider on the session."""
    slot = F.pmod(F.xxhash64(*side.key), F.lit(BUCKETS * SLOTS)).cast("int")
    key = F.to_json(F.struct(*side.key), {"ignoreNullFields": "false"})
    return (events.withWatermark("ts", f"{slack} microseconds")
            .select("txn_id", "ts", key.alias("key"), slot.alias("slot"), F.unix_micros("ts").alias("us"), "amount", F.col(side.other).alias("other"))
            .withColumn("bucket", F.floor(F.col("slot") / SLOTS).cast("int"))
            .groupBy("bucket")
            .transformWithStateInPandas(WindowHistory(side, slack), side.schema, "Append", "EventTime"))
