"""Running payee history kept in the state store, for low latency.

Each payee's count, first time, amount sums, P2M count and set of payers live in
the state store and are read before the row is added. Rows of one batch are taken
in time order and rows of one moment do not see each other. A row that is not newer
than all of earlier batches is flagged `late`: its figures may include rows of its
own moment or later, so it should be read through the batch plan instead."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from .window_state import packed, unpacked

ship(__name__)

OUTPUT = ("txn_id string, payee_vpa string, payee_n long, payee_first_us long, payee_payers long, payee_sum double, "
          "payee_p2m long, late boolean")


#: A payee's payers are kept in so many lists, by hash: a batch reads the lists of its own payers, each with one call.
SLOTS = 16
_PAYERS = {"payer": pa.string()}


class PayeeHistory(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n long, first_us long, last_us long, payers long, total double, p2m long")
        self.payers = handle.getMapState("payer_lists", "slot int", "packed binary")

    def _unseen(self, batch: pd.DataFrame) -> np.ndarray:
        """Marks the first row of every payer that the payee did not have before, and takes those payers in."""
        first = ~batch["payer_vpa"].duplicated().to_numpy()
        fresh = np.zeros(len(batch), bool)
        for slot, part in batch.assign(place=np.arange(len(batch)))[first].groupby("slot", sort=False):
            known = unpacked(self.payers.getValue((int(slot),)), _PAYERS)[0].to_pylist()
            held = set(known)
            new = [x not in held for x in part["payer_vpa"].tolist()]
            fresh[part["place"].to_numpy()[new]] = True
            if any(new):
                self.payers.updateValue((int(slot),), (packed({"payer": pa.array(known + part["payer_vpa"][new].tolist(), pa.string())}),))
        return fresh

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).dropna(subset="us").sort_values(["us", "txn_id"])
        if not len(batch):
            return
        n, first, last, payers, total, p2m = self.totals.get() if self.totals.exists() else (0, None, None, 0, 0.0, 0)
        us = batch["us"].to_numpy(np.int64)
        start = np.searchsorted(us, us, "left")            # rows of one moment stand after the same earlier ones
        running = lambda x, begin: np.concatenate([[begin], x]).cumsum()
        seen = running(self._unseen(batch), payers)
        sums = running(batch["amount"].to_numpy(np.float64), total)
        goods = running((batch["txn_type"] == "P2M").to_numpy(), p2m)
        earliest = int(us[0]) if first is None else min(first, int(us[0]))
        known = pd.array(np.full(len(us), earliest), "Int64")
        known[start == 0] = pd.NA if first is None else first
        late = np.full(len(us), False) if last is None else us <= last
        self.totals.update((int(n + len(us)), earliest, int(us[-1]) if last is None else max(int(us[-1]), last), int(seen[-1]), float(sums[-1]), int(goods[-1])))
        yield pd.DataFrame({"txn_id": batch["txn_id"].to_numpy(), "payee_vpa": key[0], "payee_n": n + start, "payee_first_us": known,
                            "payee_payers": seen[start], "payee_sum": sums[start], "payee_p2m": goods[start], "late": late})

    def close(self) -> None:
        pass


def payee_reads(events: DataFrame) -> DataFrame:
    """As-of payee reads of a stream of events with `us`. Needs the RocksDB
    state store provider on the session."""
    slot = F.pmod(F.xxhash64("payer_vpa"), F.lit(SLOTS)).cast("int").alias("slot")
    return (events.select("txn_id", "payee_vpa", "payer_vpa", "amount", "txn_type", "us", slot).groupBy("payee_vpa")
            .transformWithStateInPandas(PayeeHistory(), OUTPUT, "Append", "None"))
