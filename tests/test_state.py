"""The state processors without a stream: a stand-in for the state store counts the calls."""

import random

import pandas as pd
import pytest

from riskloom.streaming.window_state import DEVICE, PAIR, PAYER, WindowHistory

DAY = 24 * 3_600_000_000


class Store:
    def __init__(self):
        self.maps, self.timers, self.calls = {}, set(), 0

    def getMapState(self, name, key, value):
        return Map(self, self.maps.setdefault(name, {}))

    def getValueState(self, name, kind):
        return Value(self, self.maps.setdefault(name, {}))

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, ms):
        self.timers.add(ms)


class Map:
    def __init__(self, store, rows):
        self.store, self.rows = store, rows

    def getValue(self, key):
        self.store.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.store.calls += 1
        self.rows[key] = value

    def containsKey(self, key):
        self.store.calls += 1
        return key in self.rows

    def removeKey(self, key):
        self.store.calls += 1
        del self.rows[key]

    def keys(self):
        return iter([*self.rows])


class Value(Map):
    def exists(self):
        return self.containsKey(())

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def events(n, days, keys, seed):
    r = random.Random(seed)
    us = sorted(1_700_000_000_000_000 + r.randrange(days * 24) * 3_600_000_000 for _ in range(n))
    return [dict(txn_id=f"t{i}", us=t, key=f"k{r.randrange(keys)}", amount=r.randrange(100_000) / 100, other=r.choice(["a", "b", "c", "", None]))
            for i, t in enumerate(us)]


def plain(side, rows, row):
    past = [x for x in rows if x["key"] == row["key"] and x["us"] < row["us"]]
    within = lambda w: [x for x in past if x["us"] >= row["us"] - w]
    return {f"{side.name}_n": len(past), f"{side.name}_last_us": max((x["us"] for x in past), default=None),
            **{c: len(within(w)) for c, w in side.counts.items()}, **{c: len({x["other"] or "" for x in within(w)}) for c, w in side.distinct.items()},
            **{c: round(sum(x["amount"] for x in within(w)), 4) for c, w in side.sums.items()}}


@pytest.mark.parametrize("side", [PAYER, PAIR, DEVICE])
def test_many_keys_cost_calls_per_slot(side):
    """Three batches of 3,000 rows, the later two with rows of the day before; a timer between them."""
    rows = events(9000, 100, 3000, 5)
    order = sorted(range(9000), key=lambda i: (i // 3000, i))
    for i in (2995, 2990, 5995):
        order.remove(i)
        order.insert(order.index(i + 20), i)
    store, got = Store(), {}
    side_state = WindowHistory(side, DAY)
    side_state.init(store)
    for begin in range(0, 9000, 3000):
        batch = pd.DataFrame([rows[i] for i in order[begin:begin + 3000]])
        batch["slot"] = batch["key"].str[1:].astype(int) % 16
        store.calls = 0
        for out in side_state.handleInputRows((0,), iter([batch[:1000], batch[1000:]]), None):
            for r in out.to_dict("records"):
                got[r["txn_id"]] = r
        assert store.calls <= 16 * 5
        newest = int(batch["us"].max())
        for ms in [*store.timers]:
            if ms <= (newest - DAY) // 1000:
                store.timers.discard(ms)
                list(side_state.handleExpiredTimer((0,), Watermark((newest - DAY) // 1000), None))
    for r in rows:
        for c, v in plain(side, rows, r).items():
            found = got[r["txn_id"]][c]
            assert pd.isna(found) if v is None else round(found, 4) == v, (r, c, found, v)


def test_old_rows_leave_by_the_timer():
    store, side_state = Store(), WindowHistory(PAIR, DAY)
    side_state.init(store)
    batch = pd.DataFrame([dict(txn_id="x", us=10 * DAY, key="k", amount=1.0, other="a", slot=3)])
    list(side_state.handleInputRows((0,), iter([batch]), None))
    (ms,) = store.timers
    store.timers.clear()
    list(side_state.handleExpiredTimer((0,), Watermark(ms), None))
    assert store.maps["recent"] == {} and not store.timers
    late = pd.DataFrame([dict(txn_id="y", us=30 * DAY, key="k", amount=1.0, other="a", slot=3)])
    (out,) = side_state.handleInputRows((0,), iter([late]), None)
    assert out[["pair_n", "pair_last_us"]].values.tolist() == [[1, 10 * DAY]]


def test_large_amounts_are_summed_whole():
    rows = pd.DataFrame([dict(txn_id=f"t{i:02d}", us=i, key="k", amount=9e11, other="a", slot=0) for i in range(21)])
    store, side_state = Store(), WindowHistory(PAYER, DAY)
    side_state.init(store)
    (out,) = side_state.handleInputRows((0,), iter([rows]), None)
    assert out["payer_sum_30d"].tolist() == [9e11 * i for i in range(21)]
