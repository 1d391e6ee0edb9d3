"""Sliding medians per key, exact, streaming over rows sorted by (key, us)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship

ship(__name__)

BLOCK = 1024


class Ordered:
    """A sorted bag held as blocks: insert, remove and pick by rank."""

    def __init__(self):
        self.blocks, self.size = [[]], 0

    def _at(self, x):
        b = self.blocks
        if len(b) == 1:
            return 0
        lo, hi = 0, len(b) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if b[mid][-1] < x:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def add(self, x):
        i = self._at(x)
        block = self.blocks[i]
        insort(block, x)
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[i:i + 1] = [block[:BLOCK], block[BLOCK:]]

    def remove(self, x):
        i = self._at(x)
        block = self.blocks[i]
        del block[bisect_left(block, x)]
        self.size -= 1
        if not block and len(self.blocks) > 1:
            del self.blocks[i]

    def pick(self, k):
        for block in self.blocks:
            if k < len(block):
                return block[k]
            k -= len(block)

    def median(self):
        if not self.size:
            return None
        lo = self.pick((self.size - 1) // 2)
        return lo if self.size % 2 else (lo + self.pick(self.size // 2)) / 2


def _walk(batches, key, value, window, out):
    """Yield each batch with the median of `value` over [us - window, us)."""
    current, bag, waiting, live, moment = None, Ordered(), [], deque(), None
    for batch in batches:
        result = []
        columns = [batch.column(c).to_pylist() for c in (key, "us", value)]
        probing = batch.column("is_probe").to_pylist() if "is_probe" in batch.schema.names else repeat(False)
        for k, us, x, probe in zip(*columns, probing):
            if k != current:
                current, bag, waiting, live, moment = k, Ordered(), [], deque(), None
            if us != moment:
                for y in waiting:           # rows of one moment never see each other
                    bag.add(y)
                    if window is not None:
                        live.append((moment, y))
                waiting, moment = [], us
                while live and live[0][0] < us - window:
                    bag.remove(live.popleft()[1])
            result.append(bag.median())
            if not probe and x is not None:
                waiting.append(x)
        yield batch.append_column(out, pa.array(result, pa.float64()))


def sliding_median(df: DataFrame, key: str, value: str, window: int | None, out: str) -> DataFrame:
    """Add the median over the window before each row. `df` must already be
    clustered by `key` and sorted by (key, us) within partitions, as the output
    of a keyed window is; only the rows of one window are held in memory."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    return df.mapInArrow(lambda it: _walk(it, key, value, window, out), schema)
