"""Exact nearest neighbours among numeric rows, and synthetic rows between them.

Points belong to the cell of their nearest pivot. The neighbours within the own cell bound the distance to the k-th one; a
point then visits just the cells that the triangle inequality leaves: those whose ring of distances around their pivot comes
within that bound. Large cells are dealt to blocks, each of which a visitor goes to, so no task holds a hot cell; a task
keeps k rows per visitor, and these partial answers are merged. Pivots balance the work and decide no result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from .explore import oversample

#: Points per cell aimed at, pivots at most (what reaches the driver and every task), points of a block at most.
CELL, PIVOTS, BLOCK = 1500, 2048, 4096
#: Points on either side of an asker, in the order of a block, whose distances bound the search.
CLOSE = 32
_FOUND = "id long, other long, d2 double"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all x to all y, added up column by column."""
    out = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        diff = x[:, c, None] - y[None, :, c]
        out += diff * diff
    return out


def _vectors(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _placed(pivots):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                d = squared(_vectors(part.column(1)), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d.min(1)))],
                                                 names=["id", "v", "cell", "r"])
    return run


def _visits(pivots, rings):
    """The blocks that may hold neighbours of a point: (id, v, d2) once per cell and block, but for those already searched."""
    low, high, blocks = rings

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                away = np.sqrt(squared(_vectors(part.column(1)), pivots))
                reach = np.sqrt(np.asarray(part.column(2)))[:, None] * (1 + 1e-9) + 1e-9 * (1 + away)
                who, cell = np.nonzero((away - reach <= high) & (low <= away + reach) & (blocks > 0))
                times = blocks[cell]
                who, cell = np.repeat(who, times), np.repeat(cell, times)
                block = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                at = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), *[part.column(c).take(at) for c in range(3)]],
                                                 names=["cell", "block", "id", "v", "d2"])
    return run


def _kept(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest finite distances of each row, equals by id, in that order."""
    d = np.where(np.isfinite(d), d, np.inf)
    if d.shape[1] > k:
        mask = d <= np.partition(d, k - 1, axis=1)[:, k - 1:k]
    else:
        mask = np.ones(d.shape, bool)
    row, col = np.nonzero(mask & np.isfinite(d))
    by = np.lexsort((ids[col], d[row, col], row))
    row, col = row[by], col[by]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first]


def _search(k):
    """Per block, the k nearest points of it to each asker that are within its bound. Rows (cell, block, asks, id, v, bound),
    the points first. Points lie in the order of their widest column, so that those too far off in it are never compared."""
    def nearest(asker, x, bound, ids, points):
        wide = np.ptp(points, axis=0).argmax()
        by = np.argsort(points[:, wide], kind="stable")
        ids, points = ids[by], points[by]
        line = points[:, wide]
        by = np.argsort(x[:, wide], kind="stable")
        for i in range(0, len(asker), 64):
            who, own = asker[by[i:i + 64]], x[by[i:i + 64]]
            # the k-th of some points close by bounds the distance
            at = np.clip(np.searchsorted(line, own[:, wide])[:, None] + np.arange(-CLOSE, CLOSE), 0, len(ids) - 1)
            near = np.zeros(at.shape)
            for c in range(x.shape[1]):
                diff = own[:, c, None] - points[at, c]
                near += diff * diff
            near[~np.isfinite(near) | (ids[at] == who[:, None]) | (np.diff(at, axis=1, prepend=-1) == 0)] = np.inf
            reach = np.minimum(bound[by[i:i + 64]], np.partition(near, k - 1, axis=1)[:, k - 1] if k <= at.shape[1] else np.inf)
            reach = np.sqrt(reach) * (1 + 1e-9) + 1e-9 * (1 + np.abs(own[:, wide]))
            lo = np.searchsorted(line, np.fmin.reduce(own[:, wide] - reach))
            hi = np.searchsorted(line, np.fmax.reduce(own[:, wide] + reach), "right")
            if lo >= hi:
                continue
            d = squared(own, points[lo:hi])
            d[who[:, None] == ids[None, lo:hi]] = np.inf
            row, col = _kept(d, ids[lo:hi], k)
            yield pa.RecordBatch.from_arrays([pa.array(who[row]), pa.array(ids[lo + col]), pa.array(d[row, col])], names=["id", "other", "d2"])

    def run(batches):
        now, ids, points = None, [], []
        for b in batches:
            cell, block, asks, who = (np.asarray(b.column(i)) for i in range(4))
            v, bound = _vectors(b.column(4)), np.asarray(b.column(5))
            edge = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(cell)]):
                if j == i:
                    continue
                if (cell[i], block[i]) != now:
                    now, ids, points = (cell[i], block[i]), [], []
                if not asks[i]:
                    ids.append(who[i:j])
                    points.append(v[i:j])
                elif ids:
                    yield from nearest(who[i:j], v[i:j], bound[i:j], np.concatenate(ids), np.concatenate(points))
    return run


def _answers(points: DataFrame, askers: DataFrame, k: int) -> DataFrame:
    far = F.lit(float("inf"))
    both = points.select("cell", "block", F.lit(0).alias("asks"), "id", "v", far.alias("d2")).unionByName(
        askers.select("cell", "block", F.lit(1).alias("asks"), "id", "v", F.col("d2") if "d2" in askers.columns else far.alias("d2")))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(n, "cell", "block").sortWithinPartitions("cell", "block", "asks").mapInArrow(_search(k), _FOUND)
    return found


def nearest_neighbours(df: DataFrame, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """id, rank (from 1), neighbour and distance of the k other rows nearest to each, equals by key. Keys are distinct
    integers; rows with a NULL column take no part; fewer rows give fewer neighbours."""
    ship(__name__)
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), *columns).dropna()
    rows = materialize(rows.select("id", F.array(*[F.col(c).cast("double") for c in columns]).alias("v")))
    n = rows.count()
    wanted = max(1, min(PIVOTS, n // CELL))
    # a draw by hash; no more than a few thousand rows reach the driver
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * wanted / max(n, 1)))).limit(4 * PIVOTS).collect()
    pivots = np.unique(np.array([r.v for r in drawn] or [[0.0] * len(columns)]), axis=0)[:: max(1, len(drawn) // wanted)]
    cells = materialize(rows.mapInArrow(_placed(pivots), "id long, v array<double>, cell int, r double"))
    per = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()   # one row per pivot
    low, high, blocks = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in per:
        low[r.cell], high[r.cell], blocks[r.cell] = r.low, r.high, -(-r.n // BLOCK)
    sizes = F.element_at(F.array(*[F.lit(max(1, int(x))) for x in blocks]), F.col("cell") + 1)
    points = materialize(cells.withColumn("block", F.pmod(F.xxhash64("id"), sizes).cast("int")))
    # the own block bounds the distance to the k-th neighbour; a block with fewer bounds nothing
    first = _answers(points, points, k).groupBy("id").agg(F.count("*").alias("m"), F.max("d2").alias("d2"))
    bound = points.join(first, "id", "left").select("id", "v", F.when(F.col("m") >= k, F.col("d2")).otherwise(F.lit(float("inf"))).alias("d2"))
    askers = bound.mapInArrow(_visits(pivots, (low, high, blocks)), "cell int, block int, id long, v array<double>, d2 double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("d2", "other"))), 1, k)      # k rows of each block visited
    return (_answers(points, askers, k).groupBy("id").agg(best.alias("best"))
            .select("id", F.posexplode("best").alias("rank", "b"))
            .select("id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("b.other").alias("neighbour"), F.sqrt("b.d2").alias("distance")))


def synthetic_minority(df: DataFrame, key: str, label: str, minority, columns: list[str], k: int = 5) -> DataFrame:
    """Rows of the minority class that even out the classes: each lies between a row and one of its k nearest neighbours
    of the class, both chosen by a hash of the key and the copy. Columns: base, copy, neighbour, share and the features."""
    own = df.where(F.col(label) == F.lit(minority))
    copies = oversample(df.select(key, label), key, label).where((F.col(label) == F.lit(minority)) & (F.col("copy") > 1)).select(F.col(key).alias("base"), "copy")
    near = nearest_neighbours(own, key, columns, k)
    u = lambda salt: F.pmod(F.xxhash64("base", "copy", F.lit(salt)), F.lit(1 << 52))
    counts = near.groupBy(F.col("id").alias("base")).agg(F.max("rank").alias("many"))
    pick = copies.join(counts, "base").withColumn("rank", 1 + F.pmod(u(1), F.col("many"))).withColumn("share", u(2) / float(1 << 52))
    pick = pick.join(near.select(F.col("id").alias("base"), "rank", "neighbour"), ["base", "rank"])
    side = lambda name, tag: own.select(F.col(key).alias(name), *[F.col(c).cast("double").alias(f"{tag}{c}") for c in columns])
    both = pick.join(side("base", "a_"), "base").join(side("neighbour", "b_"), "neighbour")
    return both.select("base", "copy", "neighbour", "share", *[(F.col(f"a_{c}") + F.col("share") * (F.col(f"b_{c}") - F.col(f"a_{c}"))).alias(c) for c in columns])
