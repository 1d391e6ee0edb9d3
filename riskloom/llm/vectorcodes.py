"""Product codes of vectors: codebooks per part position, fitted by Lloyd rounds over cover trees.

Components become integers and vectors are cut into equal consecutive parts, so all sums and distances are exact and do
not hang on the order of tasks. Vectors stay in the task that read them: each block of them builds one cover tree for each
part position, once, and stores the block with its trees. A node covers a run of the block's points in tree order by a
ball around its first point; halving the reach from level to level, children are centred on points further apart than
the reach. Running sums over the tree order give the sum of any node's points by one subtraction.

A round sends the codebooks (positions x entries, a few thousand numbers) to the tasks. If, seen from the centre of a
node, the nearest entry is nearer than the second by more than twice the node's radius, it is the strictly nearest of all
its points, which are assigned at once; other nodes are opened, and single points are compared exactly, ties to the lower
index. Only sums and counts per entry leave the tasks.

Defined results: rows whose vector is NULL or holds NULL or non-finite components go. The length of a vector is that of the
smallest id's; rows with another length, or a component of size LIMIT or more, keep their row without code and error
(NULL) and teach nothing. NULL ids come last among ids; rows of one id are told apart by their vectors. Repeated rows get
equal codes, each counts. Fewer vectors than entries make smaller codebooks; an empty table gives an empty one.
Columns besides id, vector and label do not pass.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import bounded_batches, stored

#: Vectors in a block at most, bytes of their integers at most, points of a node that is not divided further.
BLOCK_ROWS, BLOCK_BYTES, LEAF = 4096, 8 << 20, 8
#: Components are integers of 1/GRID; below LIMIT, sums and distances of up to 65,536 components fit 64 bits.
GRID, LIMIT = 256, 16384.0
#: Sums of errors of at most so many labels are sent to all tasks; more are joined by a shuffle.
LABELS = 100_000


@dataclass
class Forest:
    """Trees over the points of one block: all positions' points after each other, those of each in the order of its
    tree. Node k covers points start[k]:end[k] around the first of them; its children are the nodes first[k] to
    first[k] + children[k] - 1. The first nodes are the roots, one per position."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    children: np.ndarray


def grow(points: np.ndarray, positions: int) -> Forest:
    """Cover trees over `points`, level by level, all positions at once."""
    total = len(points)
    n = total // positions
    order = np.arange(total)
    starts, ends = np.arange(0, total, n), np.arange(n, total + 1, n)
    away = ((points - points[starts].repeat(n, 0)) ** 2).sum(1)
    far = np.sqrt(np.maximum.reduceat(away, starts).astype(float))
    levels, reach, made = [], far.max(), positions
    while True:
        first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        levels.append((starts, ends, far, first, count))
        reach /= 2
        open_ = np.flatnonzero((ends - starts > LEAF) & (far > 0))
        if not len(open_):
            break
        size = (ends - starts)[open_]
        at = np.repeat(starts[open_] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        node = np.repeat(np.arange(len(open_)), size)
        child, dist = np.full(len(at), -1), np.zeros(len(at), np.int64)
        bare, k = np.arange(len(at)), 0
        while len(bare):                    # each node's first point that no child covers yet becomes the next child
            own = node[bare]
            head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            centre = np.repeat(order[at[bare[head]]], np.diff(np.r_[head, len(bare)]))
            d = ((points[order[at[bare]]] - points[centre]) ** 2).sum(1)
            near = d <= reach * reach
            child[bare[near]], dist[bare[near]] = k, d[near]
            bare, k = bare[~near], k + 1
        by = np.argsort(node * k + child, kind="stable")
        order[at] = order[at[by]]
        node, child, dist = node[by], child[by], dist[by]
        head = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (child[1:] != child[:-1])])
        count[open_] = np.bincount(node[head], minlength=len(open_))
        first[open_] = made + np.cumsum(count[open_]) - count[open_]
        made += len(head)
        starts, ends = at[head], at[np.r_[head[1:], len(at)] - 1] + 1
        far = np.sqrt(np.maximum.reduceat(dist, head).astype(float))
    return Forest(order, *(np.concatenate(x) for x in zip(*levels)))


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points and entries."""
    if points.shape[1] <= 128:              # whole numbers below 2^53
        p, c = points.astype(float), entries.astype(float)
        return (p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)
    return np.stack([((points - c) ** 2).sum(1) for c in entries], 1)


def assign(points: np.ndarray, forest: Forest, books: np.ndarray):
    """Yields (start, end, entry, error at the centre) of runs of points in tree order that share their nearest entry.
    The error is that of the whole run where its points are equal, and unknown (-1) elsewhere."""
    positions = len(books)
    n = len(points) // positions
    ordered = points[forest.order]
    start, end, radius = forest.start[:positions], forest.end[:positions], forest.radius[:positions]
    node = np.arange(positions)
    while len(start):
        nearest, sure, error = np.zeros(len(start), np.int64), np.zeros(len(start), bool), np.zeros(len(start))
        place = start // n
        cuts = np.searchsorted(place, np.arange(positions + 1))
        for p in range(positions):
            for i in range(cuts[p], cuts[p + 1], 16384):
                s = slice(i, min(i + 16384, cuts[p + 1]))
                d = distances(ordered[start[s]], books[p])
                best = d.argmin(1)
                low = d[np.arange(len(d)), best]
                d[np.arange(len(d)), best] = np.inf if d.dtype == float else np.iinfo(d.dtype).max
                gap = np.sqrt(d.min(1).astype(float)) - np.sqrt(low.astype(float))
                nearest[s], error[s] = best, low
                sure[s] = (radius[s] == 0) | (gap > 2 * radius[s] * (1 + 1e-9) + 1e-6)
        yield start[sure], end[sure], nearest[sure], np.where(radius[sure] == 0, error[sure], -1)
        left = node[~sure]                  # a single point has radius zero and is never left
        inner = left[forest.children[left] > 0]
        leaf = left[forest.children[left] == 0]
        many, size = forest.children[inner], forest.end[leaf] - forest.start[leaf]
        below = np.repeat(forest.first[inner] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        single = np.repeat(forest.start[leaf] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        start = np.r_[forest.start[below], single]
        by = np.argsort(start, kind="stable")
        start, end = start[by], np.r_[forest.end[below], single + 1][by]
        radius, node = np.r_[forest.radius[below], np.zeros(len(single))][by], np.r_[below, np.full(len(single), -1)][by]


def entry_sums(points: np.ndarray, forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the points nearest to each entry of each position."""
    positions, k, d = books.shape
    n = len(points) // positions
    running = np.concatenate([np.zeros((1, d), np.int64), points[forest.order].cumsum(0)])
    count, total = np.zeros(positions * k, np.int64), np.zeros((positions * k, d), np.int64)
    for start, end, entry, _ in assign(points, forest, books):
        at = start // n * k + entry
        np.add.at(count, at, end - start)
        np.add.at(total, at, running[end] - running[start])
    return count, total


def codes(points: np.ndarray, forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance to it, per point of each position, in the points' own order."""
    positions = len(books)
    n = len(points) // positions
    entry = np.zeros(len(points), np.int64)
    for start, end, nearest, _ in assign(points, forest, books):
        size = end - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        entry[forest.order[at]] = np.repeat(nearest, size)
    entry = entry.reshape(positions, n)
    error = np.stack([((points[p * n:(p + 1) * n] - books[p][entry[p]]) ** 2).sum(1) for p in range(positions)])
    return entry, error


# ---- tables ----

def whole(vec: str):
    """Not NULL, and no NULL or non-finite component."""
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def coded(vec: str, dim: int):
    return (F.size(vec) == dim) & F.forall(vec, lambda x: F.abs(x) < LIMIT)


def _grid(lists) -> np.ndarray:
    return np.floor(GRID * np.asarray(lists.flatten().cast(pa.float64()))).astype(np.int64).reshape(len(lists), -1)


def _stack(grid: np.ndarray, positions: int) -> np.ndarray:
    return np.ascontiguousarray(grid.reshape(len(grid), positions, -1).transpose(1, 0, 2)).reshape(len(grid) * positions, -1)


TREE = ("order", "start", "end", "radius", "first", "children")


def _blocks(positions, dim, schema):
    rows = max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))

    def block(held):
        table = pa.Table.from_batches(held).combine_chunks()
        ids, vectors, labels = (table.column(i).chunk(0) for i in range(3))
        grid = _grid(vectors)
        forest = grow(_stack(grid, positions), positions)
        ints = [pa.array([x]) for x in (grid.ravel().astype(np.int32), *(getattr(forest, t).astype(float if t == "radius" else np.int32) for t in TREE))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, labels)]
        return pa.RecordBatch.from_arrays([*lists, *ints], names=["ids", "labels", "grid", *TREE])

    def run(batches):
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, rows - n)
                held.append(part)
                b, n = b.slice(part.num_rows), n + part.num_rows
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)
    return run


def _read(b, k, positions, dim):
    """Points and forest of the k-th block of a batch with columns grid and TREE."""
    get = lambda name: np.asarray(b.column(b.schema.get_field_index(name))[k].values)
    grid = get("grid").astype(np.int64).reshape(-1, dim)
    return _stack(grid, positions), Forest(*(get(t) if t == "radius" else get(t).astype(np.int64) for t in TREE))


def _summed(books, positions, dim):
    def run(batches):
        total = None
        for b in batches:
            for k in range(b.num_rows):
                found = entry_sums(*_read(b, k, positions, dim), books)
                total = found if total is None else (total[0] + found[0], total[1] + found[1])
        if total is not None:
            count, sums = total
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], names=["at", "n", "s"])
    return run


def _coded(books, positions, dim, names):
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                entry, error = codes(*_read(b, k, positions, dim), books)
                text = entry.T.astype(np.uint8).tobytes().hex()
                ids, labels = (b.column(b.schema.get_field_index(x))[k].values for x in ("ids", "labels"))
                out = pa.array([text[i:i + 2 * positions] for i in range(0, len(text), 2 * positions)], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, out, pa.array(error.sum(0))], names=names)
    return run


def next_books(blocks: DataFrame, books: np.ndarray, dim: int) -> np.ndarray:
    """One Lloyd round: every entry moves to the rounded-down mean of its points; unused ones stay."""
    positions, k, d = books.shape
    found = blocks.mapInArrow(_summed(books, positions, dim), "at long, n long, s array<long>")
    columns = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(d)]
    out = books.reshape(positions * k, d).copy()
    for r in found.groupBy("at").agg(F.sum("n").alias("n"), F.array(*columns).alias("s")).collect():    # positions x entries rows at most
        out[r["at"]] = [x // r["n"] for x in r["s"]]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, entries: int = 64, positions: int = 16, rounds: int = 2, id_col: str = "vec_id",
             vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every row with a whole vector, and the codebooks as positions x entries x part."""
    ship(__name__)
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept = vectors.select(id_col, vec_col, label_col).filter(whole(vec_col))
    fits = kept.filter((F.size(vec_col) > 0) & (F.size(vec_col) % positions == 0) & (F.size(vec_col) <= 65_536) & F.forall(vec_col, lambda x: F.abs(x) < LIMIT))
    by_id = [F.col(id_col).asc_nulls_last(), F.col(vec_col)]
    smallest = fits.orderBy(*by_id).select(F.size(vec_col).alias("n")).first()
    fields = {f.name: f for f in kept.schema.fields}
    schema = T.StructType([fields[id_col], fields[label_col], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if smallest is None:
        return kept.select(id_col, label_col, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((positions, 0, 0), np.int64)
    dim = smallest["n"]
    rows = fits.filter(F.size(vec_col) == dim)
    first = np.floor(GRID * np.array([r[0] for r in rows.orderBy(*by_id).select(vec_col).limit(entries).collect()], float)).astype(np.int64)
    books = first.reshape(len(first), positions, -1).transpose(1, 0, 2)
    ints = T.ArrayType(T.IntegerType())
    block_schema = T.StructType([T.StructField("ids", T.ArrayType(fields[id_col].dataType)), T.StructField("labels", T.ArrayType(fields[label_col].dataType)),
                                 T.StructField("grid", ints), *[T.StructField(t, T.ArrayType(T.DoubleType()) if t == "radius" else ints) for t in TREE]])
    blocks = stored(rows.select(id_col, vec_col, label_col).mapInArrow(_blocks(positions, dim, block_schema), block_schema), "cover-trees")
    for _ in range(rounds):
        books = next_books(blocks, books, dim)
    out = blocks.mapInArrow(_coded(books, positions, dim, [id_col, label_col, "code", "error"]), schema)
    rest = kept.filter(~coded(vec_col, dim)).select(id_col, label_col, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return out.unionByName(rest), books


def label_errors(coded_rows: DataFrame, label_col: str = "label") -> DataFrame:
    """`coded_rows` with label_error, the sum of errors over equal labels, NULLs together."""
    table = stored(coded_rows, "codes")
    sums = stored(table.groupBy(label_col).agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed(label_col, "__of")
    if sums.count() <= LABELS:
        sums = F.broadcast(sums)
    return table.join(sums, F.col(label_col).eqNullSafe(F.col("__of")), "left").drop("__of")
