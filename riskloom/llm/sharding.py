"""Shards of nearly equal bytes, by sampled splitters.

Records have the key (text hash, id), so copies of a text lie side by side and share a shard unless a cut falls among them.
A sample weighted by size is drawn by a keyed hash; its quantiles are splitters that cut the keys into ranges. Ranges that
hold far more than their share of bytes or rows are subdivided by splitters sampled within them, until none is left that
holds two keys; so the copies of one text, however many, spread over ranges by their ids. The bytes of every range are then known,
a running sum within each range places every record exactly among all bytes, and the shards are cut there: record r goes to
the shard in whose share of the bytes its middle lies. Splitters only spread the work; the shards do not hang on the sample.

Defined results: a NULL text has no bytes and the checksum of none; it lies beside empty texts. NULL ids come first. Rows
alike in id and text are one key with a count, dealt out one by one, so a shard cut may fall among them. An empty table
gives an empty one. A record larger than a share leaves shards empty. Columns besides id and text pass through `write_shards`
only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import bounded_batches, partitions, stored

#: Bytes a record counts besides its text.
EXTRA = 8
#: Draws per range, keys a range may hold, times its share of bytes a range may hold.
DRAWS, RANGE_KEYS, OVERFULL = 24, 500_000, 2.0
#: Copies dealt out from one row at a time.
STEP = 4096


def key_columns(id_col: str = "doc_id", text_col: str = "text"):
    """h (60 bits of the text's MD5), doc_id, size and text_crc32."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("h"), F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + EXTRA).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]


def packed(h: np.ndarray, ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Keys as 17 bytes that sort as (h, id), NULL ids first."""
    out = np.zeros((len(h), 17), np.uint8)
    out[:, :8] = h.astype(">i8").view(np.uint8).reshape(-1, 8)
    out[:, 8] = ~null
    out[:, 9:] = (np.where(null, 0, ids).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def _packed(h, ids) -> np.ndarray:
    return packed(np.asarray(h), np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()))


def _ranged(held):
    """Adds the range of each key: the number of splitters not above it. Columns 0 and 1 are h and the id."""
    def run(batches):
        for b in batches:
            at = np.searchsorted(held.value, _packed(b.column(0), b.column(1)), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "range"])
    return run


def _with_range(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("range", T.IntegerType())])


def in_ranges(keys: DataFrame, splitters: np.ndarray) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(splitters)
    return keys.mapInArrow(_ranged(held), _with_range(keys))


def _draw(keys: DataFrame, rate, turn: int) -> np.ndarray:
    """Packed keys drawn with probability rate * bytes (1 at most), sorted, with the bytes each stands for."""
    u = (F.xxhash64(F.lit(turn), "h", "doc_id").bitwiseAND((1 << 52) - 1) / F.lit(float(1 << 52)))
    bytes_ = F.col("size") * F.col("n")
    found = keys.filter(u < bytes_ * rate).select("h", "doc_id", F.greatest(bytes_.cast("double"), F.lit(1 / rate)).alias("w")).toArrow().combine_chunks()
    if not found.num_rows:
        return np.zeros(0, "S17"), np.zeros(0)
    key = _packed(found.column(0).chunk(0), found.column(1).chunk(0))
    by = np.argsort(key)
    return key[by], np.asarray(found.column(2).chunk(0))[by]


def _quantiles(key: np.ndarray, weight: np.ndarray, pieces: int) -> np.ndarray:
    upto = weight.cumsum()
    at = np.searchsorted(upto, upto[-1] * np.arange(1, pieces) / pieces) if len(key) else []
    return np.unique(key[at])


def splitters(keys: DataFrame, pieces: int) -> tuple[np.ndarray, list]:
    """Splitters, and (range, rows, bytes) of every range, so that no range of several keys is overfull. The sample at the
    driver is of about DRAWS keys a range, the ranges of about RANGE_KEYS keys or a share of the bytes."""
    total, count = keys.agg(F.sum(F.col("size") * F.col("n")), F.count("*")).first()
    if not count:
        return np.zeros(0, "S17"), []
    pieces = max(pieces, -(-count // RANGE_KEYS))
    share = total / pieces
    cut = _quantiles(*_draw(keys, pieces * DRAWS / total, 0), pieces)
    turn = 0
    while True:
        placed = in_ranges(keys, cut)
        full = placed.groupBy("range").agg(F.sum("n").alias("rows"), F.sum(F.col("size") * F.col("n")).alias("bytes"), F.count("*").alias("keys")).collect()
        over = {r["range"]: max(r["bytes"] / share, r["keys"] / RANGE_KEYS) for r in full
                if r["keys"] > 1 and max(r["bytes"] / share, r["keys"] / RANGE_KEYS) > OVERFULL}
        if not over or turn == 20:
            return cut, sorted((r["range"], r["rows"], r["bytes"]) for r in full)
        turn += 1
        worst = F.col("range").isin(list(over))
        # within an overfull range the draw is by rows as well, for ranges of many small records
        bytes_in = {r["range"]: r["bytes"] for r in full}
        lowest = min(bytes_in[k] / over[k] for k in over)
        key, weight = _draw(placed.filter(worst), DRAWS / lowest, turn)
        own = np.searchsorted(cut, key, "right")
        more = [_quantiles(key[own == k], weight[own == k], int(np.ceil(2 * over[k]))) for k in over]
        cut = np.unique(np.concatenate([cut, *more]))


@dataclass
class Plan:
    keys: DataFrame
    cut: np.ndarray
    ranges: list


def plan(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> Plan:
    """The keys with how often each occurs, and the ranges to work in."""
    ship(__name__)
    bounded_batches(docs.sparkSession)
    keys = docs.select(*key_columns(id_col, text_col)).groupBy("h", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    keys = stored(keys.select("h", "doc_id", "size", "text_crc32", "n"), "shard-keys")
    return Plan(keys, *splitters(keys, max(4 * shards, partitions(docs.sparkSession))))


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h, doc_id, size, text_crc32, shard and slot (the place within the shard, from 0, by h and id) of every row."""
    spark = docs.sparkSession
    p = plan(docs, shards, id_col, text_col)
    rows = np.array([r[1:] for r in p.ranges], np.int64).reshape(-1, 2)
    total = int(rows[:, 1].sum())
    before = rows.cumsum(0) - rows
    # as many rows as there are ranges
    starts = spark.createDataFrame([(r[0], int(a), int(b)) for r, (a, b) in zip(p.ranges, before)], "range int, row0 long, byte0 long")
    ranged = in_ranges(p.keys, p.cut)
    running = "OVER (PARTITION BY range ORDER BY h, doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    placed = (ranged.withColumns({"r": F.expr(f"coalesce(sum(n) {running}, 0)"), "b": F.expr(f"coalesce(sum(n * size) {running}, 0)")})
              .join(F.broadcast(starts), "range")
              .select("h", "doc_id", "size", "text_crc32", "n", (F.col("r") + F.col("row0")).alias("r"), (F.col("b") + F.col("byte0")).alias("b")))
    # rows that repeat are dealt out in steps, so that no list of all of them is ever held
    steps = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {STEP}"))))
    each = steps.withColumn("i", F.explode(F.sequence(F.col("k") * STEP, F.least(F.col("n"), (F.col("k") + 1) * STEP) - 1)))
    # middle of the record, in halves of a byte
    middle = "2 * (b + i * size) + size"
    dealt = each.select("h", "doc_id", "size", "text_crc32", (F.col("r") + F.col("i")).alias("r"),
                        F.expr(f"cast(cast({middle} as decimal(38, 0)) * {shards} div {2 * max(total, 1)} as int)").alias("shard"))
    dealt = stored(dealt, "shards")
    first = dealt.groupBy("shard").agg(F.min("r").alias("first"))           # as many rows as there are shards
    return dealt.join(F.broadcast(first), "shard").select("h", "doc_id", "size", "text_crc32", "shard", (F.col("r") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` as Parquet under path/shard=k, sorted by key within each task's file, and the assignment. Rows
    alike in id and text that a cut divides go to the later shard together."""
    found = assign(docs, shards, id_col, text_col)
    key = ["h", F.col("doc_id").isNotNull(), "doc_id"]
    starts = found.groupBy("shard").agg(F.min(F.struct(*key[:1], key[1].alias("has"), "doc_id")).alias("k")).orderBy("shard").collect()
    number = np.array([r["shard"] for r in starts])
    ids = pa.array([r["k"]["doc_id"] for r in starts], pa.int64())
    held = docs.sparkSession.sparkContext.broadcast(_packed(pa.array([r["k"]["h"] for r in starts], pa.int64()), ids))
    h, doc_id = key_columns(id_col, text_col)[:2]
    names = docs.columns
    wide = docs.select(h.alias("__shard_h"), doc_id.alias("__shard_id"), *[F.col(f"`{x}`") for x in names])
    at = wide.mapInArrow(_ranged(held), _with_range(wide))
    to = F.element_at(F.array(*[F.lit(int(x)) for x in number]), F.greatest(F.col("range"), F.lit(1)))
    out = at.withColumn("shard", to if len(number) else F.lit(0)).drop("range")
    # several tasks write one shard: a shard is a folder, not a task
    spread = max(1, partitions(docs.sparkSession) // shards)
    (out.repartition("shard", F.pmod(F.xxhash64("__shard_h", "__shard_id"), F.lit(spread))).sortWithinPartitions("shard", "__shard_h", "__shard_id")
     .drop("__shard_h", "__shard_id").write.partitionBy("shard").parquet(path))
    return found
