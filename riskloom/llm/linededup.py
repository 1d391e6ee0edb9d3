"""Drop lines that many documents share, keeping them in one document each.

Only hashes of lines move: they are range-partitioned by (hash, id, text hash, position), so even one line that a third
of all documents hold is cut over many tasks, and each task streams over its sorted rows. Runs that touch the edge of a
task are settled afterwards from a few rows per task. The outcome per document is a compressed bitmap of kept lines.

Defined results: a NULL or empty text is one empty line, and a NULL text stays NULL unless a line was dropped (it has
none). A NULL id counts as a document of its own, below all ids. Rows with the same id count as one document; rows alike
in id and text get the same bitmap. Empty tables give empty tables. Columns of the input pass through; `n_lines` and
`n_dropped` replace columns of these names where they are asked for.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import bounded_batches, doc_key, partitions, replaced, stored

STRIP = b" \t\n\x0b\x0c\r"
DECIDED, OPEN, WITNESS = 0, 1, 2
LINE_SCHEMA = "h1 long, h2 long, d long, t long, pos int"
RUN_SCHEMA = "kind int, " + LINE_SCHEMA


def _batch(schema: str, arrays) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(a, kinds[k]) for a, (_, k) in zip(arrays, fields)],
                                      names=[n for n, _ in fields])


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _hash_lines(min_chars: int):
    def run(batches):
        for b in batches:
            digests, ds, ts, ps = [], [], [], []
            for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2))):
                if len(text) < min_chars:
                    continue
                for i, line in enumerate(text.split(b"\n")):
                    line = line.strip(STRIP)
                    if len(line) < min_chars:
                        continue
                    key = line.lower()
                    if len(key) < 4 * min_chars and len(key.decode()) < min_chars:
                        continue
                    digests.append(xxhash.xxh3_128_digest(key))
                    ds.append(d)
                    ts.append(t)
                    ps.append(i)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield _batch(LINE_SCHEMA, (h[:, 0], h[:, 1], np.array(ds, np.int64), np.array(ts, np.int64), np.array(ps, np.int32)))
    return run


def _stream_runs(min_docs: int):
    """Over rows sorted by hash, then id downwards: the first document of a run keeps its lines, later ones lose them
    once the run has `min_docs` documents. At most the rows of `min_docs` documents wait in memory."""
    def emit(kind, rows):
        return _batch(RUN_SCHEMA, [np.full(len(rows[0]), kind, np.int32), *rows])

    def run(batches):
        begun, key, mode, keeper, seen, wait = False, None, None, None, None, None
        for b in batches:
            rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(rows[0]):
                continue
            if mode is not None:                      # the run at the end of the batch before is settled
                same = (rows[0] == key[0]) & (rows[1] == key[1])
                n = len(same) if same.all() else int(same.argmin())
                if n:
                    head = [r[:n] for r in rows]
                    if mode == OPEN:
                        yield emit(OPEN, head)
                    else:
                        yield emit(DECIDED, [r[head[2] != keeper] for r in head])
                rows = [r[n:] for r in rows]
                if not len(rows[0]):
                    continue
                mode = None
            if wait is not None:
                rows = [np.concatenate(x) for x in zip(wait, rows)]
                wait = None
            fresh = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
            starts = np.flatnonzero(fresh)
            if not begun:                             # may go on from the task before
                begun = True
                end = starts[1] if len(starts) > 1 else len(fresh)
                yield emit(OPEN, [r[:end] for r in rows])
                if end == len(fresh):
                    key, mode = (rows[0][0], rows[1][0]), OPEN
                    continue
                rows, fresh, starts = [r[end:] for r in rows], fresh[end:], starts[1:] - end
            run_of = np.cumsum(fresh) - 1
            doc_of = np.cumsum(fresh | np.r_[True, rows[2][1:] != rows[2][:-1]])
            rank = doc_of - doc_of[starts][run_of]
            docs = np.maximum.reduceat(rank, starts) + 1
            lose = (rank > 0) & (docs >= min_docs)[run_of]
            last = starts[-1]
            if docs[-1] >= min_docs:
                yield emit(DECIDED, [r[lose] for r in rows])
                tail = [r[last:] for r in rows]
                first = np.r_[True, tail[2][1:] != tail[2][:-1]]
                seen = [r[first][:min_docs] for r in tail]
                key, mode, keeper = (tail[0][0], tail[1][0]), DECIDED, tail[2][0]
            else:
                yield emit(DECIDED, [r[:last][lose[:last]] for r in rows])
                wait = [r[last:] for r in rows]
        if wait is not None:                          # may go on in the next task
            yield emit(OPEN, wait)
        elif mode == DECIDED:
            seen[4] = np.full(len(seen[4]), -1, np.int32)
            yield emit(WITNESS, seen)
    return run


def _pack(batches):
    for b in batches:
        packed, n = [], []
        for positions in b.column(2):
            gone = np.unique(np.asarray(positions.values))
            keep = np.ones((int(gone[-1]) // 8 + 1) * 8, bool)
            keep[gone] = False
            packed.append(zlib.compress(np.packbits(keep).tobytes()))
            n.append(len(gone))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(packed, pa.binary())],
                                         names=["d", "t", "lost", "bitmap"])


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (d, t, lost, bitmap) for each document that loses lines: zlib-compressed bits in line order, 1 for a
    kept line; lines past the last bit are kept. d, t are the columns of `doc_key`."""
    ship(__name__)
    bounded_batches(docs.sparkSession)
    n = partitions(docs.sparkSession)
    d, t = doc_key(id_col, text_col)
    lines = (docs.select(d.alias("d"), t.alias("t"), F.col(text_col).alias("text"))
             .mapInArrow(_hash_lines(min_chars), LINE_SCHEMA))
    order = ["h1", "h2", F.desc("d"), "t", "pos"]
    runs = stored(lines.repartitionByRange(n, *order).sortWithinPartitions(*order)
                  .mapInArrow(_stream_runs(min_docs), RUN_SCHEMA), "line-runs")
    edge = runs.filter(F.col("kind") != DECIDED)
    # at most two runs of a task touch its edges, so this list is bounded by twice the number of tasks
    shared = (edge.select("h1", "h2", "d").distinct().groupBy("h1", "h2")
              .agg(F.count("*").alias("docs"), F.max("d").alias("keeper")).filter(F.col("docs") >= min_docs).drop("docs"))
    late = (edge.filter("pos >= 0").join(F.broadcast(shared), ["h1", "h2"]).filter("d <> keeper").select("d", "t", "pos"))
    lost = runs.filter(F.col("kind") == DECIDED).select("d", "t", "pos").unionByName(late)
    return (lost.groupBy("d", "t").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
            .mapInArrow(_pack, "d long, t long, lost int, bitmap binary"))


def _keep(text: bytes, bitmap: bytes) -> bytes:
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:len(lines)]
    return b"\n".join([x for i, x in enumerate(lines) if i >= len(bits) or bits[i]])


def _apply(at: int, width: int):
    """The text is column `at`, the bitmap the last one."""
    def run(batches):
        for b in batches:
            maps = b.column(width).to_pylist()
            texts = b.column(at).cast(pa.binary()).to_pylist()
            kept = [x if m is None else _keep(x, m) for x, m in zip(texts, maps)]
            arrays = [b.column(i) for i in range(width)]
            arrays[at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names[:width])
    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text",
                counts: bool = False) -> DataFrame:
    """`docs` without the lines lost; with `counts`, n_lines before dropping and n_dropped as well."""
    bitmaps = line_bitmaps(docs, min_chars, min_docs, id_col, text_col)
    d, t = doc_key(id_col, text_col)
    if counts:
        docs = replaced(docs, n_lines=(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))).cast("long"))
        docs = replaced(docs, n_lines=F.coalesce("n_lines", F.lit(0)) + F.lit(1).cast("long"))
    names = docs.columns
    at = names.index(text_col)
    found = docs.withColumns({"__d": d, "__t": t}).join(
        bitmaps.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("lost").alias("__lost"), F.col("bitmap").alias("__bitmap"))
        .hint("shuffle_hash"), ["__d", "__t"], "left")
    if counts:
        found = replaced(found, n_dropped=F.coalesce("__lost", F.lit(0)).cast("long"))
        names = [*[x for x in names if x != "n_dropped"], "n_dropped"]
        at = names.index(text_col)
    found = found.select(*[F.col(f"`{x}`") for x in names], "__bitmap")
    return found.mapInArrow(_apply(at, len(names)), found.drop("__bitmap").schema)
