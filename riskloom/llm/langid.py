"""Language identification with a string kernel.

Two texts are compared by the n-grams of letters (n = 1 to 3, blended) that occur in both: a presence kernel, scaled by
the texts' own sizes. A few landmark texts per language stand for the kernel matrix (Nyström), and a one-versus-rest
kernel ridge regression on them gives one score per language. N-grams are hashed into a fixed number of buckets, so a
batch of texts is a 0/1 matrix and scoring is two matrix products. Scoring is one pass without a shuffle.

Fitting takes of each language the `SAMPLE_PER_LANG` distinct texts with the smallest hashes, however many copies of them
there are, and of those the first `LANDMARKS_PER_LANG` as landmarks (fewer where the languages are so many that there would
be over `LANDMARKS`; beyond that many languages, one each of those with the smallest hashes). Every language with at least
`LEAST_ROWS` rows is learnt. The sampled texts' presence bits are a stored table; the tasks sum their kernel rows' products
and the sums per language, and only these sums come to the driver: landmarks squared plus landmarks times languages,
whatever the number of rows. Everything is computed on whole texts.

Defined results: NULL texts and texts without a letter get `und` with score 0, as do all texts if nothing was learnt.
Rows without language teach nothing, nor do languages with fewer than `LEAST_ROWS` rows that hold a letter. Equal texts get
equal predictions. Empty tables give empty tables. Output columns replace columns of the input with their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import bounded_batches, stored

SAMPLE_PER_LANG, LANDMARKS_PER_LANG, LANDMARKS, RIDGE = 1500, 24, 768, 1e-3
#: Languages with fewer labelled rows than this are not learnt.
LEAST_ROWS = 2
#: log2 of the buckets for n = 1, 2, 3.
BITS = (9, 12, 14)
WIDTH = sum(1 << b for b in BITS)
BLOCK = 96


def letter_table() -> np.ndarray:
    """Code point -> itself for a letter, blank otherwise; beyond the table all count as letters."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x3000)], np.uint64)


def mark_presence(text: str, row: np.ndarray, table: np.ndarray) -> None:
    """Set the buckets of the text's n-grams in a zeroed row."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.where(c < len(table), table[np.minimum(c, len(table) - 1)], c.astype(np.uint64))
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    gram, at = c, 0
    for n, bits in enumerate(BITS):
        if n:
            gram = gram[:-1] * np.uint64(0x200000) + c[n:]
        row[at + (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)] = 1
        at += 1 << bits


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _presence(batches):
    """lang, hash and packed presence bits of each text."""
    table = letter_table()
    for b in batches:
        keep, bits = [], []
        for i, text in enumerate(b.column(2).to_pylist()):
            if has_letter(text):
                row = np.zeros(WIDTH, np.uint8)
                mark_presence(text, row, table)
                bits.append(np.packbits(row).tobytes())
                keep.append(i)
        at = pa.array(keep, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(bits, pa.binary())], names=["lang", "h", "bits"])


def kernel(x: np.ndarray, marks: np.ndarray, mark_size: np.ndarray) -> np.ndarray:
    return (x @ marks) / np.sqrt(np.maximum(x.sum(1, dtype=np.float32), 1)[:, None] * mark_size)


def unpacked(bits: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1)[:, :WIDTH].astype(np.float32)


def landmarks(held) -> dict:
    """The model with its landmarks as a matrix, made once per Python worker: they travel as bits."""
    model = held.value
    if "marks" not in model:
        m = unpacked(model["bits"])
        model["marks"], model["size"] = np.ascontiguousarray(m.T), m.sum(1)
    return model


def _rows(texts, model, table):
    """Kernel rows of texts against the landmarks, a block at a time."""
    x = np.zeros((BLOCK, WIDTH), np.float32)
    for i in range(0, len(texts), BLOCK):
        part = texts[i:i + BLOCK]
        x[:len(part)] = 0
        for row, text in zip(x, part):
            mark_presence(text, row, table)
        yield kernel(x[:len(part)], model["marks"], model["size"])


def _task_sums(held):
    """One task's share: sums of products of kernel rows (and a 1), a row of the matrix per landmark, and sums and rows per language."""
    def run(batches):
        model = landmarks(held)
        size = len(model["bits"]) + 1
        gram, per = np.zeros((size, size)), {}
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                k = kernel(unpacked(part.column(1).to_pylist()), model["marks"], model["size"]).astype(np.float64)
                k = np.c_[k, np.ones(len(k))]
                gram += k.T @ k
                for g, row in zip(part.column(0).to_pylist(), k):
                    per[g] = per[g] + row if g in per else row
        if per:
            rows = [(None, i, r) for i, r in enumerate(gram)] + [(g, 0, r) for g, r in per.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int32()),
                                              pa.array([x[2].tobytes() for x in rows], pa.binary())], names=["lang", "i", "v"])
    return run


def _added(key, rows):
    """The sum of one row over the tasks."""
    v = sum(np.frombuffer(x, np.float64) for x in rows.column("v").to_pylist())
    return pa.table({"lang": rows.column("lang").slice(0, 1), "i": rows.column("i").slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})


def _sample(rows: DataFrame, per_lang: int) -> DataFrame:
    """lang, h, bits of the texts with the `per_lang` smallest hashes of each language. Hashes are made distinct and ranked
    before a text moves; the limit of the ranking works inside the map tasks first, so no language gathers in one task."""
    keyed = rows.withColumn("h", F.xxhash64("text"))
    distinct = keyed.groupBy("lang", "h").agg(F.count("*").alias("n"))
    counts = distinct.groupBy("lang").agg(F.sum("n").alias("rows")).filter(F.col("rows") >= LEAST_ROWS).select("lang")
    first = (distinct.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= per_lang)
             .groupBy("lang").agg(F.max("h").alias("last")).join(counts, "lang"))
    # one row per language, as has the model itself
    drawn = keyed.join(F.broadcast(first), "lang").filter("h <= last").groupBy("lang", "h").agg(F.first("text").alias("text"))
    return drawn.select("lang", "h", "text").mapInArrow(_presence, "lang string, h long, bits binary")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG,
        landmarks_per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE, most_landmarks: int = LANDMARKS) -> dict | None:
    """The model: landmarks as bits, one weight column per language. None if nothing can be learnt."""
    ship(__name__)
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null").filter(
        F.col("text").rlike(r"\p{L}"))
    sample = stored(_sample(rows, sample_per_lang), "language-sample")
    sizes = sample.groupBy("lang").count().collect()             # one row per language
    if not sizes:
        return None
    langs, n = sorted(r["lang"] for r in sizes), sum(r["count"] for r in sizes)
    each = min(landmarks_per_lang, max(1, most_landmarks // len(langs)))
    ranked = sample.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= each)
    marks = ranked.orderBy("r", "h", "lang").limit(max(most_landmarks, 1)).select("bits").collect()
    model = {"bits": sorted({bytes(r.bits) for r in marks})}
    held = spark.sparkContext.broadcast(dict(model))
    sums = (sample.select("lang", "bits").mapInArrow(_task_sums(held), "lang string, i int, v binary")
            .groupBy("lang", "i").applyInArrow(_added, "lang string, i int, v binary").collect())
    size = len(model["bits"]) + 1
    gram, per = np.zeros((size, size)), {}
    for r in sums:
        if r.lang is None:
            gram[r.i] = np.frombuffer(r.v, np.float64)
        else:
            per[r.lang] = np.frombuffer(r.v, np.float64)
    return {**model, **solved(gram, np.stack([per[g] for g in langs], 1), n, unpacked(model["bits"]), ridge), "langs": langs}


def solved(gram: np.ndarray, per: np.ndarray, n: int, marks: np.ndarray, ridge: float) -> dict:
    """One-versus-rest ridge weights from the sums over kernel rows [k, 1]: their products and, per language, their totals."""
    own = kernel(marks, marks.T, marks.sum(1)).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    use = value > 1e-6 * value.max()
    root = vector[:, use] / np.sqrt(value[use])                 # columns span the kernel's feature space
    turn = np.zeros((len(own) + 1, root.shape[1] + 1))
    turn[:-1, :-1], turn[-1, -1] = root, 1
    penalty = ridge * n * np.eye(turn.shape[1])
    penalty[-1, -1] = 1e-9
    target = 2 * per - per.sum(1, keepdims=True)                # 1 for the language, -1 for the rest
    beta = np.linalg.solve(turn.T @ gram @ turn + penalty, turn.T @ target)
    return {"weights": (root @ beta[:-1]).astype(np.float32), "bias": beta[-1].astype(np.float32)}


def _predict(model, at):
    def run(batches):
        table = letter_table()
        known_model = None if model is None else landmarks(model)
        for b in batches:
            texts = b.column(at).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, x in enumerate(texts) if has_letter(x)] if known_model else []
            # texts of like length share a block, so that copies and order make no difference to memory
            for i, k in enumerate(_rows([texts[j] for j in known], known_model, table) if known else ()):
                f = k @ known_model["weights"] + known_model["bias"]
                best = f.argmax(1)
                part = known[i * BLOCK:(i + 1) * BLOCK]
                score[part] = np.clip((f[np.arange(len(part)), best].astype(float) + 1) / 2, 0, 1)
                for j, g in zip(part, best):
                    lang[j] = known_model["langs"][g]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)],
                                             names=[*b.schema.names, "__lang", "__score"])
    return run


def predict(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (0 to 1: the winning language's regression value, -1 to 1 scaled)."""
    ship(__name__)
    bounded_batches(docs.sparkSession)
    held = None if model is None else docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    out = docs.mapInArrow(_predict(held, docs.columns.index(text_col)), schema)
    return out.withColumns({"lang_pred": F.col("__lang"), "score": F.col("__score")}).drop("__lang", "__score")


def split(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """`docs` with held_out: whether crc32 of the id as text leaves `held` when divided by `folds` (NULL ids: no)."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % folds == held, F.lit(False)))
