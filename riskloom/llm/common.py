"""Helpers the text operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

#: Stands for a NULL id inside the operators, so that it sorts below every other id and joins with itself.
NO_ID = -(1 << 63)
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}-{name}"
    schema = df.schema
    release(spark)
    df.write.parquet(path)
    del df                              # the last hold on its plan, and so on its shuffle files
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: it does so once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Hand texts to Python workers in batches of about `size` bytes instead of 10,000 rows, whatever their length: a
    batch is held several times over, on both sides of the pipe. A session that sets its own bound keeps it."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(size))


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """Id and text hash. Rows alike in both are copies of one row and get the same results, so the pair is a safe join
    key even where ids repeat."""
    return (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """Replace or add columns; a column of the input with such a name gives way."""
    return df.withColumns(columns)
