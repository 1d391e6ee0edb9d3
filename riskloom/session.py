"""Session and lineage helpers."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings a job built on this package expects. Shuffle partitions are an upper
# bound: adaptive execution merges the small ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # generated methods beyond this size are never compiled by the JVM; split them instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # no call-site capture per Column call: plans here are built from many
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # a checkpoint goes when nothing refers to it any more; streams make some per micro-batch
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(master: str | None = None, **extra) -> SparkSession:
    """A session with the package settings; `extra` keys use `__` for dots."""
    b = SparkSession.builder.appName("riskloom")
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` as the cluster
    sets it. Where nothing is set, a new one is made on a local master only;
    elsewhere executors would not find each other's files."""
    sc = spark.sparkContext
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not wanted and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="riskloom-ckpt-"))
    return wanted or sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path for intermediate tables inside the shared folder."""
    return f"{shared_folder(spark)}/riskloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that one task of a keyed stage takes, where a table has more of them than the tasks that run at once could share so.
ROWS_PER_TASK = 100_000


def dealt(df: DataFrame, rows: int, *keys: str, per_task: int | None = None) -> DataFrame:
    """`df`, of about `rows` rows, clustered by the keys. Adaptive execution merges partitions by their size as shuffled, before a
    stage repeats and widens its rows; so the number is fixed for large tables, and a task's share does not grow with them."""
    wanted = -(-rows // (per_task or ROWS_PER_TASK))
    few = wanted <= df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(*keys) if few else df.repartition(wanted, *keys)


def compiled(spark: SparkSession) -> None:
    """The package's limit of generated methods, for sessions that set none: the JVM interprets what is larger."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, SETTINGS[key])


def ship(module: str) -> None:
    """Send a module's functions to Python workers by value, so executors need
    no installed copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
