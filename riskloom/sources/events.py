"""Reading and writing payment events as JSON lines, CSV and stream messages."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVENT, WIRE_TIME

WIRE = T.StructType([T.StructField(WIRE_TIME if f.name == "ts" else f.name, f.dataType) for f in EVENT])
_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in WIRE])
# Event times travel with microseconds and an offset.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_TRUE = ("true", "1", "y", "yes")


def _from_wire(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(WIRE_TIME, "ts")


def to_wire(df: DataFrame) -> DataFrame:
    return df.select(*EVENT.names).withColumnRenamed("ts", WIRE_TIME)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return _from_wire(spark.read.schema(WIRE).json(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header. Labels true/1/y/yes in any case count as fraud, an
    empty typology is NULL; a field that does not cast fails the read."""
    raw = spark.read.option("header", True).schema(_TEXT).csv(path)
    cols = []
    for f in WIRE:
        c = F.col(f.name)
        if f.name == "label_is_fraud":
            c = F.coalesce(F.lower(F.trim(c)).isin(*_TRUE), F.lit(False))
        elif f.name == "label_typology":
            c = F.nullif(c, F.lit(""))
        else:
            c = c.cast(f.dataType)
        cols.append(c.alias(f.name))
    return _from_wire(raw.select(*cols))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Pick the reader by extension. Rows come unordered; use `in_time_order`
    where the order itself is output."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix in (".json", ".jsonl"):
        return read_json(spark, path)
    raise ValueError(f"unsupported file extension {suffix!r}: expected .json, .jsonl or .csv")


def in_time_order(events: DataFrame) -> DataFrame:
    return events.orderBy("ts", "txn_id")


def write_events(events: DataFrame, folder: str) -> tuple[str, str]:
    """The event set as JSON lines and as CSV with a header."""
    out = to_wire(events)
    json_path, csv_path = f"{folder}/events.jsonl", f"{folder}/events.csv"
    out.write.mode("overwrite").option("ignoreNullFields", False).option("timestampFormat", TIME_FORMAT).json(json_path)
    out.write.mode("overwrite").option("header", True).option("timestampFormat", TIME_FORMAT).csv(csv_path)
    return json_path, csv_path


def encode() -> Column:
    """The message body of an event row: its fields as JSON text."""
    fields = [F.col("ts").alias(WIRE_TIME) if f.name == "ts" else F.col(f.name) for f in EVENT]
    return F.to_json(F.struct(*fields), {"timestampFormat": TIME_FORMAT, "ignoreNullFields": "false"})


def decode(message: str) -> Column:
    """Event struct of a message body (field names as on the wire)."""
    return F.from_json(F.col(message), WIRE)


def write_messages(events: DataFrame, path: str) -> None:
    """One `{"event": "<json>"}` line per event."""
    events.select(encode().alias("event")).write.mode("append").json(path)


def stream_messages(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """New message files of a folder as a stream of (event, source_file)."""
    reader = spark.readStream.schema("event string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    raw = reader.json(path)
    return raw.select(F.coalesce("event", "_corrupt").alias("event"))
