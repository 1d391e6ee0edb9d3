"""Row shapes shared by the package."""

from __future__ import annotations

from pyspark.sql import types as T

TXN_TYPES = ("P2P", "P2M")
INITIATION_MODES = ("SCAN_QR", "INTENT", "COLLECT_REQUEST", "CONTACT")
ACTIONS = ("ALLOW", "WARN", "REVIEW", "BLOCK")
RISK_TIERS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SOURCES = ("api", "worker", "replay")
DISPOSITIONS = ("CONFIRMED_FRAUD", "LEGIT", "UNCLEAR")

EVENT = T.StructType([
    T.StructField("txn_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("payer_vpa", T.StringType()),
    T.StructField("payee_vpa", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("txn_type", T.StringType()),
    T.StructField("initiation_mode", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("payer_bank", T.StringType()),
    T.StructField("payee_bank", T.StringType()),
    T.StructField("payer_account_age_days", T.IntegerType()),
    T.StructField("label_is_fraud", T.BooleanType()),
    T.StructField("label_typology", T.StringType()),
])
LABEL_COLUMNS = ("label_is_fraud", "label_typology")

# On the wire and in files the event time is called `timestamp`.
WIRE_TIME = "timestamp"

REASON = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("contribution", T.DoubleType()),
])
