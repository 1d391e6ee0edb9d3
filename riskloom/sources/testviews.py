"""Views that give the shared test tables the shape of payment data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TXN = """
SELECT concat('t', event_id) AS txn_id, ts,
       concat('u', user_id, '@bank') AS payer_vpa,
       concat(CASE WHEN k % 3 = 0 THEN 'priyastores' WHEN k % 3 = 1 THEN 'raj.kumar' ELSE 'xqz' END,
              k, '_', event_id % 3,
              CASE WHEN k % 5 = 0 THEN concat('d', day(ts)) ELSE '' END, '@ybl') AS payee_vpa,
       value AS amount,
       CASE WHEN event_type IN ('purchase','click') THEN 'P2M' ELSE 'P2P' END AS txn_type,
       CASE event_type WHEN 'view' THEN 'COLLECT_REQUEST' WHEN 'purchase' THEN 'SCAN_QR'
                       WHEN 'click' THEN 'INTENT' ELSE 'CONTACT' END AS initiation_mode,
       concat('dev-', (user_id * 7 + k) % 200) AS device_id,
       concat('b', user_id % 8) AS payer_bank, concat('b', k % 8) AS payee_bank,
       CAST(user_id * 37 % 4000 AS INT) AS payer_account_age_days,
       ((event_type = 'error' AND value > 100) OR event_id % 211 = 0) AS label_is_fraud,
       CASE WHEN (event_type = 'error' AND value > 100) OR event_id % 211 = 0
            THEN CASE k % 4 WHEN 0 THEN 'MULE_FANIN' WHEN 1 THEN 'SCAM_COLLECT'
                            WHEN 2 THEN 'ATO_BURST' ELSE 'QR_SWAP' END
            ELSE 'legit' END AS label_typology
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e"""

TXN_TIES = """
SELECT concat('t', o_orderkey) AS txn_id, o_orderdate AS ts,
       concat('u', o_custkey % 50, '@bank') AS payer_vpa, concat('m', o_orderkey % 7, '@ybl') AS payee_vpa,
       o_totalprice AS amount,
       CASE WHEN o_orderstatus = 'F' THEN 'P2M' ELSE 'P2P' END AS txn_type,
       CASE WHEN o_orderkey % 5 = 0 THEN 'COLLECT_REQUEST' ELSE 'INTENT' END AS initiation_mode,
       concat('dev-', o_custkey % 20) AS device_id, 'b0' AS payer_bank, 'b1' AS payee_bank,
       CAST(o_custkey % 4000 AS INT) AS payer_account_age_days,
       o_orderkey % 101 = 0 AS label_is_fraud, CAST(NULL AS VARCHAR(20)) AS label_typology
FROM {orders} o"""

DECISIONS = """
SELECT o_orderkey AS id, concat('txn-', o_orderkey) AS txn_id, o_orderdate AS scored_at,
       score AS risk_score, score * 0.9 AS raw_score, o_orderkey % 10 = 0 AS is_cold,
       CASE WHEN score < 0.5 THEN 'ALLOW' WHEN score < 0.8 THEN 'WARN'
            WHEN score < 0.96 THEN 'REVIEW' ELSE 'BLOCK' END AS action,
       CASE WHEN o_orderkey % 10 = 0 THEN 'cold-v1' ELSE 'warm-v1' END AS model_version,
       o_totalprice / 10000 AS latency_ms, o_totalprice AS amount,
       CASE o_orderkey % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'worker' ELSE 'replay' END AS source,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS BOOLEAN)
            ELSE (score > 0.7 AND o_orderkey % 4 = 0) END AS label_is_fraud
FROM (SELECT *, CAST(o_orderkey * 7919 % 10007 AS DOUBLE) / 10007 AS score FROM {orders}) o"""

REVIEW_LABELS = """
SELECT id AS decision_id,
       CASE WHEN id % 5 IN (0, 1, 2) THEN 'CONFIRMED_FRAUD' WHEN id % 5 = 3 THEN 'LEGIT' ELSE 'UNCLEAR' END
         AS disposition,
       id % 4 AS reviewer_id, scored_at AS reviewed_at
FROM {decisions} d WHERE action IN ('REVIEW', 'BLOCK') AND id % 3 = 0"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(TXN, events=table(spark, sf_dir, "events"))
    return df.withColumn("ts", df.ts.cast("timestamp"))


def txn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(TXN_TIES, orders=table(spark, sf_dir, "orders"))
    return df.withColumn("ts", df.ts.cast("timestamp"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(DECISIONS, orders=table(spark, sf_dir, "orders"))
    return df.withColumn("scored_at", df.scored_at.cast("timestamp"))


def review_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REVIEW_LABELS, decisions=decisions(spark, sf_dir))
