"""The older card-style data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DROPPED = ("Merchant_id", "TransactionDate")
NUMERIC = ("AverageAmountTransactionDay", "TransactionAmount", "TotalNumberOfDeclinesDay", "DailyChargebackAvgAmt",
           "Six_MonthAvgChbkAmt", "Six_MonthChbkFreq")
YES_NO = ("Is_declined", "isForeignTransaction", "isHighRiskCountry")
# The order the older model expects its inputs in.
FEATURES = ("AverageAmountTransactionDay", "TransactionAmount", "Is_declined", "TotalNumberOfDeclinesDay",
            "isForeignTransaction", "isHighRiskCountry", "DailyChargebackAvgAmt", "Six_MonthAvgChbkAmt",
            "Six_MonthChbkFreq")
TARGET = "isFradulent"
SCHEMA = ("Merchant_id long, TransactionDate string, AverageAmountTransactionDay double, TransactionAmount double, "
          "Is_declined string, TotalNumberOfDeclinesDay long, isForeignTransaction string, isHighRiskCountry string, "
          "DailyChargebackAvgAmt double, Six_MonthAvgChbkAmt double, Six_MonthChbkFreq long, isFradulent string")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The CSV without its identifier and its empty date column."""
    df = spark.read.option("header", True).schema(SCHEMA).option("enforceSchema", False).csv(path)
    return df.drop(*DROPPED)


def features_and_target(df: DataFrame) -> DataFrame:
    return df.select(*FEATURES, TARGET)
