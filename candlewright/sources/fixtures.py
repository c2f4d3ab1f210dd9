"""The given tables seen as ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_ticks(spark: SparkSession, root: str) -> DataFrame:
    """``events``: symbol is the event type, price its value, volume ``props.k``."""
    return spark.read.parquet(f"{root}/events.parquet").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"))


def order_ticks(spark: SparkSession, root: str) -> DataFrame:
    """``orders``: symbol is the priority, price the total, volume one per order."""
    return spark.read.parquet(f"{root}/orders.parquet").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("volume"))
