"""Mergeable day summaries: describe any range of days from one small row per symbol, day and column.

A row has the count, mean, sum of squared distances from it, least and greatest value, and a KLL
sketch of the values. Counts, means, deviations and extremes of a range are exact; quantiles are within
``rank_error`` of the wanted rank in 99 of 100 cases. A new day costs a pass over that day alone, and a
day that has changed is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.schema import OHLCV

SUMMARY = ("symbol string, column string, n long, mean double, squares double, min double, max double, sketch binary, "
           "trade_date date")
SIZE = 800
PROBS = (0.25, 0.5, 0.75)


def rank_error(size: int = SIZE) -> float:
    """Share of ranks a quantile of a sketch of this size may be off by, to either side."""
    return 2.296 / size ** 0.9021


def day_summaries(bars: DataFrame, columns: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """One row per symbol, UTC day and column; NULL and NaN are no values, a day without any has no row."""
    melted = bars.select("symbol", F.to_date("ts_utc").alias("trade_date"), F.inline(F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns or OHLCV))))
    value = F.col("value")
    return melted.where(value.isNotNull() & ~F.isnan(value)).groupBy("symbol", "column", "trade_date").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("squares"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch"),
    ).select("symbol", "column", "n", "mean", "squares", "min", "max", "sketch", "trade_date")


def store_summaries(bars: DataFrame, path: str, columns: list[str] | None = None, size: int = SIZE) -> None:
    """Write the summaries of the days in ``bars``; they replace those of these days and no others.

    ``bars`` must hold these days whole.
    """
    (day_summaries(bars, columns, size).hint("rebalance", F.col("trade_date"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(path))


def stored_summaries(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows; a filter on ``trade_date`` prunes folders."""
    return spark.read.schema(SUMMARY).parquet(path)


def describe_days(summaries: DataFrame, probs: tuple[float, ...] = PROBS) -> DataFrame:
    """count, mean, std, min, quantiles (``p25`` and so on) and max per symbol and column over the days given.

    Rows are one per day here, so a window over a symbol's days is small. The deviation is built from
    distances to the common mean, as differences of large sums would lose digits.
    """
    all_days = Window.partitionBy("symbol", "column")
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    rows = summaries.withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(all_days) / F.sum("n").over(all_days))
    around = F.sum(F.col("squares") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2))
    out = rows.groupBy("symbol", "column").agg(
        n.alias("count"), mean.alias("mean"), F.when(n > 1, F.sqrt(around / (n - 1))).alias("std"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("_sketch"))
    return out.withColumns({
        f"p{round(p * 100)}": F.kll_sketch_get_quantile_double("_sketch", F.lit(float(p))) for p in probs}).drop("_sketch")
