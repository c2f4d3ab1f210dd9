"""Attaching higher-time-frame values to base bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.columns import bucket_start
from candlewright.operators.bars import rollup_htf
from candlewright.operators.blocks import index_bars, lag, over_blocks
from candlewright.session import stage


def htf_bars(bars: DataFrame, seconds: int) -> DataFrame:
    """Indexed higher-time-frame bars; ``ts_utc`` and ``ts`` both hold the bucket label."""
    rolled = rollup_htf(bars, seconds, "ts_utc").withColumn("ts", F.col("ts_utc"))
    return index_bars(stage(rolled, "htf"))


def attach_own(bars: DataFrame, htf: DataFrame, seconds: int, columns: list[str]) -> DataFrame:
    """Values of the bucket each bar belongs to (future of the bucket included)."""
    right = htf.select("symbol", F.col("ts_utc").alias("htf_ts"), *columns)
    return bars.withColumn("htf_ts", bucket_start("ts", seconds)).join(
        right, ["symbol", "htf_ts"], "left")


def attach_completed(bars: DataFrame, htf: DataFrame, seconds: int, columns: list[str]) -> DataFrame:
    """Values of the last completed bucket before the bar's own one."""
    shifted = over_blocks(htf, 1, [{c: lag(c) for c in columns}])
    return attach_own(bars, shifted, seconds, columns)


def add_completed_bias(bars: DataFrame, seconds: int) -> DataFrame:
    htf = htf_bars(bars, seconds).withColumns({
        "htf_bull": F.col("close") > F.col("open"),
        "htf_bear": F.col("close") < F.col("open"),
    })
    out = attach_completed(bars, htf, seconds, ["htf_bull", "htf_bear"])
    return out.fillna(False, ["htf_bull", "htf_bear"])


def attach_asof(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Last ``right`` row at or before each ``left`` row, by (symbol, ts_utc).

    For sparse tables that do not line up on a bucket. Rows are ordered inside a
    day only; what a day starts from comes from one summary row per day.
    """
    value = F.struct(*columns)
    tagged = (
        right.select("symbol", "ts_utc", value.alias("_v"))
        .withColumn("_left", F.lit(None).cast(_row_type(left)))
        .unionByName(
            left.select("symbol", "ts_utc", F.struct(*left.columns).alias("_left")),
            allowMissingColumns=True,
        )
        .withColumn("_day", F.to_date("ts_utc"))
    )
    in_day = (
        Window.partitionBy("symbol", "_day")
        .orderBy("ts_utc", F.col("_left").isNotNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    days = tagged.groupBy("symbol", "_day").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("ts_utc"))).alias("_last"))
    calendar = (
        Window.partitionBy("symbol").orderBy("_day")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = days.select("symbol", "_day", F.last("_last", True).over(calendar).alias("_head"))
    return (
        tagged.withColumn("_v", F.last("_v", True).over(in_day))
        .where(F.col("_left").isNotNull())
        .join(heads, ["symbol", "_day"])
        .withColumn("_v", F.coalesce("_v", "_head"))
        .select("_left.*", *(F.col(f"_v.{c}").alias(c) for c in columns))
    )


def _row_type(df: DataFrame):
    return df.schema
