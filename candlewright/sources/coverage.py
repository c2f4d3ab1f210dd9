"""Which hours are there and which are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.sources.ticks import path_keys


def present_hours(files: DataFrame) -> DataFrame:
    """(symbol, hour_ts) of non-empty files; ``files`` has ``path`` and ``length``."""
    keyed = files.withColumns(path_keys())
    return keyed.where((F.col("length") > 0) & F.col("hour_ts").isNotNull()).select("symbol", "hour_ts").distinct()


def coverage(hours: DataFrame) -> DataFrame:
    return hours.groupBy("symbol").agg(
        F.min("hour_ts").alias("first_hour"), F.max("hour_ts").alias("last_hour"),
        F.count(F.lit(1)).alias("hours"))


def missing_hours(hours: DataFrame, start: str, end: str) -> DataFrame:
    """Hours of the inclusive grid ``start..end`` that no symbol file covers."""
    first, last = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    grid = hours.select("symbol").distinct().select(
        "symbol", F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias("hour_ts"))
    return grid.join(hours, ["symbol", "hour_ts"], "left_anti")


def delta_hours(hours: DataFrame, now: str, max_days: int | None = None) -> DataFrame:
    """Hours to fetch per symbol: after its last one up to the last full hour before ``now``.

    With ``max_days``, a symbol further behind is refused: ``hour_ts`` NULL, ``refused`` true.
    """
    hour = F.expr("interval 1 hour")
    end = F.date_trunc("hour", F.lit(now)).cast("timestamp_ntz") - hour
    spans = hours.groupBy("symbol").agg(F.max("hour_ts").alias("last")).withColumns({
        "from": F.col("last") + hour, "to": end,
    }).where(F.col("from") < F.col("to"))
    refused = F.lit(False) if max_days is None else F.col("from") < F.col("to") - F.make_dt_interval(F.lit(max_days))
    return spans.withColumn("refused", refused).select(
        "symbol", "refused",
        F.explode_outer(F.when(~F.col("refused"), F.sequence("from", "to", hour))).alias("hour_ts"))
