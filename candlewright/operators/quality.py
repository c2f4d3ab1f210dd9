"""Bar data checks: ``symbol, category, check, status, message, metrics``.

Most checks are columns over :func:`bar_profile`, one aggregate pass for all of
them; duplicates and arrival order need a shuffle each and are tables themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewright.functions.columns import ratio, seconds_between
from candlewright.operators.quantiles import exact_quantiles
from candlewright.schema import OHLCV, PRICES

DAY = 86_400.0
LARGE_MOVE = 0.05
SEVERITY = {"PASS": 0, "INFO": 0, "SKIP": 0, "WARNING": 1, "FAIL": 2}
TIME_TYPES = (T.TimestampType, T.TimestampNTZType)


def _check(category: str, check: str, status: Column, message: Column, metrics: dict[str, Column]) -> Column:
    pairs = [x for name, value in metrics.items() for x in (F.lit(name), value.cast("double"))]
    metric = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return F.struct(F.lit(category).alias("category"), F.lit(check).alias("check"),
                    status.alias("status"), message.alias("message"), metric.alias("metrics"))


def run_checks(profile: DataFrame, *checks: Column) -> DataFrame:
    """One row per symbol and check."""
    return profile.select("symbol", F.inline(F.array(*checks)))


def _status(bad: Column, level: str) -> Column:
    return F.when(bad, level).otherwise("PASS")


def check_schema(df: DataFrame) -> list[dict[str, str]]:
    """Required columns and time type, from the schema alone."""
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in OHLCV if c not in types]
    time_ok = isinstance(types.get("ts"), TIME_TYPES)
    return [
        {"category": "schema", "check": "schema", "status": "FAIL" if missing else "PASS",
         "message": f"Missing required columns: {missing}" if missing
         else f"All required columns present: {OHLCV}"},
        {"category": "schema", "check": "index", "status": "PASS" if time_ok else "FAIL",
         "message": "Time column is a timestamp" if time_ok else "Time column is not a timestamp"},
    ]


def fixed_check(row: dict[str, str]) -> Column:
    """A schema check as a constant, the same for every symbol."""
    return _check(row["category"], row["check"], F.lit(row["status"]), F.lit(row["message"]), {})


def bar_profile(bars: DataFrame, bar_seconds: int | None = None) -> DataFrame:
    """Every count the checks need, in a single aggregate pass.

    With ``bar_seconds`` the steps between bars are profiled too; ``bars`` must be
    indexed then.
    """
    o, h, l, c = (F.col(x) for x in PRICES)
    bad = (h < l) | (o > h) | (o < l) | (c > h) | (c < l)
    columns = [
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(F.col(x).isNull()).alias(f"null_{x}") for x in OHLCV),
        F.count_if(bad).alias("bad_ohlc"),
        *(F.count_if(F.col(x) <= 0).alias(f"nonpos_{x}") for x in PRICES),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    ]
    if bar_seconds is not None:
        diff = seconds_between("prev_ts_utc", "ts_utc")
        large, regular = diff > DAY, (diff > bar_seconds) & (diff <= DAY)
        before = F.col("prev_close")
        move = F.when((before == 0) & (c != 0), float("inf")).otherwise(F.abs(ratio(c - before, before)))
        columns += [
            F.count(diff).alias("steps"), F.count_if(large).alias("large"), F.count_if(regular).alias("regular"),
            F.max(F.when(large, diff)).alias("max_gap"), F.avg(F.when(large, diff)).alias("avg_gap"),
            F.count_if(move > LARGE_MOVE).alias("moves"), (F.max(move) * 100).alias("max_move"),
        ]
    return bars.groupBy("symbol").agg(*columns)


def missing_values() -> Column:
    total = sum((F.col(f"null_{c}") for c in OHLCV), F.lit(0))
    return _check("quality", "missing_values", _status(total > 0, "WARNING"),
                  F.when(total > 0, F.concat(F.lit("Missing values found: "), total.cast("string")))
                  .otherwise("No missing values"),
                  {**{c: F.col(f"null_{c}") for c in OHLCV}, "total": total})


def ohlc_consistency() -> Column:
    n = F.col("bad_ohlc")
    return _check("quality", "ohlc_consistency", _status(n > 0, "FAIL"),
                  F.when(n > 0, F.format_string("Found %d bars with invalid OHLC relationships", n))
                  .otherwise("OHLC consistency OK"), {"count": n})


def nonpositive_prices() -> Column:
    total = sum((F.col(f"nonpos_{c}") for c in PRICES), F.lit(0))
    return _check("quality", "price_validation", _status(total > 0, "FAIL"),
                  F.when(total > 0, F.concat(F.lit("Found non-positive prices: "), total.cast("string")))
                  .otherwise("All prices positive"),
                  {c: F.col(f"nonpos_{c}") for c in PRICES})


def gaps() -> Column:
    """Regular gaps (longer than a bar) and large gaps (over 24 hours)."""
    steps, large, regular = F.col("steps"), F.col("large"), F.col("regular")
    status = (F.when(steps == 0, "SKIP").when(large > 10, "WARNING")
              .when(large + regular > 0, "INFO").otherwise("PASS"))
    message = (
        F.when(steps == 0, "Not enough data points for continuity check")
        .when(large > 0, F.format_string("Found %d time gaps (%d > 24h, %d regular)", large + regular, large, regular))
        .when(regular > 0, F.format_string("Found %d regular time gaps (market closures, weekends)", regular))
        .otherwise("No significant time gaps found"))
    return _check("continuity", "gaps", status, message,
                  {"large_gaps": large, "regular_gaps": regular,
                   "max_gap_seconds": F.col("max_gap"), "avg_gap_seconds": F.col("avg_gap")})


def large_moves() -> Column:
    n = F.col("moves")
    status = F.when(n > 10, "WARNING").when(n > 0, "INFO").otherwise("PASS")
    message = F.when(n > 0, F.format_string("Found %d price moves > 5%% (max: %.2f%%)", n, F.col("max_move"))
                     ).otherwise("No large price moves")
    return _check("statistics", "price_changes", status, message,
                  {"large_move_count": n, "max_move_percent": F.col("max_move")})


def warm_up(rsi_length: int) -> Column:
    n = F.col("n")
    return _check("compatibility", "indicator_compatibility", _status(n < rsi_length, "FAIL"),
                  F.when(n < rsi_length, F.format_string(
                      f"Not enough data for RSI (length={rsi_length}). Need at least {rsi_length} bars, have %d", n))
                  .otherwise(f"Sufficient data for RSI (length={rsi_length})"), {"bars": n})


def range_coverage(start: str, end: str) -> Column:
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    short = (F.col("first_ts") > a) | (F.col("last_ts") < b)
    return _check("compatibility", "date_range", _status(short, "WARNING"),
                  F.when(short, "Data does not fully cover the requested range")
                  .otherwise("Data fully covers requested date range"), {})


def duplicate_timestamps(bars: DataFrame) -> DataFrame:
    """Rows beyond the first per (symbol, ts); two combinable counts."""
    n = F.col("count")
    dup = bars.groupBy("symbol", "ts").count().groupBy("symbol").agg(F.sum(n - 1).alias("count"))
    return run_checks(dup, _check(
        "quality", "duplicates", _status(n > 0, "WARNING"),
        F.when(n > 0, F.format_string("Found %d duplicate timestamps", n)).otherwise("No duplicate timestamps"),
        {"count": n}))


def time_order(bars: DataFrame, sequence: str, chunk: int = 65_536) -> DataFrame:
    """Steps back in time along the ingest sequence, checked before any sorting.

    Ordered inside chunks of the sequence number, then across chunk summaries.
    """
    df = bars.select("symbol", "ts", F.col(sequence).alias("_seq")).withColumn(
        "_chunk", F.floor(F.col("_seq") / chunk))
    inside = Window.partitionBy("symbol", "_chunk").orderBy("_seq")
    steps = df.withColumn("_back", F.col("ts") < F.lag("ts").over(inside))
    chunks = steps.groupBy("symbol", "_chunk").agg(
        F.count_if("_back").alias("_bad"),
        F.min_by("ts", "_seq").alias("_first"), F.max_by("ts", "_seq").alias("_last"))
    across = Window.partitionBy("symbol").orderBy("_chunk")
    total = chunks.withColumn(
        "_bad", F.col("_bad") + F.coalesce((F.col("_first") < F.lag("_last").over(across)).cast("int"), F.lit(0))
    ).groupBy("symbol").agg(F.sum("_bad").alias("count"))
    n = F.col("count")
    return run_checks(total, _check(
        "quality", "timestamp_order", _status(n > 0, "FAIL"),
        F.when(n > 0, "Timestamps are not monotonic increasing").otherwise("Timestamps are monotonic increasing"),
        {"count": n}))


def interval_distribution(indexed: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent bar distances per symbol; equal counts rank by distance."""
    diff = seconds_between("prev_ts_utc", "ts_utc")
    counts = (indexed.where(F.col("prev_ts_utc").isNotNull())
              .groupBy("symbol", diff.alias("diff")).agg(F.count(F.lit(1)).alias("n")))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("n"), "diff"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def describe(bars: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles and max per symbol and column."""
    columns = columns or OHLCV
    melted = bars.select("symbol", F.inline(F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))))
    keys = ["symbol", "column"]
    value = F.col("value")
    extra = []
    if approximate:
        extra = [F.percentile_approx(value, p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    stats = melted.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), *extra)
    if approximate:
        return stats
    q = exact_quantiles(melted, keys, [0.25, 0.5, 0.75])
    wide = q.groupBy(*keys).agg(*(
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"p{int(p * 100)}")
        for p in (0.25, 0.5, 0.75)))
    return stats.join(wide, keys, "left")


def overall_status(checks: DataFrame) -> DataFrame:
    """Worst status per symbol and whether the data may be used."""
    rank = F.create_map(*(x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))))
    worst = F.max(rank[F.col("status")])
    return checks.groupBy("symbol").agg(worst.alias("_w")).select(
        "symbol", F.element_at(F.array(F.lit("PASS"), F.lit("WARNING"), F.lit("FAIL")), F.col("_w") + 1).alias("status"),
        (F.col("_w") < 2).alias("usable"))


def union_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
