"""Bar tables and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewright.schema import BARS, OHLCV, SIGNAL_COLUMNS, TRADE_COLUMNS

CSV_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    *(T.StructField(c, T.DoubleType()) for c in OHLCV),
])


def read_bars_csv(spark: SparkSession, path: str, symbol: str, **columns: str) -> DataFrame:
    """Bars of one symbol from CSV; header names are matched without regard to case.

    The file has only a wall-clock time, so ``ts_utc`` repeats it.
    """
    header = spark.read.option("header", True).csv(path)
    named = header.withColumnsRenamed({c: c.strip().lower() for c in header.columns})
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in CSV_SCHEMA.fields if f.name in named.columns]
    return named.select(
        F.lit(symbol).alias("symbol"), F.col("timestamp").cast("timestamp_ntz").alias("ts_utc"),
        F.col("timestamp").cast("timestamp_ntz").alias("ts"),
        *[c for c in typed[1:]])


def read_bars_csv_folder(spark: SparkSession, path: str) -> DataFrame:
    """Bars as ``write_bars`` has them in CSV, one folder per symbol; a filter on ``symbol`` prunes folders.

    The columns are in the order they were written, and typed without a look at the data.
    """
    schema = T.StructType([*CSV_SCHEMA.fields, T.StructField("symbol", T.StringType())])
    rows = spark.read.schema(schema).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return rows.select("symbol", F.col("timestamp").alias("ts_utc"), F.col("timestamp").alias("ts"), *OHLCV)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet bar table; filters on its folder columns prune, others reach the scan."""
    schema = T.StructType([*BARS.fields[1:], BARS.fields[0], T.StructField("trade_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def bar_file_name(symbol: str, timeframe: str, start: str, end: str) -> str:
    return f"{symbol}_{timeframe}_{start.replace('-', '')}_{end.replace('-', '')}"


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
               partition_by: tuple[str, ...] = ("trade_date",)) -> None:
    """Parquet by day with symbols in order, or CSV with six decimals by symbol.

    A symbol's day is only some hundred kilobytes, so folders are per day and a
    symbol filter skips row groups; few symbols may ask for ``("symbol",
    "trade_date")``. Rebalancing lets AQE cut files to an even size, also of a day
    or symbol that holds far more than the others.
    """
    if fmt == "parquet":
        out = bars.withColumn("trade_date", F.to_date("ts_utc"))
        (out.hint("rebalance", *(F.col(c) for c in partition_by))
         .sortWithinPartitions(*dict.fromkeys((*partition_by, "symbol", "ts_utc")))
         .write.mode(mode).partitionBy(*partition_by).parquet(path))
    elif fmt == "csv":
        fixed = [F.col(c).cast("decimal(20,6)").alias(c) for c in OHLCV]
        (bars.select("symbol", F.col("ts").alias("timestamp"), *fixed)
         .repartitionByRange("symbol", "timestamp").sortWithinPartitions("symbol", "timestamp")
         .write.mode(mode).partitionBy("symbol").option("header", True)
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    else:
        raise ValueError(f"unknown bar format {fmt!r}")


def _write_csv(df: DataFrame, wanted: list[str], path: str, mode: str) -> None:
    present = [c for c in ["symbol", *wanted] if c in df.columns]
    df.select(*present).write.mode(mode).option("header", True).csv(path)


def write_signals(bars: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The signal columns that are present, as CSV."""
    _write_csv(bars, SIGNAL_COLUMNS, path, mode)


def write_trades(trades: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _write_csv(trades, TRADE_COLUMNS, path, mode)


_KINDS = {"symbol": "string", "ts": "timestamp_ntz", "candle_type": "int", "we_buy": "boolean", "we_sell": "boolean",
          "signal": "string", "comment": "string"}


def _read_csv(spark: SparkSession, wanted: list[str], path: str) -> DataFrame:
    named = spark.read.option("header", True).csv(path)
    return named.select(*(F.col(c).cast(_KINDS.get(c, "double")).alias(c) for c in ["symbol", *wanted] if c in named.columns))


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_signals`` wrote, by the names in its header."""
    return _read_csv(spark, SIGNAL_COLUMNS, path)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, TRADE_COLUMNS, path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Nested report rows; their fields are taken from the files."""
    return spark.read.json(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested report rows as JSON lines, one per symbol or parameter set."""
    report.write.mode(mode).json(path)
