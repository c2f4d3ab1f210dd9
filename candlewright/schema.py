"""Table schemas. Times are TIMESTAMP_NTZ: ``ts_utc`` holds UTC, ``ts`` wall-clock time."""

from pyspark.sql import types as T

TICKS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

BARS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts_utc", T.TimestampNTZType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

PRICES = ["open", "high", "low", "close"]
OHLCV = [*PRICES, "volume"]
SIGNAL_COLUMNS = ["ts", *OHLCV, "candle_type", "we_buy", "we_sell"]
TRADE_COLUMNS = ["ts", "signal", "entry", "sl", "tp", "sl_distance", "tp_distance", "comment"]
