"""Registry, shared inputs and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.operators.blocks import index_bars
from candlewright.operators.bars import ticks_to_bars
from candlewright.session import stage
from candlewright.sources.fixtures import event_ticks, order_ticks

M15, H1, H4, D1 = 900, 3600, 14_400, 86_400

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return register


_stored: dict[tuple, DataFrame] = {}


def _version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


def _once(spark: SparkSession, root: str, table: str, seconds: int, build: Callable[[], DataFrame]) -> DataFrame:
    """A stored table per session and version of its input, built again if its files are gone."""
    key = (spark.sparkContext.applicationId, _version(spark, f"{root}/{table}.parquet"), seconds)
    df = _stored.get(key)
    if df is not None:
        try:
            df.limit(1).collect()
            return df
        except (AnalysisException, PySparkException):
            pass
    _stored[key] = build()
    return _stored[key]


def event_bars(spark: SparkSession, root: str, seconds: int = M15) -> DataFrame:
    """Stored, indexed bars of ``events``."""
    return _once(spark, root, "events", seconds, lambda: stage(index_bars(
        stage(ticks_to_bars(event_ticks(spark, root), seconds), "bars")), "indexed"))


def order_bars(spark: SparkSession, root: str) -> DataFrame:
    """Stored, indexed day bars of ``orders``."""
    return _once(spark, root, "orders", D1, lambda: stage(index_bars(
        stage(ticks_to_bars(order_ticks(spark, root), D1), "bars")), "indexed"))


def rounded(x: Column | str, places: int = 6) -> Column:
    """Rounded, with negative zero folded into zero."""
    return F.round(x, places) + F.lit(0.0)


def show(df: DataFrame, *plain: str, places: int = 6, **columns: Column | str) -> DataFrame:
    return df.select(*plain, *(rounded(x, places).alias(k) for k, x in columns.items()))


# --- SQL fragments ------------------------------------------------------------

EVENT_TICKS = """t AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price,
  CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS volume FROM events)"""

ORDER_TICKS = """t AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS seq,
  o_totalprice AS price, 1.0::DOUBLE AS volume FROM orders)"""


def _bars(seconds: int) -> str:
    return f"""d AS (SELECT symbol, ts, price, arg_max(volume, seq) AS volume, max(seq) AS seq FROM t GROUP BY ALL),
b AS MATERIALIZED (SELECT symbol, time_bucket(INTERVAL '{seconds} seconds', ts) AS ts,
  first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, seq) AS close, sum(volume) AS volume FROM d GROUP BY 1, 2),
i AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS n, lag(ts) OVER w AS pts, lag(open) OVER w AS po,
  lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc,
  greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def bars_sql(seconds: int = M15, ticks: str = EVENT_TICKS, recursive: bool = False) -> str:
    """WITH list giving ``b`` (bars) and ``i`` (bars with row number ``n``, lags and true range)."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{ticks}, {_bars(seconds)}"


def trigger_sql(htf: int, source: str = "i") -> str:
    """CTEs ending in ``g``: candle type, reversals, bias, trigger and raw signal."""
    return f"""c1 AS (SELECT *, CASE WHEN high <= ph AND low >= pl THEN 1 WHEN high > ph AND low < pl THEN 3
  WHEN high > ph AND low >= pl THEN 2 WHEN low < pl AND high <= ph THEN -2 END AS candle_type,
  time_bucket(INTERVAL '{htf} seconds', ts) AS htf_ts FROM {source}),
hb AS (SELECT symbol, htf_ts, first(open ORDER BY ts) AS ho, last(close ORDER BY ts) AS hc FROM c1 GROUP BY 1, 2),
c2 AS (SELECT c1.*, hc > ho AS htf_bull, hc < ho AS htf_bear,
  lag(candle_type) OVER (PARTITION BY symbol ORDER BY ts) AS pt FROM c1 JOIN hb USING (symbol, htf_ts)),
c3 AS (SELECT *, coalesce(pt = -2 AND candle_type = 2, false) AS rev_up,
  coalesce(pt = 2 AND candle_type = -2, false) AS rev_down FROM c2),
g AS MATERIALIZED (SELECT *, rev_up AND htf_bull AS we_buy, rev_down AND htf_bear AS we_sell,
  CASE WHEN rev_down AND htf_bear THEN 'SELL' WHEN rev_up AND htf_bull THEN 'BUY' END AS sig FROM c3)"""


def smooth_sql(name: str, source: str, columns: dict[str, tuple[str, float]], key: str = "symbol") -> str:
    """Recursive CTE ``name(symbol, n, ...)``: y = (1-a)*y + a*x from y0 = x0, one column each."""
    first = ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for c, (x, _) in columns.items())
    step = ", ".join(f"(1 - {a!r}) * r.{c} + {a!r} * s.{c}_x" for c, (_, a) in columns.items())
    inputs = ", ".join(f"CAST({x} AS DOUBLE) AS {c}_x" for c, (x, _) in columns.items())
    return f"""{name}_in AS MATERIALIZED (SELECT symbol, n, {inputs} FROM {source}),
{name} AS (SELECT symbol, n, {first} FROM {source} WHERE n = 0
  UNION ALL SELECT s.symbol, s.n, {step} FROM {name} r JOIN {name}_in s ON s.symbol = r.symbol AND s.n = r.n + 1)"""


def gate_sql(long: str, short: str) -> str:
    return f"coalesce({long}, false) AS \"long\", coalesce({short}, false) AS \"short\""


def r6(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0 AS {name}"
