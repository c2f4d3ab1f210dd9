"""Bar data checks."""

from pyspark.sql import functions as F

from candlewright.catalog.base import (
    D1, M15, ORDER_TICKS, bars_sql, event_bars, order_bars, query, rounded)
from candlewright.operators import quality as q
from candlewright.plans.validation import validate_bars
from candlewright.session import stage


def rough_bars(spark, root):
    """``lineitem`` read as bars: many faults, unordered arrival, repeated timestamps."""
    price = F.col("l_extendedprice")
    return spark.read.parquet(f"{root}/lineitem.parquet").select(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        price.alias("open"), (price * (1 + F.col("l_tax"))).alias("high"),
        (price * (1 - F.col("l_discount"))).alias("low"), (F.col("l_quantity") * 1000 - 5000).alias("close"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("volume"))


ROUGH = """x AS (SELECT l_returnflag AS symbol, l_shipdate AS ts, l_extendedprice AS open,
  l_extendedprice * (1 + l_tax) AS high, l_extendedprice * (1 - l_discount) AS low,
  l_quantity * 1000 - 5000 AS close, CASE WHEN l_tax > 0 THEN l_quantity END AS volume FROM lineitem)"""


def flat(df, *metrics):
    """Checks with the named metrics as columns."""
    return df.select("symbol", "check", "status", *(
        rounded(F.try_element_at("metrics", F.lit(m))).alias(m) for m in metrics))


@query("dq_missing_values", f"""WITH {ROUGH} SELECT symbol, 'missing_values' AS "check",
  CASE WHEN count(*) > count(volume) THEN 'WARNING' ELSE 'PASS' END AS status,
  (count(*) - count(volume))::DOUBLE AS volume, (count(*) - count(volume))::DOUBLE AS total FROM x GROUP BY 1""")
def dq_missing_values(spark, root):
    return flat(q.run_checks(q.bar_profile(rough_bars(spark, root)), q.missing_values()), "volume", "total")


@query("dq_duplicates", f"""WITH {ROUGH} SELECT symbol, 'duplicates' AS "check",
  CASE WHEN count(*) > count(DISTINCT ts) THEN 'WARNING' ELSE 'PASS' END AS status,
  (count(*) - count(DISTINCT ts))::DOUBLE AS count FROM x GROUP BY 1""")
def dq_duplicates(spark, root):
    return flat(q.duplicate_timestamps(rough_bars(spark, root)), "count")


_BAD = "high < low OR open > high OR open < low OR close > high OR close < low"


@query("dq_ohlc_consistency", f"""WITH {ROUGH} SELECT symbol, 'ohlc_consistency' AS "check",
  CASE WHEN count(*) FILTER ({_BAD}) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  (count(*) FILTER ({_BAD}))::DOUBLE AS count FROM x GROUP BY 1""")
def dq_ohlc_consistency(spark, root):
    return flat(q.run_checks(q.bar_profile(rough_bars(spark, root)), q.ohlc_consistency()), "count")


@query("dq_price_validation", f"""WITH {ROUGH} SELECT symbol, 'price_validation' AS "check",
  CASE WHEN count(*) FILTER (close <= 0 OR open <= 0 OR high <= 0 OR low <= 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  (count(*) FILTER (open <= 0))::DOUBLE AS open, (count(*) FILTER (close <= 0))::DOUBLE AS close FROM x GROUP BY 1""")
def dq_price_validation(spark, root):
    return flat(q.run_checks(q.bar_profile(rough_bars(spark, root)), q.nonpositive_prices()), "open", "close")


@query("dq_time_order", """WITH s AS (SELECT o_orderpriority AS symbol,
  o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS back FROM orders)
  SELECT symbol, 'timestamp_order' AS "check", CASE WHEN count(*) FILTER (back) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  (count(*) FILTER (back))::DOUBLE AS count FROM s GROUP BY 1""")
def dq_time_order(spark, root):
    arrivals = spark.read.parquet(f"{root}/orders.parquet").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_orderkey")
    return flat(q.time_order(arrivals, "o_orderkey", chunk=1024), "count")


_GAP = bars_sql(D1, ORDER_TICKS) + ", z AS (SELECT symbol, epoch(ts) - epoch(pts) AS diff FROM i)"


@query("dq_gaps", _GAP + """ SELECT symbol, 'gaps' AS "check",
  CASE WHEN count(*) FILTER (diff > 86400) > 10 THEN 'WARNING' WHEN count(*) FILTER (diff > 3600) > 0 THEN 'INFO' ELSE 'PASS' END AS status,
  (count(*) FILTER (diff > 86400))::DOUBLE AS large_gaps, (count(*) FILTER (diff > 3600 AND diff <= 86400))::DOUBLE AS regular_gaps,
  max(diff) FILTER (diff > 86400) + 0.0 AS max_gap_seconds, round(avg(diff) FILTER (diff > 86400), 6) + 0.0 AS avg_gap_seconds FROM z GROUP BY 1""")
def dq_gaps(spark, root):
    return flat(q.run_checks(q.bar_profile(order_bars(spark, root), 3600), q.gaps()),
                "large_gaps", "regular_gaps", "max_gap_seconds", "avg_gap_seconds")


@query("dq_intervals", bars_sql(M15) + """, z AS (SELECT symbol, epoch(ts) - epoch(pts) AS diff FROM i WHERE pts IS NOT NULL),
  k AS (SELECT symbol, diff, count(*) AS n FROM z GROUP BY 1, 2)
  SELECT symbol, diff, n, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, diff) AS rank FROM k QUALIFY rank <= 10""")
def dq_intervals(spark, root):
    return q.interval_distribution(event_bars(spark, root))


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT symbol, '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 4) + 0.0 AS std,
  min({c}) AS min, round(quantile_cont({c}, 0.25), 4) + 0.0 AS p25, round(quantile_cont({c}, 0.5), 4) + 0.0 AS p50,
  round(quantile_cont({c}, 0.75), 4) + 0.0 AS p75, max({c}) AS max FROM i GROUP BY 1""" for c in ("open", "high", "low", "close", "volume"))


@query("dq_describe", f"{bars_sql(M15)} {_DESCRIBE}")
def dq_describe(spark, root):
    df = q.describe(event_bars(spark, root))
    return df.select("symbol", "column", "count", rounded("mean", 4).alias("mean"), rounded("std", 4).alias("std"),
                     "min", *(rounded(p, 4).alias(p) for p in ("p25", "p50", "p75")), "max")


_MOVE = bars_sql(M15) + ", z AS (SELECT symbol, CASE WHEN pc = 0 AND close <> 0 THEN 'inf'::DOUBLE ELSE abs((close - pc) / nullif(pc, 0)) END AS move FROM i)"


@query("dq_large_moves", _MOVE + """ SELECT symbol, 'price_changes' AS "check",
  CASE WHEN count(*) FILTER (move > 0.05) > 10 THEN 'WARNING' WHEN count(*) FILTER (move > 0.05) > 0 THEN 'INFO' ELSE 'PASS' END AS status,
  (count(*) FILTER (move > 0.05))::DOUBLE AS large_move_count, round(max(move) * 100, 6) + 0.0 AS max_move_percent FROM z GROUP BY 1""")
def dq_large_moves(spark, root):
    return flat(q.run_checks(q.bar_profile(event_bars(spark, root), M15), q.large_moves()), "large_move_count", "max_move_percent")


@query("dq_warm_up", bars_sql(M15) + """ SELECT symbol, 'indicator_compatibility' AS "check",
  CASE WHEN count(*) < 14 THEN 'FAIL' ELSE 'PASS' END AS status, count(*)::DOUBLE AS bars FROM b GROUP BY 1""")
def dq_warm_up(spark, root):
    return flat(q.run_checks(q.bar_profile(event_bars(spark, root)), q.warm_up(14)), "bars")


@query("dq_range_coverage", bars_sql(M15) + """ SELECT symbol, 'date_range' AS "check",
  CASE WHEN min(ts) > TIMESTAMP '2024-01-01 00:10:00' OR max(ts) < TIMESTAMP '2024-01-29 00:00:00' THEN 'WARNING' ELSE 'PASS' END AS status
  FROM b GROUP BY 1""")
def dq_range_coverage(spark, root):
    profile = q.bar_profile(event_bars(spark, root))
    return flat(q.run_checks(profile, q.range_coverage("2024-01-01 00:10:00", "2024-01-29 00:00:00")))


@query("dq_overall", f"""WITH {ROUGH} SELECT symbol, CASE WHEN count(*) FILTER ({_BAD}) > 0
  OR count(*) FILTER (least(open, high, low, close) <= 0) > 0 THEN 'FAIL'
  WHEN count(*) > count(volume) OR count(*) > count(DISTINCT ts) THEN 'WARNING' ELSE 'PASS' END AS status,
  NOT (count(*) FILTER ({_BAD}) > 0 OR count(*) FILTER (least(open, high, low, close) <= 0) > 0) AS usable FROM x GROUP BY 1""")
def dq_overall(spark, root):
    bars = rough_bars(spark, root)
    profile = q.bar_profile(bars)
    return q.overall_status(q.union_checks(
        q.run_checks(profile, q.missing_values(), q.ohlc_consistency(), q.nonpositive_prices()),
        q.duplicate_timestamps(bars)))


def _row(category: str, check: str, status: str) -> str:
    return f"{{'category': '{category}', 'check': '{check}', 'status': {status}}}"


def _when(bad: str, level: str) -> str:
    return f"CASE WHEN {bad} THEN '{level}' ELSE 'PASS' END"


_ROWS = ", ".join([
    _row("schema", "schema", "'PASS'"), _row("schema", "index", "'PASS'"),
    _row("quality", "missing_values", _when("nulls > 0", "WARNING")),
    _row("quality", "duplicates", _when("dups > 0", "WARNING")),
    _row("quality", "ohlc_consistency", _when("bad > 0", "FAIL")),
    _row("quality", "price_validation", _when("nonpos > 0", "FAIL")),
    _row("quality", "timestamp_order", "'PASS'"),
    _row("continuity", "gaps", "CASE WHEN steps = 0 THEN 'SKIP' WHEN large > 10 THEN 'WARNING' WHEN large + regular > 0 THEN 'INFO' ELSE 'PASS' END"),
    _row("statistics", "price_changes", "CASE WHEN moves > 10 THEN 'WARNING' WHEN moves > 0 THEN 'INFO' ELSE 'PASS' END"),
    _row("compatibility", "indicator_compatibility", _when("bars < 14", "FAIL")),
])


@query("dq_validate", _MOVE.replace("z AS (SELECT symbol, ", "z AS (SELECT *, epoch(ts) - epoch(pts) AS diff, ") + f""", v AS (SELECT symbol, count(*) AS bars,
  count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS nulls, count(*) - count(DISTINCT ts) AS dups, count(*) FILTER ({_BAD}) AS bad,
  count(*) FILTER (least(open, high, low, close) <= 0) AS nonpos, count(diff) AS steps, count(*) FILTER (diff > 86400) AS large,
  count(*) FILTER (diff > 900 AND diff <= 86400) AS regular, count(*) FILTER (move > 0.05) AS moves FROM z GROUP BY 1)
  SELECT symbol, unnest([{_ROWS}], recursive := true) FROM v""")
def dq_validate(spark, root):
    checks = stage(validate_bars(event_bars(spark, root), M15), "checks")
    return checks.select("symbol", "category", "check", "status")
