"""Stop and target pricing under a rolling range limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.columns import ratio
from candlewright.functions.text import two_places
from candlewright.operators.bars import daily_range


@dataclass(frozen=True)
class RiskRules:
    """Pricing and limit parameters.

    With ``tp_mult`` the target distance is its own ATR multiple; otherwise it is
    the stop distance times ``reward``. ``limit`` is a share of the price range.
    """

    sl_mult: float = 1.4
    reward: float = 2.0
    tp_mult: float | None = None
    sl_tp_enabled: bool = True
    limit_enabled: bool = True
    limit: float = 1.0
    allow_exceed: bool = False


def add_annual_range(bars: DataFrame, days: int = 252, minimum: int = 20,
                     name: str = "annual_range") -> DataFrame:
    """Range of the previous ``days`` trading days, NULL before ``minimum`` of them.

    Rolled over one row per traded day; the current day never counts.
    """
    past = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-days, -1)
    ranges = daily_range(bars).select(
        "symbol", "trade_date",
        F.when(F.count("high").over(past) >= minimum,
               F.max("high").over(past) - F.min("low").over(past)).alias(name))
    return bars.withColumn("trade_date", F.to_date("ts")).join(
        ranges, ["symbol", "trade_date"], "left")


def add_monthly_range(bars: DataFrame, months: int = 12, name: str = "annual_range") -> DataFrame:
    """Range of the previous ``months`` completed months that have bars."""
    past = Window.partitionBy("symbol").orderBy("trade_month").rowsBetween(-months, -1)
    monthly = bars.groupBy("symbol", F.trunc(F.to_date("ts"), "month").alias("trade_month")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"))
    ranges = monthly.select(
        "symbol", "trade_month",
        F.when(F.count("high").over(past) == months,
               F.max("high").over(past) - F.min("low").over(past)).alias(name))
    return bars.withColumn("trade_month", F.trunc(F.to_date("ts"), "month")).join(
        ranges, ["symbol", "trade_month"], "left")


def price_signals(df: DataFrame, rules: RiskRules, signal: str = "signal",
                  atr: str = "atr", price_range: str = "annual_range") -> DataFrame:
    """Entry, stop, target, verdict and comment for every row with a signal.

    Adds ``entry, raw_sl, risk_share, sl, tp, approved, adjusted, comment``. All
    inputs are columns of the same row, so nothing is looked up; the numbers in
    ``rules`` may be columns too, as in a parameter sweep.
    """
    sl_mult, reward, limit = F.lit(rules.sl_mult), F.lit(rules.reward), F.lit(rules.limit)
    sign = F.when(F.col(signal) == "BUY", 1.0).otherwise(-1.0)
    a, rng = F.col(atr), F.col(price_range)
    usable = F.lit(rules.sl_tp_enabled) & F.col(signal).isNotNull() & F.coalesce(
        ~F.isnan(a) & (a > 0), F.lit(False))
    entry = F.when(F.col(signal).isNotNull(), F.col("close"))
    distance = a * sl_mult
    tp_distance = distance * reward if rules.tp_mult is None else a * F.lit(rules.tp_mult)

    out = df.withColumns({"entry": entry, "raw_sl": F.when(usable, entry - sign * distance)})
    entry, raw_sl, share = F.col("entry"), F.col("raw_sl"), F.col("risk_share")
    known = F.lit(rules.limit_enabled) & F.coalesce(rng > 0, F.lit(False))
    out = out.withColumn("risk_share", F.when(known, ratio(F.abs(entry - raw_sl), rng)))

    priced = raw_sl.isNotNull()
    over = (limit < 1.0) & F.coalesce(share > limit, F.lit(False))
    clamped = entry - sign * limit * rng
    moved = F.lit(rules.allow_exceed) & over & (clamped != raw_sl)
    target = reward if rules.tp_mult is None else F.lit(rules.tp_mult) / sl_mult
    clamped_tp = entry + sign * F.abs(entry - clamped) * target
    fine = priced & (F.lit(rules.allow_exceed) | ~over)
    return out.withColumns({
        "sl": F.when(moved, clamped).when(fine, raw_sl),
        "tp": F.when(moved, clamped_tp).when(fine, entry + sign * tp_distance),
        "approved": F.coalesce(fine, F.lit(False)),
        "adjusted": F.coalesce(priced & moved, F.lit(False)),
        "comment": F.when(priced, _comment(rules, limit, over)),
    })


def _comment(rules: RiskRules, limit: Column, over: Column) -> Column:
    """Why a signal passed, was adjusted or was refused."""
    if not rules.limit_enabled:
        return F.lit("Risk mgmt disabled")
    share, cap = two_places(F.col("risk_share") * 100), two_places(limit * 100)
    if rules.allow_exceed:
        beyond = F.concat(F.lit("SL Adjusted: "), share, F.lit("% -> "), cap, F.lit("%"))
    else:
        beyond = F.concat(F.lit("Risk Rejected: "), share, F.lit("% > "), cap, F.lit("%"))
    within = F.concat(F.lit("Risk: "), share, F.lit("% (Limit: "), cap, F.lit("%)"))
    return (F.when(F.col("risk_share").isNull(), "History insufficient for range calc")
            .when(over, beyond).otherwise(within))


def trade_records(priced: DataFrame, *keep: str) -> DataFrame:
    """Approved trades at two decimals (ties to even)."""
    def money(x):
        return F.bround(x, 2)
    entry, sl, tp = F.col("entry"), F.col("sl"), F.col("tp")
    return priced.where("approved").select(
        "symbol", *keep, "ts", "signal",
        money(entry).alias("entry"), money(sl).alias("sl"), money(tp).alias("tp"),
        money(F.abs(entry - sl)).alias("sl_distance"),
        money(F.abs(entry - tp)).alias("tp_distance"),
        "comment",
    )
