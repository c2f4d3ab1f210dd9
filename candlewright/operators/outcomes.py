"""What became of the trades: exits, selection, performance, equity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.columns import ratio
from candlewright.operators.chained import CHAIN_ROWS, run_chained

FANOUT = 128
RUIN = -1e6          # log growth that no later gain brings back: exp() of it is 0.0


def _level_one(bars: DataFrame, fanout: int) -> DataFrame:
    return bars.groupBy("symbol", F.floor(F.col("bar_no") / fanout).alias("no")).agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("bar_no").alias("no"), "low", "high", "ts_utc"))).alias("parts"),
        F.min("low").alias("low"), F.max("high").alias("high"))


def _level_up(below: DataFrame, fanout: int) -> DataFrame:
    return below.groupBy("symbol", F.floor(F.col("no") / fanout).alias("no")).agg(
        F.sort_array(F.collect_list(F.struct("no", "low", "high"))).alias("parts"),
        F.min("low").alias("low"), F.max("high").alias("high"))


def _levels_for(bars: DataFrame, fanout: int) -> int:
    """Levels that cover the longest series, from one number."""
    last = bars.agg(F.max("bar_no")).first()[0] or 0
    levels = 1
    while fanout ** levels <= last:
        levels += 1
    return levels


def first_touch(signals: DataFrame, bars: DataFrame, fanout: int = FANOUT,
                levels: int | None = None) -> DataFrame:
    """First later bar that reaches the stop or the target, at any distance.

    Bars are grouped into blocks of ``fanout``, those into larger ones and so on,
    each knowing its low and high. A signal looks through the rest of its own
    block on every level until something hits, then walks down to the bar: one
    matching row per join, whatever the horizon. ``signals`` need ``symbol,
    bar_no, sl, tp``; adds ``exit_no, exit_ts, exit_reason, exit_price``. A bar
    reaching both counts as stopped. ``bars`` should be stored; its longest series
    sets the number of levels unless given.
    """
    levels = levels or _levels_for(bars, fanout)
    tables = [_level_one(bars, fanout)]
    for _ in range(levels - 1):
        tables.append(_level_up(tables[-1], fanout))
    floor_, ceiling = F.least("sl", "tp"), F.greatest("sl", "tp")

    def search(df: DataFrame, level: int, key: Column, after: Column, found: str, wanted: Column) -> DataFrame:
        table = tables[level].select(
            "symbol", F.col("no").alias("_no"), F.col("parts").alias("_parts"))
        hit = F.get(F.filter("_parts", lambda p: (p["no"] > F.col("_after")) & (
            (p["low"] <= F.col("_floor")) | (p["high"] >= F.col("_ceiling")))), F.lit(0))
        # Signals that need no look here get keys of their own that match nothing, so
        # they do not pile up on the few blocks of the upper levels.
        nothing = -1 - F.col("bar_no")
        return (
            df.withColumns({"_no": F.when(wanted, key).otherwise(nothing), "_after": after})
            .join(table, ["symbol", "_no"], "left")
            .withColumn(found, hit if level == 0 else hit["no"])
            .drop("_no", "_after", "_parts")
        )

    reach = fanout ** levels
    out = signals.withColumns({
        "_floor": floor_, "_ceiling": ceiling,
        "_own": F.when(F.col("bar_no") < reach, F.col("bar_no")).otherwise(
            F.raise_error(F.lit("series longer than fanout**levels; raise levels"))),
    })

    def own_block(level: int) -> Column:
        return F.floor(F.col("_own") / fanout ** level)

    # Up: the rest of the own block of each level, while nothing was found.
    out = search(out, 0, own_block(1), F.col("_own"), "_up0", F.lit(True))
    for level in range(1, levels):
        open_ = F.lit(True)
        for lower in range(level):
            open_ = open_ & F.col(f"_up{lower}").isNull()
        out = search(out, level, own_block(level + 1), own_block(level), f"_up{level}", open_)
    # Down: from the block found to its first hitting part.
    out = out.withColumn("_at", F.col(f"_up{levels - 1}"))
    for level in range(levels - 2, -1, -1):
        out = search(out, level, F.col("_at"), F.lit(-1), f"_down{level}", F.col("_at").isNotNull())
        out = out.withColumn("_at", F.coalesce(f"_down{level}", f"_up{level}"))
    hit = F.col("_at")
    long = F.col("sl") < F.col("tp")
    stopped = F.when(long, hit["low"] <= F.col("sl")).otherwise(hit["high"] >= F.col("sl"))
    helpers = ["_floor", "_ceiling", "_own", "_at",
               *(f"_up{i}" for i in range(levels)), *(f"_down{i}" for i in range(levels - 1))]
    return (
        out.withColumns({
            "exit_no": hit["no"],
            "exit_ts": hit["ts_utc"],
            "exit_reason": F.when(hit.isNull(), "open").when(stopped, "sl").otherwise("tp"),
        })
        .withColumn("exit_price", F.when(F.col("exit_reason") == "sl", F.col("sl"))
                    .when(F.col("exit_reason") == "tp", F.col("tp")))
        .drop(*helpers)
    )


def next_opposite(signals: DataFrame) -> DataFrame:
    """Earliest later signal of the other side: ``opp_no, opp_ts, opp_close``.

    Ordered inside (symbol, day); later days come from one row per day. ``signals``
    are read twice and should be stored.
    """
    columns = {"no": "bar_no", "ts": "ts_utc", "close": "close"}
    value = F.struct(*(F.col(c).alias(k) for k, c in columns.items()))
    df = signals.withColumn("_day", F.to_date("ts_utc"))
    sides = ("BUY", "SELL")
    days = df.groupBy("symbol", "_day").agg(*(
        F.min(F.when(F.col("signal") == s, value)).alias(f"_first_{s}") for s in sides))
    later_days = (Window.partitionBy("symbol").orderBy(F.desc("_day"))
                  .rowsBetween(Window.unboundedPreceding, -1))
    heads = days.select("symbol", "_day", *(
        F.last(f"_first_{s}", True).over(later_days).alias(f"_next_{s}") for s in sides))
    later = (Window.partitionBy("symbol", "_day").orderBy(F.desc("ts_utc"))
             .rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumns({
        f"_in_{s}": F.last(F.when(F.col("signal") == s, value), True).over(later) for s in sides
    }).join(heads, ["symbol", "_day"])
    pick = F.when(F.col("signal") == "BUY", F.coalesce("_in_SELL", "_next_SELL")).otherwise(
        F.coalesce("_in_BUY", "_next_BUY"))
    return (
        out.withColumn("_opp", pick)
        .withColumns({f"opp_{k}": F.col("_opp")[k] for k in columns})
        .drop("_day", "_opp", *(f"_in_{s}" for s in sides), *(f"_next_{s}" for s in sides))
    )


def close_on_opposite(trades: DataFrame) -> DataFrame:
    """Let an opposite signal end a trade that neither stop nor target ended by that bar."""
    earlier = F.col("opp_no").isNotNull() & (
        F.col("exit_no").isNull() | (F.col("opp_no") < F.col("exit_no")))
    def pick(opposite, old):
        return F.when(earlier, opposite).otherwise(F.col(old))
    return trades.withColumns({
        "exit_reason": pick(F.lit("opposite"), "exit_reason"),
        "exit_price": pick(F.col("opp_close"), "exit_price"),
        "exit_ts": pick(F.col("opp_ts"), "exit_ts"),
        "exit_no": pick(F.col("opp_no"), "exit_no"),
    })


def _flat_kernel(rows, state):
    busy_until = state[0]
    kept = []
    for entry, leave in zip(rows["bar_no"].tolist(), rows["_leave"].tolist()):
        take = entry >= busy_until
        if take:
            busy_until = leave
        kept.append(take)
    return {"kept": kept}, [busy_until]


def one_position(trades: DataFrame, keys: tuple[str, ...] = ("symbol",),
                 block_rows: int = CHAIN_ROWS) -> DataFrame:
    """Flag ``kept``: entries made while flat, i.e. on or after the last kept trade's exit bar.

    A trade still open blocks everything after it. ``trades`` should be stored.
    """
    never = F.lit(float("inf"))
    leave = F.coalesce(F.col("exit_no").cast("double"), never)
    out = run_chained(trades.withColumn("_leave", leave), _flat_kernel, [0.0], "kept boolean",
                      keys=keys, inputs=("_leave",), block_rows=block_rows,
                      hands_on=lambda state, last: state[0] > last)
    return out.drop("_leave")


def add_profit(trades: DataFrame, commission_pct: float = 0.01) -> DataFrame:
    """Points after commission on both sides, net return per unit of stake, bars held; NULL while open."""
    sign = F.when(F.col("signal") == "BUY", 1.0).otherwise(-1.0)
    points = sign * (F.col("exit_price") - F.col("entry"))
    fee = (F.col("entry") + F.col("exit_price")) * (commission_pct / 100)
    return trades.withColumns({
        "profit": points - fee,
        "net_return": ratio(points - fee, F.col("entry")),
        "bars_held": F.col("exit_no") - F.col("bar_no"),
    })


def _by_side(trades: DataFrame, keys: tuple[str, ...]):
    closed = trades.where(F.col("profit").isNotNull()).withColumn(
        "side", F.when(F.col("signal") == "BUY", "LONG").otherwise("SHORT"))
    sets = [[*keys, "side"], list(keys)]
    return closed.groupingSets([[F.col(c) for c in s] for s in sets], *keys, "side")


def _side_label() -> Column:
    return F.when(F.grouping("side") == 1, "TOTAL").otherwise(F.col("side"))


def performance(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Closed trades by side and in total, in one pass.

    Average profit divides by wins and is NULL without any; a factor is 999 when
    there is profit and no loss.
    """
    profit = F.col("profit")
    won = profit > 0
    zero = F.lit(0.0)
    out = _by_side(trades, keys).agg(
        _side_label().alias("side_label"),
        F.count(F.lit(1)).alias("trades"),
        F.count_if(won).alias("wins"),
        F.coalesce(F.sum(F.when(won, profit)), zero).alias("gross_profit"),
        F.coalesce(F.sum(F.when(~won, -profit)), zero).alias("gross_loss"),
    ).drop("side").withColumnRenamed("side_label", "side")
    gp, gl = F.col("gross_profit"), F.col("gross_loss")
    losses = F.col("trades") - F.col("wins")

    def factor(up: Column, down: Column) -> Column:
        return F.when(down > 0, ratio(up, down)).when(up > 0, 999.0).otherwise(0.0)

    return out.withColumns({
        "losses": losses,
        "win_rate": ratio(F.col("wins").cast("double"), F.col("trades").cast("double")) * 100,
        "net_profit": gp - gl,
        "profit_factor": factor(gp, gl),
        "avg_profit": ratio(gp, F.col("wins").cast("double")),
        "avg_loss": F.coalesce(ratio(gl, losses.cast("double")), zero),
    }).withColumn("avg_factor", factor(F.coalesce("avg_profit", zero), F.col("avg_loss")))


def durations(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Mean bars held over all, winning and losing trades, by side and in total."""
    held, won = F.col("bars_held"), F.col("profit") > 0

    def mean(condition: Column | None) -> Column:
        return F.coalesce(F.avg(held if condition is None else F.when(condition, held)), F.lit(0.0))

    return _by_side(trades, keys).agg(
        _side_label().alias("side_label"),
        mean(None).alias("avg_bars"),
        mean(won).alias("avg_win_bars"),
        mean(~won).alias("avg_loss_bars"),
    ).drop("side").withColumnRenamed("side_label", "side")


def opposite_share(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Trades closed by an opposite signal, by side and in total."""
    hit = F.count_if(F.col("exit_reason") == "opposite")
    return _by_side(trades, keys).agg(
        _side_label().alias("side_label"),
        hit.alias("opposite_closes"),
        (ratio(hit.cast("double"), F.count(F.lit(1)).cast("double")) * 100).alias("opposite_pct"),
    ).drop("side").withColumnRenamed("side_label", "side")


def equity_curve(trades: DataFrame, capital: float = 30_000.0, stake_pct: float = 5.0) -> DataFrame:
    """Equity, running peak and drawdown after every closed trade, by exit order.

    Each trade stakes a share of the equity, so equity is a running product. A
    loss of all equity or more leaves zero for good. Running values are formed
    inside a day and joined to one row per earlier day.
    """
    factor = 1 + F.col("net_return") * (stake_pct / 100)
    growth = F.when(factor > 0, F.ln(factor)).otherwise(RUIN)
    closed = trades.where(F.col("net_return").isNotNull()).withColumns({
        "_g": growth, "_day": F.to_date("exit_ts")})
    order = [F.col("exit_no"), F.col("bar_no")]
    total = _running(closed, "_g", F.sum, 0.0, order)
    curve = total.withColumn("equity", F.lit(capital) * F.exp("_g_run"))
    peaked = _running(curve, "equity", F.max, capital, order)
    peak = F.greatest(F.col("equity_run"), F.lit(capital))
    return peaked.withColumns({"peak": peak, "drawdown": peak - F.col("equity")}).drop(
        "_g", "_g_run", "_day", "equity_run")


def _running(df: DataFrame, column: str, how, empty: float, order: list[Column]) -> DataFrame:
    """Running aggregate over (symbol, order) as in-day part joined with earlier days' total."""
    days = df.groupBy("symbol", "_day").agg(how(column).alias("_d"))
    earlier = (Window.partitionBy("symbol").orderBy("_day")
               .rowsBetween(Window.unboundedPreceding, -1))
    heads = days.select("symbol", "_day",
                        F.coalesce(how("_d").over(earlier), F.lit(empty)).alias("_before"))
    so_far = (Window.partitionBy("symbol", "_day").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    inside = how(column).over(so_far)
    out = df.withColumn("_in", inside).join(heads, ["symbol", "_day"])
    joined = F.col("_in") + F.col("_before") if how is F.sum else F.greatest("_in", "_before")
    return out.withColumn(f"{column}_run", joined).drop("_in", "_before")


def equity_summary(curve: DataFrame, capital: float = 30_000.0) -> DataFrame:
    final = F.max_by("equity", F.struct("exit_no", "bar_no"))
    return curve.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("closed_trades"),
        final.alias("equity"),
        (final - capital).alias("net_profit"),
        ((final - capital) / capital * 100).alias("total_return_pct"),
        F.max("drawdown").alias("max_drawdown"),
        (F.max("drawdown") / capital * 100).alias("max_drawdown_pct"),
    )
