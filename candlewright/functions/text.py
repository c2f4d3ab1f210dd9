"""Text columns: alerts and risk comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlewright.functions.columns import as_col, ratio


def reward_ratio(entry: Column, sl: Column, tp: Column) -> Column:
    """Reward over risk, 0 when there is no risk distance."""
    return F.coalesce(ratio(F.abs(tp - entry), F.abs(entry - sl)), F.lit(0.0))


def plain_number(x: Column, places: int) -> Column:
    """Rounded number without trailing zeros, as chart alerts print it."""
    fixed = F.format_string(f"%.{places}f", F.bround(x, places))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def alert_text(symbol="symbol", ts="ts", signal="signal", entry="entry", sl="sl", tp="tp") -> Column:
    entry, sl, tp = as_col(entry), as_col(sl), as_col(tp)
    head = F.when(as_col(signal) == "BUY", "\U0001F7E2 BUY").otherwise("\U0001F534 SELL")
    return F.concat(
        head, F.lit(" SIGNAL\nSymbol: "), as_col(symbol),
        F.lit("\nEntry Price: "), plain_number(entry, 5),
        F.lit("\nStop Loss: "), plain_number(sl, 5),
        F.lit("\nTake Profit: "), plain_number(tp, 5),
        F.lit("\nRR Ratio: 1:"), plain_number(reward_ratio(entry, sl, tp), 2),
        F.lit("\nTime: "), F.date_format(as_col(ts), "dd/MM/yyyy HH:mm"),
    )


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", x)
