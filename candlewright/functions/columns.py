"""Small Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def minute_of_day(ts: Column | str) -> Column:
    ts = as_col(ts)
    return F.hour(ts) * 60 + F.minute(ts)


def day_start(ts: Column | str) -> Column:
    """Midnight of the timestamp's own day, free of the session time zone."""
    return F.to_date(as_col(ts)).cast("timestamp_ntz")


def bucket_start(ts: Column | str, seconds: int) -> Column:
    """Left edge of the time bucket, laid out from midnight of each day."""
    if seconds <= 0 or DAY_SECONDS % seconds:
        raise ValueError(f"bucket width must divide 24 hours, got {seconds} s")
    ts = as_col(ts)
    if seconds == DAY_SECONDS:
        return day_start(ts)
    second = (minute_of_day(ts) * 60 + F.second(ts)).cast("int")
    edge = (second - second % seconds).cast("decimal(18,6)")
    zero = F.lit(0)
    return day_start(ts) + F.make_dt_interval(zero, zero, zero, edge)


def calendar_start(ts: Column | str, unit: str) -> Column:
    """Start of the day, ISO week or month the timestamp lies in."""
    if unit not in ("day", "week", "month"):
        raise ValueError(f"unknown calendar unit {unit!r}")
    if unit == "day":
        return day_start(ts)
    return F.trunc(F.to_date(as_col(ts)), unit).cast("timestamp_ntz")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds as a double, microseconds kept."""
    return F.timestamp_diff("MICROSECOND", as_col(start), as_col(end)) / F.lit(1e6)


def ratio(num: Column, den: Column) -> Column:
    """Division giving NULL for a zero divisor."""
    return F.try_divide(num, den)


def percent(part: Column, whole: Column, places: int | None = None) -> Column:
    """100 * part / whole, 0 for an empty whole."""
    value = F.coalesce(ratio(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0))
    return value if places is None else F.bround(value, places)


def all_gates(gates: list[Column]) -> Column:
    """Conjunction in which an undecided (NULL) gate blocks and no gate at all passes."""
    return reduce(and_, (F.coalesce(g, F.lit(False)) for g in gates), F.lit(True))


def local_time(ts_utc: Column | str, zone: str) -> Column:
    """UTC wall clock to the wall clock of ``zone``, summer time included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), as_col(ts_utc))
