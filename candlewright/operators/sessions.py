"""Trading-session predicates on wall-clock time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.functions.columns import as_col, local_time, minute_of_day


@dataclass(frozen=True)
class Session:
    """Daily session, start inclusive, end exclusive, in minutes of the day."""

    start: int = 8 * 60 + 30
    end: int = 20 * 60 + 30
    enabled: bool = True

    @classmethod
    def at(cls, start: str, end: str, enabled: bool = True) -> "Session":
        def minutes(text: str) -> int:
            hour, minute = map(int, text.split(":"))
            return hour * 60 + minute
        return cls(minutes(start), minutes(end), enabled)

    @property
    def start_text(self) -> str:
        return f"{self.start // 60:02d}:{self.start % 60:02d}"

    @property
    def end_text(self) -> str:
        return f"{self.end // 60:02d}:{self.end % 60:02d}"


def in_session(session: Session, ts: Column | str = "ts") -> Column:
    if not session.enabled:
        return F.lit(True)
    if session.start >= session.end:
        raise ValueError(
            f"session start {session.start_text} must be before its end {session.end_text}")
    minute = minute_of_day(ts)
    return (minute >= session.start) & (minute < session.end)


def in_zone_session(session: Session, zone: str, ts_utc: Column | str = "ts_utc") -> Column:
    """Session in a named zone; a start after the end means overnight."""
    if not session.enabled:
        return F.lit(True)
    minute = minute_of_day(local_time(ts_utc, zone))
    after, before = minute >= session.start, minute < session.end
    return (after & before) if session.start <= session.end else (after | before)


def annotate_session(df: DataFrame, session: Session, ts: str = "ts") -> DataFrame:
    return df.withColumns({
        "in_trading_hours": in_session(session, ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "session_start": F.lit(session.start_text),
        "session_end": F.lit(session.end_text),
        "session_type": F.lit("intraday"),
    })


def between(start: str, end: str, ts: Column | str = "ts") -> Column:
    """Inclusive date-range predicate on the wall clock."""
    ts = as_col(ts)
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts <= F.lit(end).cast("timestamp_ntz"))
