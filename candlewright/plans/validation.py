"""All data checks on one bar table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlewright.operators import quality as q


def validate_bars(indexed: DataFrame, bar_seconds: int, sequence: str = "bar_no", rsi_length: int = 14,
                  start: str | None = None, end: str | None = None) -> DataFrame:
    """Checks table of a stored, indexed bar table, with the schema checks for every symbol."""
    profile = q.bar_profile(indexed, bar_seconds)
    checks = [
        q.missing_values(), q.ohlc_consistency(), q.nonpositive_prices(),
        q.gaps(), q.large_moves(), q.warm_up(rsi_length),
        *(q.fixed_check(row) for row in q.check_schema(indexed)),
    ]
    if start and end:
        checks.append(q.range_coverage(start, end))
    return q.union_checks(
        q.run_checks(profile, *checks), q.duplicate_timestamps(indexed), q.time_order(indexed, sequence))
