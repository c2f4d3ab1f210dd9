"""Smoothed studies carried on: new bars start from a stored carry instead of the history.

A carry is one row per symbol: its last bar and its number, and for each smoothed series the last
value and how many bars ago its last input was. That is all the recurrence needs, so the result of
history and new bars together is that of one run over both, and no old bar is read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.functions.columns import as_col
from candlewright.operators.blocks import index_bars
from candlewright.operators.smoothing import Smooth, smooth
from candlewright.operators.studies import Study, study_gates
from candlewright.session import stage

_LAST = ["ts_utc", "high", "low", "close"]


class Resumed(NamedTuple):
    """The new bars with study columns and gates, and the carry behind them."""

    bars: DataFrame
    carry: DataFrame


def _checked(studies: tuple[Study, ...]) -> list[Mapping[str, Smooth]]:
    first = {k: v for s in studies for k, v in s.smooth.items()}
    second = {k: v for s in studies for k, v in s.nested.items()}
    for s in studies:
        if s.lookback or s.daily:
            raise ValueError(f"{s.name} looks back at bars, which a carry does not hold")
    for name, spec in {**first, **second}.items():
        if spec.seed != "first":
            raise ValueError(f"{name} starts from a mean, of which a carry has no part")
    return [first, second]


def carry_of(done: DataFrame, *studies: Study, before: DataFrame | None = None) -> DataFrame:
    """The carry behind bars that have the studies' columns; ``before`` is the one they started from.

    Symbols without new bars keep theirs.
    """
    specs = {k: v for level in _checked(studies) for k, v in level.items()}
    seen = {name: F.max(F.when(as_col(s.x).isNotNull() & (F.col("bar_no") >= s.start), F.col("bar_no"))) for name, s in specs.items()}
    new = done.groupBy("symbol").agg(
        F.max("bar_no").alias("last_no"), *(F.max_by(c, "bar_no").alias(f"last_{c}") for c in _LAST),
        *(F.max_by(name, "bar_no").alias(f"y_{name}") for name in specs), *(c.alias(f"_seen_{name}") for name, c in seen.items()))
    if before is None:
        return new.withColumns({f"missed_{n}": F.col("last_no") - F.col(f"_seen_{n}") for n in specs}).drop(*(f"_seen_{n}" for n in specs))
    old = before.select("symbol", *(F.col(c).alias(f"_old_{c}") for c in before.columns if c != "symbol"))
    both = new.join(old, "symbol", "full")
    fresh = F.col("last_no").isNotNull()
    missed = {f"missed_{n}": F.when(fresh, F.coalesce(
        F.col("last_no") - F.col(f"_seen_{n}"), F.col("last_no") - F.col("_old_last_no") + F.col(f"_old_missed_{n}"))).otherwise(
        F.col(f"_old_missed_{n}")) for n in specs}
    kept = {c: F.when(fresh, F.col(c)).otherwise(F.col(f"_old_{c}")) for c in new.columns if c != "symbol" and not c.startswith("_")}
    return both.select("symbol", *(c.alias(k) for k, c in {**kept, **missed}.items()))


def _carried_on(df: DataFrame, specs: Mapping[str, Smooth]) -> DataFrame:
    """Smooth rows numbered from the carry on; a series' first new input is blended with what was carried."""
    inputs = {f"_x_{n}": F.when(F.col("bar_no") >= s.start, as_col(s.x).cast("double")) for n, s in specs.items()}
    df = df.withColumns(inputs)
    firsts = df.groupBy("symbol").agg(*(F.min(F.when(F.col(f"_x_{n}").isNotNull(), F.col("bar_no"))).alias(f"_first_{n}") for n in specs))
    df = df.join(firsts, "symbol")
    local = {}
    for name, s in specs.items():
        y, x, no = F.col(f"y_{name}"), F.col(f"_x_{name}"), F.col("bar_no")
        # bars since the last input, this one included
        left = F.pow(F.lit(s.q), (no - F.col("last_no") + F.col(f"missed_{name}")).cast("double"))
        blended = (left * y + s.alpha * x) / (left + s.alpha)
        local[f"_x_{name}"] = F.when((no == F.col(f"_first_{name}")) & y.isNotNull(), blended).otherwise(x)
    df = df.withColumns(local).withColumns({"_no": F.col("bar_no"), "bar_no": F.col("bar_no") - F.coalesce(F.col("last_no") + 1, F.lit(0))})
    out = smooth(df, {n: replace(s, x=f"_x_{n}", start=0) for n, s in specs.items()})
    return out.withColumns({n: F.coalesce(n, f"y_{n}") for n in specs}).withColumn("bar_no", F.col("_no")).drop(
        "_no", *(f"_x_{n}" for n in specs), *(f"_first_{n}" for n in specs))


def resume_studies(new_bars: DataFrame, carry: DataFrame, *studies: Study, gates: bool = True) -> Resumed:
    """Study columns of bars that follow those of ``carry``; symbols that it doesn't have start with them.

    Studies are smoothed ones from their first value on (average range, relative strength, exponential
    means and what is smoothed from them). ``carry`` should be a stored table. A new bar must be
    later than its symbol's last one; an earlier one is refused.
    """
    levels = _checked(studies)
    numbered = index_bars(stage(new_bars, "new-bars"))
    df = numbered.join(carry, "symbol", "left")
    early = F.when(F.col("ts_utc") <= F.col("last_ts_utc"), F.raise_error(F.lit("a bar is not later than the carry's last one")))
    first = F.col("bar_no") == 0
    prev: dict[str, Column] = {f"prev_{c}": F.when(first, F.col(f"last_{c}")).otherwise(F.col(f"prev_{c}")) for c in _LAST}
    df = df.withColumn("symbol", F.coalesce(early, F.col("symbol"))).withColumns(
        {**prev, "bar_no": F.col("bar_no") + F.coalesce(F.col("last_no") + 1, F.lit(0))})
    df = stage(df, "carried")
    for specs in levels:
        if specs:
            df = stage(_carried_on(df, specs), "resumed")
    for i in range(max((len(s.steps) for s in studies), default=0)):
        df = df.withColumns({k: v for s in studies if i < len(s.steps) for k, v in s.steps[i].items()})
    new = df.drop(*(c for c in carry.columns if c != "symbol"))
    return Resumed(study_gates(new, studies) if gates else new, carry_of(new, *studies, before=carry))
