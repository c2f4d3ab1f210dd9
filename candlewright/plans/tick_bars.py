"""Tick files to a stored, numbered bar table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlewright.operators.bars import ticks_to_bars
from candlewright.operators.blocks import index_bars
from candlewright.session import stage


def indexed_bars(ticks: DataFrame, seconds: int, zone: str = "UTC") -> DataFrame:
    """Bars built once from ticks, stored, numbered and stored again.

    Bars are a small fraction of the ticks, and every indicator starts from them,
    so ticks are read and shuffled a single time.
    """
    bars = stage(ticks_to_bars(ticks, seconds, zone), "bars")
    return stage(index_bars(bars), "indexed")
