"""Distributed row order for bar series.

A window partitioned by symbol alone would put a whole instrument into one task.
Here a series is numbered first (``bar_no``) and then cut into blocks of equal
length; each block carries copies of the rows its frames look back to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
_CARRIED = ["ts_utc", "high", "low", "close"]
_ADDED = ["bar_no", "bar_date", *(f"prev_{c}" for c in _CARRIED)]


def in_block() -> WindowSpec:
    """Row order inside a block; valid between :func:`with_halo` and :func:`home_rows`."""
    return Window.partitionBy("symbol", "_blk").orderBy("bar_no")


def index_bars(bars: DataFrame) -> DataFrame:
    """Add ``bar_no`` (0-based per symbol) and the previous bar's values.

    Rows are ordered inside (symbol, UTC day), which holds at most one bar per
    bar width. Across days only day totals are ordered: one row per traded day.
    Feed it a stored table, since it reads ``bars`` for the totals and the rows.
    """
    keyed = bars.drop(*_ADDED).withColumn("bar_date", F.to_date("ts_utc"))
    days = keyed.groupBy("symbol", "bar_date").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.max_by(c, "ts_utc").alias(f"last_{c}") for c in _CARRIED),
    )
    calendar = Window.partitionBy("symbol").orderBy("bar_date")
    before = calendar.rowsBetween(Window.unboundedPreceding, -1)
    heads = days.select(
        "symbol", "bar_date",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first_no"),
        *(F.lag(f"last_{c}").over(calendar).alias(f"_day_{c}") for c in _CARRIED),
    )
    in_day = Window.partitionBy("symbol", "bar_date").orderBy("ts_utc")
    numbered = keyed.withColumns({
        "_rn": F.row_number().over(in_day),
        **{f"prev_{c}": F.lag(c).over(in_day) for c in _CARRIED},
    })
    return (
        numbered.join(heads, ["symbol", "bar_date"])
        .withColumns({
            "bar_no": F.col("_first_no") + F.col("_rn") - 1,
            **{
                f"prev_{c}": F.when(F.col("_rn") == 1, F.col(f"_day_{c}")).otherwise(F.col(f"prev_{c}"))
                for c in _CARRIED
            },
        })
        .drop("_rn", "_first_no", *(f"_day_{c}" for c in _CARRIED))
    )


def block_of(rows: int, shift: int = 0) -> Column:
    return F.floor((F.col("bar_no") + shift) / rows)


def with_halo(df: DataFrame, lookback: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Put every row into its own block and into later blocks that look back to it."""
    home = block_of(block_rows)
    blocks = F.sequence(home, block_of(block_rows, lookback))
    return df.withColumns({"_home_blk": home, "_blk": F.explode(blocks)})


def home_rows(df: DataFrame) -> DataFrame:
    """Drop the copies made by :func:`with_halo`."""
    return df.where(F.col("_blk") == F.col("_home_blk")).drop("_blk", "_home_blk")


def over_blocks(
    df: DataFrame,
    lookback: int,
    steps: Sequence[dict[str, Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Evaluate window columns built on :func:`in_block` in one shuffle.

    ``steps`` run in order, so a later one may use columns of an earlier one;
    ``lookback`` is the total number of earlier rows a result depends on.
    """
    out = with_halo(df, lookback, block_rows)
    for step in steps:
        out = out.withColumns(step)
    return home_rows(out)


def frame(rows: int) -> WindowSpec:
    """The last ``rows`` rows, the current one included."""
    return in_block().rowsBetween(1 - rows, 0)


def lag(x: Column | str, rows: int = 1) -> Column:
    return F.lag(x, rows).over(in_block())


def full(x: Column, value: Column, rows: int) -> Column:
    """``value`` once ``rows`` non-NULL inputs are in the frame, NULL before."""
    return F.when(F.count(x).over(frame(rows)) == rows, value)
