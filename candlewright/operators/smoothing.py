"""Exponential and Wilder smoothing as an exact distributed scan.

``y[t] = q*y[t-1] + w[t]`` unrolls to ``y[t] = sum(q**(t-i) * w[i])``. With blocks
of equal length B the sum splits into the rows of the own block (a running sum)
and a carry, itself a sum over earlier blocks' totals weighted by powers of
``q**B``. Totals are a plain aggregate; each is sent to just the later blocks
where its weight has not yet underflowed to zero, so no task sees a whole symbol.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.columns import as_col
from candlewright.operators.gaps import BLOCK, has_gaps, smooth_with_gaps

BLOCK_ROWS = 512
_REACH = 64               # blocks a carry should travel at most, where the length allows
_GROWTH_LIMIT = 600.0     # natural log; q**-B must stay a finite double
_UNDERFLOW = 745.2        # exp(-745.2) is 0.0 in double precision


@dataclass(frozen=True)
class Smooth:
    """One smoothed column: input, length, kind and how the series starts.

    ``seed='first'`` starts from the first value, ``'sma'`` from the mean of the
    first ``n`` values (NULL until then). ``start`` is the first row number at
    which the input exists.
    """

    x: Column | str
    n: int
    kind: str = "wilder"
    seed: str = "first"
    start: int = 0

    @property
    def alpha(self) -> float:
        if self.kind not in ("wilder", "ema"):
            raise ValueError(f"unknown smoothing {self.kind!r}")
        return 1.0 / self.n if self.kind == "wilder" else 2.0 / (self.n + 1)

    @property
    def q(self) -> float:
        return 1.0 - self.alpha

    def first_row(self) -> int:
        return self.start + (self.n - 1 if self.seed == "sma" else 0)

    def weight(self) -> Column:
        """w[t] of the unrolled sum, from the row alone."""
        x, no = as_col(self.x), F.col("bar_no")
        if self.seed == "first":
            seeded = F.when(no == self.start, x)
        elif self.seed == "sma":
            end = self.start + self.n
            seeded = F.when(no < end, x / self.n * F.pow(F.lit(self.q), (no - (end - 1)).cast("double")))
        else:
            raise ValueError(f"unknown seed {self.seed!r}")
        out = seeded.otherwise(x * self.alpha)
        return F.when(no < self.start, 0.0).otherwise(out) if self.start else out


def _block_rows(specs: list[Smooth], wanted: int | None) -> int:
    decay = [-math.log(s.q) for s in specs]
    limit = int(_GROWTH_LIMIT / max(decay))
    if wanted is None:
        wanted = max(BLOCK_ROWS, math.ceil(_UNDERFLOW / (_REACH * min(decay))))
    return max(2, min(wanted, limit))


def smooth(df: DataFrame, specs: dict[str, Smooth], block_rows: int | None = None,
           gaps: bool | None = None) -> DataFrame:
    """Add one smoothed column per entry of ``specs``; all share one scan.

    A NULL input carries the value on, as in pandas; such series take a path of their
    own. ``gaps`` says whether there are any; if it is not given, the inputs are looked at.
    """
    if has_gaps(df, specs) if gaps is None else gaps:
        return smooth_with_gaps(df, specs, block_rows or BLOCK)
    plain = {name: as_col(s.x) for name, s in specs.items() if s.q == 0.0}
    specs = {name: s for name, s in specs.items() if s.q != 0.0}
    if plain:
        df = df.withColumns(plain)
    if not specs:
        return df

    rows = _block_rows(list(specs.values()), block_rows)
    pos = (F.col("bar_no") % rows).cast("double")
    blk = F.floor(F.col("bar_no") / rows)
    reach = max(math.ceil(_UNDERFLOW / (rows * -math.log(s.q))) for s in specs.values())

    totals = df.groupBy("symbol", blk.alias("_sblk")).agg(*(
        F.sum(s.weight() * F.pow(F.lit(s.q), rows - 1 - pos)).alias(f"_c_{name}")
        for name, s in specs.items()
    ))
    ahead = F.explode(F.sequence(F.lit(1), F.lit(reach)))
    carries = (
        totals.withColumn("_k", ahead)
        .groupBy("symbol", (F.col("_sblk") + F.col("_k")).alias("_sblk"))
        .agg(*(
            F.sum(F.col(f"_c_{name}") * F.pow(F.lit(s.q ** rows), (F.col("_k") - 1).cast("double")))
            .alias(f"_c_{name}")
            for name, s in specs.items()
        ))
    )

    so_far = (
        Window.partitionBy("symbol", "_sblk").orderBy("bar_no")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = df.withColumn("_sblk", blk).withColumns({
        f"_l_{name}": F.sum(s.weight() * F.pow(F.lit(s.q), -pos)).over(so_far)
        for name, s in specs.items()
    })
    out = local.join(carries, ["symbol", "_sblk"], "left")
    for name, s in specs.items():
        y = (F.pow(F.lit(s.q), pos) * F.col(f"_l_{name}")
             + F.pow(F.lit(s.q), pos + 1) * F.coalesce(F.col(f"_c_{name}"), F.lit(0.0)))
        if s.first_row():
            y = F.when(F.col("bar_no") >= s.first_row(), y)
        out = out.withColumn(name, y)
    return out.drop("_sblk", *(f"_l_{n}" for n in specs), *(f"_c_{n}" for n in specs))
