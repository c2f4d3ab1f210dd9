"""Smoothing of series with NULLs, as pandas' ``ewm(adjust=False)`` has it.

A NULL carries the value on; after k rows the next input x gives
``(q**k * y + a * x) / (q**k + a)``, where ``a`` is ``1 - q``. Within a block every value is
then linear in the one at the block's first input, so a block is summed up in a few
numbers, the blocks of a symbol are walked in order (one row each, for thousands of
bars), and the blocks run with the value they start from. Exact for any gaps.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewright.functions.columns import as_col
from candlewright.session import stage

BLOCK = 65_536
_SUM = "symbol string, _blk long, _spec int, first_no long, first_x double, last_no long, a double, c double"
_SUM_NAMES = [field.split()[0] for field in _SUM.split(", ")]


def has_gaps(df: DataFrame, specs: dict) -> bool:
    """Whether any input is NULL where it should exist; stops at the first."""
    missing = [as_col(s.x).isNull() & (F.col("bar_no") >= s.start) for s in specs.values()]
    condition = missing[0]
    for other in missing[1:]:
        condition = condition | other
    return not df.where(condition).isEmpty()


def _seeded(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(symbol, _seed_no, _seed): the row of the nth input and the mean of the first n."""
    blocks = rows.groupBy("symbol", "_blk").agg(F.count(column).alias("_m"), F.sum(column).alias("_s"))
    before = Window.partitionBy("symbol").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"_m0": F.coalesce(F.sum("_m").over(before), F.lit(0)),
                                 "_s0": F.coalesce(F.sum("_s").over(before), F.lit(0.0))})
    target = blocks.where((F.col("_m0") < n) & (F.col("_m0") + F.col("_m") >= n)).select("symbol", "_blk", "_m0", "_s0")
    so_far = Window.partitionBy("symbol").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    nth = (rows.join(target, ["symbol", "_blk"]).where(F.col(column).isNotNull())
           .withColumns({"_k": F.count(F.lit(1)).over(so_far) + F.col("_m0"), "_t": F.sum(column).over(so_far) + F.col("_s0")}))
    return nth.where(F.col("_k") == n).select("symbol", F.col("bar_no").alias("_seed_no"), (F.col("_t") / n).alias("_seed"))


def smooth_with_gaps(df: DataFrame, specs: dict, block: int = BLOCK) -> DataFrame:
    """``df`` with one smoothed column for each of ``specs``; inputs may be NULL anywhere."""
    inputs = {f"_x{i}": F.when(F.col("bar_no") >= s.start, as_col(s.x).cast("double")) for i, s in enumerate(specs.values())}
    blk = F.floor(F.col("bar_no") / block)
    rows = stage(df.withColumns(inputs).withColumn("_blk", blk).select("symbol", "_blk", "bar_no", *inputs), "gaps")
    for name, s in zip(inputs, specs.values()):
        if s.seed == "sma":
            no, seed = F.col("bar_no"), F.col("_seed_no")
            rows = rows.join(_seeded(rows, name, s.n), "symbol", "left").withColumn(
                name, F.when(no == seed, F.col("_seed")).when(no > seed, F.col(name))).drop("_seed_no", "_seed")
    q, columns = [s.q for s in specs.values()], list(inputs)

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("bar_no"), []
        for i, name in enumerate(columns):
            had = pdf[pdf[name].notna()]
            if not len(had):
                continue
            numbers, values = had["bar_no"].tolist(), had[name].tolist()
            a, c, last = 1.0, 0.0, numbers[0]
            for no, x in zip(numbers[1:], values[1:]):
                w = q[i] ** (no - last)
                a, c, last = a * w / (w + 1 - q[i]), (w * c + (1 - q[i]) * x) / (w + 1 - q[i]), no
            out.append((pdf["symbol"].iloc[0], pdf["_blk"].iloc[0], i, numbers[0], values[0], last, a, c))
        return pd.DataFrame(out, columns=_SUM_NAMES)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """What each block of a symbol starts from; blocks without an input have no row."""
        pdf, y, last, starts = pdf.sort_values("_blk"), None, 0, []
        share = q[int(pdf["_spec"].iloc[0])]
        for first_no, first_x, last_no, a, c in pdf[["first_no", "first_x", "last_no", "a", "c"]].itertuples(index=False):
            starts.append((y, last))
            if y is not None:
                w = share ** (first_no - last)
                first_x = (w * y + (1 - share) * first_x) / (w + 1 - share)
            y, last = a * first_x + c, int(last_no)
        out = pdf[["symbol", "_spec", "last_no"]].assign(y=[s[0] for s in starts], last=[s[1] for s in starts], blk=pdf["_blk"])
        ends = pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "_spec": [pdf["_spec"].iloc[0]], "blk": [None], "y": [y], "last": [last]})
        return pd.concat([out.drop(columns="last_no"), ends], ignore_index=True)[["symbol", "_spec", "blk", "y", "last"]]

    sums = stage(rows.groupBy("symbol", "_blk").applyInPandas(sum_up, _SUM), "sums")
    known = sums.groupBy("symbol", "_spec").applyInPandas(walk, "symbol string, _spec int, blk long, y double, last long")
    # a block starts from the value of the last one before it that has an input
    all_blocks = rows.select("symbol", "_blk").distinct().crossJoin(
        df.sparkSession.range(len(q)).select(F.col("id").cast("int").alias("_spec")))
    starts = (all_blocks.join(known.withColumnRenamed("blk", "_blk").where("_blk IS NOT NULL"), ["symbol", "_blk", "_spec"], "left")
              .join(known.where("blk IS NULL").select("symbol", "_spec", F.col("y").alias("_y"), F.col("last").alias("_last")),
                    ["symbol", "_spec"], "left"))
    state = F.struct(F.col("y").alias("y"), F.col("last").alias("last"))
    state = F.coalesce(F.first(F.when(F.col("last").isNotNull(), state), True).over(
        Window.partitionBy("symbol", "_spec").orderBy("_blk").rowsBetween(0, Window.unboundedFollowing)),
        F.struct(F.col("_y").alias("y"), F.col("_last").alias("last")))
    starts = starts.withColumn("_s", state).groupBy(F.col("symbol").alias("_of"), F.col("_blk").alias("_at")).agg(
        F.map_from_entries(F.collect_list(F.struct("_spec", "_s"))).alias("_starts"))

    names = list(specs)
    fields = df.select("symbol", "bar_no").schema.fields
    schema = T.StructType([*fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def emit(pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_no", ignore_index=True)
        begin, out = dict(starts["_starts"].iloc[0]), {}
        for i, name in enumerate(columns):
            y, last = begin[i]["y"], begin[i]["last"]
            y, ys = None if y is None or math.isnan(y) else y, []
            for no, x in zip(pdf["bar_no"].tolist(), pdf[name].tolist()):
                if x == x:
                    if y is None:
                        y = x
                    else:
                        w = q[i] ** (no - last)
                        y = (w * y + (1 - q[i]) * x) / (w + 1 - q[i])
                    last = no
                ys.append(y)
            out[names[i]] = pd.Series(ys, dtype="float64")
        return pdf[["symbol", "bar_no"]].assign(**out)

    values = rows.groupBy("symbol", "_blk").cogroup(starts.groupBy("_of", "_at")).applyInPandas(emit, schema)
    return df.join(values, ["symbol", "bar_no"])
