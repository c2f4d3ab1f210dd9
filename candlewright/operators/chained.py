"""Order-dependent state machines, run block by block.

Some rules (ratcheting bands, zig-zag legs, one position at a time) have no
window form. A series is cut into blocks of bounded size, every block runs from
an assumed starting state, and blocks whose predecessor ended in another state
run again until all agree. Such rules forget their past, so one repeat is the
usual cost; the result is exact in any case, as the first block always is.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewright.session import stage

CHAIN_ROWS = 65_536

#: (rows in order, state) -> (columns to add, state after the last row)
Kernel = Callable[[pd.DataFrame, list[float]], tuple[dict[str, list], list[float]]]

#: (state, number of the block's last row) -> whether the block only hands the state on
HandsOn = Callable[[list[float], int], bool]


def run_chained(
    df: DataFrame,
    kernel: Kernel,
    initial: list[float],
    added: str,
    keys: tuple[str, ...] = ("symbol",),
    order: str = "bar_no",
    inputs: tuple[str, ...] = (),
    block_rows: int = CHAIN_ROWS,
    hands_on: HandsOn | None = None,
) -> DataFrame:
    """Add the kernel's columns (DDL ``added``) to ``df``, which should be a stored table.

    ``order`` must be a unique non-negative number per key group, so a block
    holds ``block_rows`` rows at most. Only ``inputs`` travel to the states pass.
    ``hands_on`` spares runs of blocks a long-lived state passes through unchanged.
    """
    keys = tuple(keys)
    group = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", F.floor(F.col(order) / block_rows))
    starts = (
        rows.groupBy(*group).agg(F.max(order).cast("long").alias("_last"))
        .withColumn("_state", F.array(*(F.lit(float(x)) for x in initial)))
    )
    if rows.agg(F.max("_chunk")).first()[0]:
        starts = _settle(rows.select(*group, order, *inputs), starts, kernel, group, keys, order, hands_on)

    fields = T.StructType.fromDDL(added)
    out_schema = T.StructType([*df.schema.fields, *fields.fields])
    names = [f.name for f in out_schema.fields]

    def emit(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        columns, _ = kernel(pdf, list(state["_state"].iloc[0]))
        return pdf.assign(**columns)[names]

    return _per_chunk(rows, starts, group, emit, out_schema)


def _per_chunk(rows: DataFrame, starts: DataFrame, group: list[str], fn, schema) -> DataFrame:
    return rows.groupBy(*group).cogroup(starts.groupBy(*group)).applyInPandas(fn, schema)


def _settle(rows, starts, kernel, group, keys, order, hands_on) -> DataFrame:
    """Starting state of every block, repeated until each equals its predecessor's end."""
    key_fields = [f for f in rows.schema.fields if f.name in group]
    doubles = T.ArrayType(T.DoubleType())
    end_schema = T.StructType([*key_fields, T.StructField("_end", doubles)])
    walk_schema = T.StructType([
        *key_fields, T.StructField("_last", T.LongType()), T.StructField("_state", doubles),
        T.StructField("_end", doubles), T.StructField("_rerun", T.BooleanType())])

    def finish(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        _, end = kernel(pdf.sort_values(order, ignore_index=True), list(state["_state"].iloc[0]))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in group}, "_end": [[float(x) for x in end]]})

    def walk(blocks: pd.DataFrame) -> pd.DataFrame:
        """Along one series' block summaries: which start differs from the one assumed."""
        blocks = blocks.sort_values("_chunk", ignore_index=True)
        states, ends, rerun, before = [], [], [], None
        for assumed, end, last in zip(blocks["_state"], blocks["_end"], blocks["_last"]):
            assumed, end = list(assumed), list(end)
            start = assumed if before is None else before
            # NaN is as good as any other state
            differs = any(a != b and (a == a or b == b) for a, b in zip(start, assumed))
            if differs and hands_on is not None and hands_on(start, last):
                end, differs = start, False
            states.append(start)
            ends.append(end)
            rerun.append(differs)
            before = end
        return blocks.assign(_state=states, _end=ends, _rerun=rerun)[walk_schema.fieldNames()]

    ends = _per_chunk(rows, starts, group, finish, end_schema)
    known = stage(starts.join(ends, group), "blocks")
    while True:
        walked = stage(known.groupBy(*keys).applyInPandas(walk, walk_schema), "walked")
        again = walked.where("_rerun").select(*group, "_last", "_state")
        if again.isEmpty():
            return walked.select(*group, "_state")
        redone = _per_chunk(rows.join(again.select(*group), group, "left_semi"), again, group, finish, end_schema)
        known = stage(
            walked.where("NOT _rerun").drop("_rerun").unionByName(again.join(redone, group)), "blocks")
