"""Exact quantiles without gathering a group's values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_quantiles(values: DataFrame, keys: list[str], probs: list[float], column: str = "value",
                    accuracy: int = ACCURACY) -> DataFrame:
    """Linearly interpolated quantiles, one row per key group and probability.

    A mergeable sketch brackets each quantile; its error bound makes the bracket
    certain to hold the wanted ranks, or to end next to them where a group is so
    small that the sketch is exact. Values outside the bracket are only counted,
    with the nearest one on either side; those inside are collapsed to distinct
    values and ranked.
    """
    margin = 2.0 / accuracy
    edges = [max(p - margin, 0.0) for p in probs] + [min(p + margin, 1.0) for p in probs]
    stats = values.where(F.col(column).isNotNull()).groupBy(*keys).agg(
        F.count(column).alias("_n"), F.percentile_approx(column, edges, accuracy).alias("_edges"))
    brackets = stats.select(*keys, "_n", F.inline(F.array(*(
        F.struct(
            F.lit(float(p)).alias("prob"),
            F.col("_edges")[i].alias("_lo"),
            F.col("_edges")[i + len(probs)].alias("_hi"),
        ) for i, p in enumerate(probs)))))
    wide = brackets.groupBy(*keys).agg(
        F.first("_n").alias("_n"),
        F.collect_list(F.struct("prob", "_lo", "_hi")).alias("_brackets"))

    x = F.col(column)
    near = (
        values.where(x.isNotNull()).join(wide, keys)
        .select(*keys, column, "_n", F.explode("_brackets").alias("_b"))
        .select(*keys, "_n", F.col("_b.prob").alias("prob"), column,
                F.when(x < F.col("_b._lo"), -1).when(x > F.col("_b._hi"), 1).otherwise(0).alias("_side"))
        .groupBy(*keys, "prob", "_side", F.when(F.col("_side") == 0, x).alias("_inside"))
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"),
             F.when(F.col("_side") < 0, F.max(column)).otherwise(F.min(column)).alias("_v"))
    )
    upto = (Window.partitionBy(*keys, "prob").orderBy("_side", "_v")
            .rowsBetween(Window.unboundedPreceding, 0))
    position = (F.col("_n") - 1) * F.col("prob")
    ranked = near.withColumns({"_end": F.sum("_c").over(upto), "_pos": position})

    def at(rank):
        """Value holding the 0-based rank."""
        return F.min(F.when(F.col("_end") > rank, F.col("_v")))

    low = F.floor("_pos")
    return (
        ranked.groupBy(*keys, "prob")
        .agg(at(low).alias("_a"), at(F.ceil("_pos")).alias("_b"), F.first("_pos").alias("_pos"))
        .select(*keys, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos")))
                .alias("quantile"))
    )
