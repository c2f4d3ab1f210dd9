"""Connected components of an edge table.

Each partition first replaces its edges by those of a spanning forest. Then the
two star operations alternate: every node hands its larger neighbours (large
star), then all smaller ones and itself (small star), to its smallest neighbour.
Both are a partial aggregate and a join, so a node with a third of all edges is
combined before the shuffle and split in the join. Every round is written, and
the loop ends when a round changes nothing, after a number of rounds that grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.tables import Scratch, map_batches


def forest(a: Iterable[int], b: Iterable[int]) -> tuple[list[int], list[int]]:
    """For the nodes of the edges (a, b): every node but the smallest of its tree, with that one."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    child = [x for x in parent if find(x) != x]
    return child, [parent[x] for x in child]


def _contract(u: list[int], v: list[int]) -> dict[str, object]:
    child, root = forest(u, v)
    return {"u": np.array(child, dtype=np.int64), "v": np.array(root, dtype=np.int64)}


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node it is connected with.

    Loops and edges with a null end count for nothing; an empty table gives none.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = scratch.put(map_batches(pairs, _contract, "u long, v long", "u", "v").distinct(), f"{name}-0")
    mark, turn = _mark(links), 0
    while mark[0]:
        turn += 1
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.put(large.where("u <> v").distinct(), f"{name}-{turn}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", "m")).where("u <> v").distinct())
        nxt = scratch.put(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn}-large", f"{name}-{turn - 1}")
        links, before, mark = nxt, mark, _mark(nxt)
        if mark == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _mark(links: DataFrame) -> tuple:
    """Count and order-free digest of an edge table."""
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)
