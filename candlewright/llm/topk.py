"""Exact top-k inner products with a vector-approximation file.

Components are whole numbers. The approximation file keeps for each vector the cell
every component lies in, 64 cells over the range of its block, and the length of what
the cells leave out; the vectors themselves are a second file. Blocks of queries scan
blocks of cells: the product with the cell centres, plus or minus the smaller of two
limits on the rest, bounds each score. A first scan finds the kth largest lower bound of
each query, a second one everything whose upper bound reaches it. Those vectors are read
from the second file in order of their bound, in rounds, as long as one that was not read
can still beat the kth exact score.

Equal vectors are one class, as a query and as what is found: a class is named by its smallest
id, and as ties go to smaller ids, its k + 1 smallest ids are all that a result can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from candlewright.llm.tables import Scratch, map_batches

#: Cells over the range of a block, vectors in a block of cells, queries in a block.
CELLS, VECTORS, QUERIES = 64, 8192, 2048


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; vectors null, without id, or with a null or
    non-finite component are left out."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(sound).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def approximate(vectors: DataFrame, cells: int = CELLS, size: int = VECTORS) -> DataFrame:
    """Blocks of the approximation file: (dims, ids, least, width, cells, rests), packed where the rows are.

    least and width are whole numbers: cell c holds least + c * width up to the next cell's first.
    """
    schema = "dims int, ids binary, least long, width long, cells binary, rests binary"
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, ids, v in _blocks(batches, size):
            least, most = (int(v.min()), int(v.max())) if v.size else (0, 0)
            width = (most - least) // cells + 1
            c = (v - least) // width
            rest = np.sqrt(((v - _centres(c, least, width)) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_pylist([{
                "dims": dims, "ids": ids.astype("<i8").tobytes(), "least": least, "width": width,
                "cells": c.astype("<u1" if cells <= 256 else "<u4").tobytes(), "rests": rest.astype("<f8").tobytes()}], schema=kinds)

    return vectors.select("vec_id", "v").mapInArrow(run, schema)


def _centres(c: np.ndarray, least: int, width: int) -> np.ndarray:
    return c.astype(np.float64) * width + (least + (width - 1) / 2)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of ``size`` vectors of the same length as arrays."""
    held: dict[int, list] = {}
    for batch in batches:
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
            own = held.setdefault(len(v), [])
            own.append((i, v))
            if len(own) == size:
                yield _block(len(v), held.pop(len(v)))
    for dims, own in held.items():
        yield _block(dims, own)


def _block(dims: int, own: list) -> tuple[int, np.ndarray, np.ndarray]:
    return dims, np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.int64).reshape(len(own), dims)


def pack(queries: DataFrame, size: int = QUERIES) -> DataFrame:
    """(dims, qb, q_ids, vs, kths): blocks of queries with, if known, the bound to reach; qb names a block.

    Store it before it is used twice: rows may be packed in another order the next time.
    """
    schema = "dims int, q_ids binary, vs binary, kths binary"
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kths: dict[int, float] = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kths.update(zip(batch.column("vec_id").to_pylist(), batch.column("kth").to_pylist()))
                yield batch

        for dims, ids, v in _blocks(noted(), size):
            least = np.array([-np.inf if (x := kths.pop(i)) is None else x for i in ids.tolist()])
            yield pa.RecordBatch.from_pylist([{"dims": dims, "q_ids": ids.astype("<i8").tobytes(), "vs": v.astype("<i8").tobytes(),
                                               "kths": least.astype("<f8").tobytes()}], schema=kinds)

    return queries.select("vec_id", "v", "kth").mapInArrow(run, schema).select(
        "dims", F.xxhash64("q_ids").alias("qb"), "q_ids", "vs", "kths")


def _bounds(d, i, least, width, c, r, qi, qv) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(queries, low, high) for parts of a query block against a block of cells."""
    kind = "<u1" if len(c) == len(i) // 8 * d else "<u4"
    i, qi = np.frombuffer(i, "<i8"), np.frombuffer(qi, "<i8")
    centre = _centres(np.frombuffer(c, kind).reshape(len(i), d), least, width)
    rest, q = np.frombuffer(r, "<f8"), np.frombuffer(qv, "<i8").astype(np.float64).reshape(len(qi), d)
    corner, norm = np.abs(q).sum(axis=1) * (width - 1) / 2, np.sqrt((q ** 2).sum(axis=1))
    for at in range(0, len(qi), 128):
        part = slice(at, at + 128)
        mid = q[part] @ centre.T
        # the factors and the one cover the rounding of these floats
        off = np.minimum(corner[part, None], norm[part, None] * rest[None, :]) * (1 + 1e-9) + 1 + np.abs(mid) * 1e-9
        yield part, mid - off, mid + off


_SCAN = ["dims", "ids", "least", "width", "cells", "rests", "q_ids", "vs", "kths"]


def _met(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """Every block of cells with every block of queries of its length."""
    names = queries.groupBy("dims").agg(F.collect_list("qb").alias("names"))
    return (cells.join(names, "dims").withColumn("qb", F.explode("names")).drop("names")
            .join(queries, ["dims", "qb"]).select(_SCAN))


def lower_bounds(cells: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, low): the k largest lower bounds of each query in each block of cells."""
    def run(*lists: list) -> Iterator[dict[str, object]]:
        for *block, _ in zip(*lists):
            ids = np.frombuffer(block[6], "<i8")
            for part, low, _ in _bounds(*block):
                top = np.partition(low, low.shape[1] - k, axis=1)[:, -k:] if low.shape[1] > k else low
                yield {"query_id": np.broadcast_to(ids[part, None], top.shape).ravel(), "low": top.ravel()}

    return map_batches(_met(cells, queries), run, "query_id long, low double", *_SCAN)


def candidates(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, high): everything whose upper bound reaches the kth lower bound of its query."""
    def run(*lists: list) -> Iterator[dict[str, object]]:
        for *block, kths in zip(*lists):
            ids, vectors, kths = np.frombuffer(block[6], "<i8"), np.frombuffer(block[1], "<i8"), np.frombuffer(kths, "<f8")
            for part, _, high in _bounds(*block):
                a, b = np.nonzero(high >= kths[part, None])
                yield {"query_id": ids[part][a], "vec_id": vectors[b], "high": high[a, b]}

    return map_batches(_met(cells, queries), run, "query_id long, vec_id long, high double", *_SCAN)


def _score(asked: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of the asked pairs, from the exact vectors."""
    both = asked.join(vectors, "vec_id").join(
        queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")

    def run(query_id: list, vec_id: list, q: list, v: list) -> Iterator[dict[str, object]]:
        for dims in {len(x) for x in q}:
            which = [i for i, x in enumerate(q) if len(x) == dims]
            for at in range(0, len(which), 8192):
                part = which[at:at + 8192]
                a, b = (np.array([x[i] for i in part], np.int64).reshape(len(part), dims) for x in (q, v))
                top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dims, 1)
                score = (a * b).sum(axis=1).tolist() if top < 2 ** 62 else [
                    sum(x * y for x, y in zip(r, s)) for r, s in zip(a.tolist(), b.tolist())]
                yield {"query_id": [query_id[i] for i in part], "vec_id": [vec_id[i] for i in part], "score": score}

    return map_batches(both, run, "query_id long, vec_id long, score long", "query_id", "vec_id", "q", "v")


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(class_id, vec_id, v): of each group of equal vectors the k smallest ids; class_id is the smallest."""
    same = Window.partitionBy("v")
    few = rows.withColumn("nth", F.row_number().over(same.orderBy("vec_id"))).where(F.col("nth") <= k)
    return few.withColumn("class_id", F.min("vec_id").over(same)).select("class_id", "vec_id", "v")


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k largest scores of each query with their rank, ties to the smaller id."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def nearest_classes(exact: DataFrame, queries: DataFrame, k: int, scratch: Scratch, cells: int = CELLS) -> DataFrame:
    """(query_id, vec_id, score, rank): the k largest products of each query with ``exact``, itself included."""
    file = scratch.put(approximate(exact, cells), "cells")
    lows = lower_bounds(file, scratch.put(pack(queries.withColumn("kth", F.lit(None).cast("double"))), "queries"), k)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
    kths = scratch.put(lows.withColumn("nth", nth).where(F.col("nth") == k).select(
        F.col("query_id").alias("vec_id"), F.col("low").alias("kth")), "kths")
    found = candidates(file, scratch.put(pack(queries.join(kths, "vec_id", "left")), "bounded-queries"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id"))
    found = scratch.put(found.withColumn("turn", turn), "candidates")
    read, number = k, 0
    best = scratch.put(_best(_score(found.where(F.col("turn") <= k).select("query_id", "vec_id"), exact, queries), k), "best-0")
    while True:
        certain = best.where(F.col("rank") == k).select("query_id", "score")
        left = found.where(F.col("turn") > read).join(certain, "query_id").where(F.col("high") >= F.col("score"))
        if left.isEmpty():
            return best
        read, number = 4 * read, number + 1
        more = _score(left.where(F.col("turn") <= read).select("query_id", "vec_id"), exact, queries)
        best = scratch.put(_best(best.drop("rank").union(more), k), f"best-{number}")
        scratch.drop(f"best-{number - 1}")


def top_k(vectors: DataFrame, is_query: str, k: int = 20, scratch: Scratch | None = None, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 64, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest products of each query with all other vectors.

    ``is_query`` is a condition on ``vec_id``. Ties go to the smaller id; a query with fewer than k
    others gets all. Vectors of different lengths are never compared. A row whose id repeats an earlier one
    with the same vector is that row; ids are expected to be unique otherwise. A score beyond 64 bits fails.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "top-k")
    rows = scratch.put(whole(vectors, id_col, vector_col, scale).distinct(), "rows")
    # one more than k, as a query may find itself
    members = scratch.put(_classes(rows, k + 1), "members")
    exact = members.where("vec_id = class_id").select("vec_id", "v")
    asked = scratch.put(rows.where(is_query).join(exact.withColumnRenamed("vec_id", "class_id"), "v").select(
        "class_id", F.col("vec_id").alias("query_id"), "v"), "asked")
    queries = scratch.put(asked.groupBy("class_id").agg(F.any_value("v").alias("v")).select(
        F.col("class_id").alias("vec_id"), "v"), "query-classes")
    near = nearest_classes(exact, queries, k + 1, scratch, cells)
    each = near.drop("rank").withColumnRenamed("vec_id", "class_id").join(members.select("class_id", "vec_id"), "class_id")
    lists = _best(each.drop("class_id"), k + 1).groupBy(F.col("query_id").alias("class_id")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda e: e.vec_id != F.col("query_id")), 1, k)
    got = asked.select("class_id", "query_id").join(lists, "class_id").select("query_id", F.posexplode(others).alias("rank", "e"))
    return got.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op10: every id divisible by 20 against all rows."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")


OP10_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""
