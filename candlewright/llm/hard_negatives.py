"""Hard negatives for contrastive training, by angular triangle filtering.

Every vector keeps its norm and its angles to a few reference directions. For an anchor and a
row, each reference r gives an interval of their cosine: with angles s and t to r, it lies
between cos(s + t) and cos(s - t). The narrowest interval, times both norms and widened by more
than the floats can be off, bounds the whole-number score. Only rows whose interval overlaps a
window that is asked for get the exact score.

The references are directions of a spherical clustering of a bounded sample; they decide how much
is spared, never what is found. Anchors and rows meet in blocks, and each pair of blocks sends on
a few rows per anchor and positive, so equal vectors, however many, cost no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from candlewright.llm.tables import Scratch, map_batches

#: Reference directions, rows of the sample they are taken from, rows in a block, anchors in a block.
REFERENCES, SAMPLE, ROWS, ANCHORS = 16, 512, 4096, 512
_NONE = np.iinfo(np.int64).min


def whole(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of every component of the rows that take part, each row once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & sound).select(
        "vec_id", "label", F.transform("x", lambda e: F.floor(e * scale)).alias("v")).distinct()


def references(rows: DataFrame, count: int = REFERENCES, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Unit directions by vector length, from ``sample`` rows at most (those of smallest hash)."""
    taken = rows.where(F.size("v") > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    found = {}
    for dims in {len(r.v) for r in taken}:
        x = _units(np.array([r.v for r in taken if len(r.v) == dims], np.float64))
        x = x[np.abs(x).sum(axis=1) > 0]
        if not len(x):
            continue
        picked = [0]                                         # each next one is the farthest from all before
        near = x @ x[0]
        while len(picked) < min(count, len(x)):
            picked.append(int(near.argmin()))
            near = np.maximum(near, x @ x[picked[-1]])
        refs = x[picked]
        for _ in range(5):
            own = (x @ refs.T).argmax(axis=1)
            moved = np.array([x[own == i].sum(axis=0) if (own == i).any() else refs[i] for i in range(len(refs))])
            refs = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, _units(moved), refs)
        found[dims] = refs
    return found


def _units(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x ** 2).sum(axis=1, keepdims=True))
    return x / np.where(norms > 0, norms, 1)


def angles(v: np.ndarray, refs: np.ndarray | None) -> np.ndarray:
    """Angle of each row to each reference; a zero vector is put at right angles to all."""
    if refs is None:
        return np.zeros((len(v), 0))
    return np.arccos(np.clip(_units(v.astype(np.float64)) @ refs.T, -1, 1))


def pack(rows: DataFrame, refs: dict[int, np.ndarray], size: int) -> DataFrame:
    """Blocks (dims, name, ids, labels, vs, norms, thetas, pos_ids, pos_scores) of rows, ids ascending in each.

    ``rows`` may hold ``positives``, an array of (id, score) of bounded length. Store the blocks before
    they are used twice: rows may be packed in another order the next time.
    """
    schema = ("dims int, ids binary, labels binary, vs binary, norms binary, thetas binary, "
              "pos_ids array<array<long>>, pos_scores array<array<long>>")
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    if "positives" not in rows.columns:
        rows = rows.withColumn("positives", F.expr("CAST(array() AS array<struct<id: bigint, score: bigint>>)"))

    def block(dims: int, own: list) -> pa.RecordBatch:
        own.sort(key=lambda r: r[0])
        ids, labels, vs, pos = zip(*own)
        v = np.array(vs, np.int64).reshape(len(own), dims)
        norms = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        return pa.RecordBatch.from_pylist([{
            "dims": dims, "ids": np.array(ids, "<i8").tobytes(), "labels": np.array(labels, "<i8").tobytes(),
            "vs": v.astype("<i8").tobytes(), "norms": norms.astype("<f8").tobytes(),
            "thetas": angles(v, refs.get(dims)).astype("<f8").tobytes(),
            "pos_ids": [[p["id"] for p in ps] for ps in pos], "pos_scores": [[p["score"] for p in ps] for ps in pos]}], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "v", "positives"))):
                own = held.setdefault(len(row[2]), [])
                own.append(row)
                if len(own) == size:
                    yield block(len(row[2]), held.pop(len(row[2])))
        for dims, own in held.items():
            yield block(dims, own)

    return rows.select("vec_id", "label", "v", "positives").mapInArrow(run, schema).withColumn("name", F.xxhash64("ids", "vs"))


_BLOCK = ("ids", "labels", "vs", "norms", "thetas")


def _met(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every block of rows with every block of anchors of its length."""
    names = anchors.groupBy("dims").agg(F.collect_set("name").alias("names"))
    asked = anchors.select("dims", "name", "pos_ids", "pos_scores", *(F.col(c).alias(f"a_{c}") for c in _BLOCK))
    return (rows.select("dims", *_BLOCK).join(names, "dims").withColumn("name", F.explode("names")).drop("names")
            .join(asked, ["dims", "name"]).select("dims", *_BLOCK, *(f"a_{c}" for c in _BLOCK), "pos_ids", "pos_scores"))


_MET = ("dims", *_BLOCK, *(f"a_{c}" for c in _BLOCK), "pos_ids", "pos_scores")


def _arrays(dims: int, ids, labels, vs, norms, thetas) -> tuple[np.ndarray, ...]:
    ids = np.frombuffer(ids, "<i8")
    n = len(ids)
    thetas = np.frombuffer(thetas, "<f8")
    return (ids, np.frombuffer(labels, "<i8"), np.frombuffer(vs, "<i8").reshape(n, dims), np.frombuffer(norms, "<f8"),
            thetas.reshape(n, len(thetas) // n if n else 0))


def score_bounds(norms_a: np.ndarray, thetas_a: np.ndarray, norms: np.ndarray, thetas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the products of each a with each row, sure in spite of rounding.

    An angle taken by arccos is off by 3e-8 at most, so a cosine by less than 1e-6.
    """
    low = np.full((len(norms_a), len(norms)), -1.0)
    high = np.ones_like(low)
    for r in range(thetas.shape[1]):
        mid = np.cos(thetas_a[:, r])[:, None] * np.cos(thetas[:, r])[None, :]
        off = np.sin(thetas_a[:, r])[:, None] * np.sin(thetas[:, r])[None, :]
        np.maximum(low, mid - off, out=low)
        np.minimum(high, mid + off, out=high)
    size = norms_a[:, None] * norms[None, :]
    slack = size * 1e-6 + 1
    return size * low - slack, size * high + slack


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole-number products of all rows; beyond 63 bits it fails."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2 ** 63:
        return a @ b.T
    raise OverflowError("scores beyond 63 bits")


def best(scores: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k highest wanted scores of each row, ties to the first columns."""
    scores = np.where(wanted, scores, _NONE)
    if scores.shape[1] > k:
        wanted = wanted & (scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None])
    r, c = np.nonzero(wanted)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r, "left")
    kept = np.arange(len(r)) - first < k
    return r[kept], c[kept]


def positives(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor_id, id, score): in each block of rows, the k highest of the anchor's label."""
    def run(*lists: list) -> Iterator[dict[str, object]]:
        for dims, *both, _, _ in zip(*lists):
            ids, labels, v, norms, thetas = _arrays(dims, *both[:5])
            a_ids, a_labels, a_v, a_norms, a_thetas = _arrays(dims, *both[5:])
            for label in np.unique(a_labels):
                mine = np.flatnonzero(labels == label)
                own = np.flatnonzero(a_labels == label)
                for part in (own[i:i + 128] for i in range(0, len(own), 128)):
                    if not len(mine):
                        break
                    low, high = score_bounds(a_norms[part], a_thetas[part], norms[mine], thetas[mine])
                    other = a_ids[part, None] != ids[None, mine]
                    low = np.where(other, low, -np.inf)
                    if len(mine) > k:                        # what can't reach the kth lower bound is out
                        other &= high >= np.partition(low, len(mine) - k, axis=1)[:, -k, None]
                    near = np.flatnonzero(other.any(axis=0))
                    scores = products(a_v[part], v[mine[near]])
                    r, c = best(scores, other[:, near], k)
                    yield {"anchor_id": a_ids[part[r]], "id": ids[mine[near[c]]], "score": scores[r, c]}

    return map_batches(_met(rows, anchors), run, "anchor_id long, id long, score long", *_MET)


def negatives(rows: DataFrame, anchors: DataFrame, k: int, low_share: int, high_share: int) -> DataFrame:
    """(anchor_id, positive_id, negative_id, positive_score, negative_score): in each block of rows, the k
    highest of another label inside the window of each positive."""
    def run(*lists: list) -> Iterator[dict[str, object]]:
        for dims, *both, pos_ids, pos_scores in zip(*lists):
            ids, labels, v, norms, thetas = _arrays(dims, *both[:5])
            a_ids, a_labels, a_v, a_norms, a_thetas = _arrays(dims, *both[5:])
            width = max(map(len, pos_ids), default=0)
            p_ids = np.array([p + [0] * (width - len(p)) for p in pos_ids], np.int64).reshape(len(a_ids), width)
            p_scores = np.array([p + [0] * (width - len(p)) for p in pos_scores], np.int64).reshape(len(a_ids), width)
            there = np.array([[i < len(p) for i in range(width)] for p in pos_ids], bool).reshape(len(a_ids), width)
            for at in range(0, len(a_ids), 128):
                part = slice(at, at + 128)
                low, high = score_bounds(a_norms[part], a_thetas[part], norms, thetas)
                other = (a_labels[part, None] != labels[None, :]) & (a_ids[part, None] != ids[None, :])
                least, most = low_share * p_scores[part], high_share * p_scores[part]
                asked = np.zeros_like(other)
                for j in range(width):
                    asked |= there[part, j, None] & (100 * high >= least[:, j, None]) & (100 * low <= most[:, j, None])
                asked &= other
                near = np.flatnonzero(asked.any(axis=0))
                scores = products(a_v[part], v[near])
                for j in range(width):
                    inside = asked[:, near] & there[part, j, None] & (100 * scores >= least[:, j, None]) & (100 * scores <= most[:, j, None])
                    r, c = best(scores, inside, k)
                    yield {"anchor_id": a_ids[part][r], "positive_id": p_ids[part, j][r], "negative_id": ids[near[c]],
                           "positive_score": p_scores[part, j][r], "negative_score": scores[r, c]}

    return map_batches(_met(rows, anchors), run,
                       "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", *_MET)


def mine(vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", n_positives: int = 5, n_negatives: int = 5,
         low_share: int = 80, high_share: int = 100, label: Column | str = "label", id_col: str = "vec_id",
         vector_col: str = "embedding", scale: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows that meet ``is_anchor``, a condition on ``vec_id``. An anchor's positives are the
    ``n_positives`` other rows of its label with the highest products, its negatives for each of them the
    ``n_negatives`` highest rows of another label within ``low_share`` to ``high_share`` hundredths of the
    positive's score. Ties go to the smaller id; a negative positive score has an empty window.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Vectors of
    different lengths never meet. A row repeated with id, label and vector counts once; rows that share
    an id are never each other's partners, and ids are expected to be unique otherwise. Labels are
    whole numbers. A product beyond 63 bits fails.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "hard-negatives")
    rows = scratch.put(whole(vectors, id_col, vector_col, F.col(label) if isinstance(label, str) else label, scale), "rows")
    refs = references(rows)
    blocks = scratch.put(pack(rows, refs, ROWS), "blocks")
    anchors = rows.where(is_anchor)
    found = positives(blocks, scratch.put(pack(anchors, refs, ANCHORS), "anchors"), n_positives)
    turn = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    found = scratch.put(found.withColumn("turn", turn).where(F.col("turn") <= n_positives), "positives")
    held = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("id", "score")).alias("positives"))        # n_positives at most
    asked = scratch.put(pack(anchors.join(held, "vec_id"), refs, ANCHORS), "asked")
    near = negatives(blocks, asked, n_negatives, low_share, high_share)
    turn = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return near.withColumn("rank", turn.cast("int")).where(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op12: every id divisible by 100 is an anchor; ids divisible by 7 have the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)


OP12_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
  CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""
