"""Near-duplicate documents by SimHash, compared exactly in tiles.

Equal fingerprints are one row before anything is compared. A tile holds
fingerprints whose parts (quarters of the 64 bits at the usual radius) have the
same population counts; the counts of two fingerprints differ in sum by no more
than their bits do, so tile pairs beyond the radius are never formed. The other
pairs meet in an equi-join on the neighbouring counts and are compared with
numpy exclusive-or and bit counts. A large tile is cut into blocks by a hash.
Every batch sends on the edges of a spanning forest only, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import product

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.components import components, forest
from candlewright.llm.lines import across, jaccard
from candlewright.llm.tables import Scratch, id_and_text, map_batches, without_rows

#: Pairs of large tiles that are handed to Python at once, each a megabyte and more.
HANDED = 8
#: Fingerprints of a block, about; two blocks are compared at once.
BLOCK = 2048
#: A fingerprint, how many shingles the text has, and one bit per 512th of the hash values: whether an odd number of
#: shingles lies there. Two sets differ in at least as many shingles as their sketches do in bits.
ROW = np.dtype([("fp", "<i8"), ("n", "<i8"), ("sketch", "<u8", 8)])


def fingerprint(text: bytes | None, n: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word n-grams of ``text``, repeats included; no word gives zero.

    A-Z count as a-z; words are runs of anything but space and \\t to \\r. A text of fewer than n words
    is one shingle. A bit is 1 if it is set in over half the XXH64 values.
    """
    return _majority(shingle_hashes(text, n, seed))


def shingle_hashes(text: bytes | None, n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word n-grams of ``text``, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        whole = memoryview(b" ".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - n])).tolist()
        hash64 = xxhash.xxh64_intdigest
        hashes = [hash64(whole[s:e], seed) for s, e in zip(starts, (ends[n - 1:] - 1).tolist())]
    return np.array(hashes, dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``, in one pass without a shuffle."""
    def run(ids: list, texts: list) -> dict[str, object]:
        return {"doc_id": ids, "fp": [fingerprint(t, n) for t in texts]}
    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long", "doc_id", "text")


def _tile_pairs(prints: DataFrame, radius: int, block: int, value: str = "fp") -> DataFrame:
    """(a, b): arrays of fingerprints (or of another ``value``) of two blocks whose population counts allow a pair within ``radius``."""
    parts = 4 if radius <= 2 else 2 if radius <= 4 else 1
    width = 64 // parts
    ones = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1 if parts > 1 else -1)))
            .cast("int") for i in range(parts)]
    rows = prints.select("fp", F.col(value).alias("value"), F.array(*ones).alias("cell"))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    tiles = (rows.join(sizes, "cell")
             .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("blk"))
             .agg(F.collect_list("value").alias("fps")))
    # one of each two opposite steps, and none
    steps = [s for s in product(range(-radius, radius + 1), repeat=parts)
             if sum(map(abs, s)) <= radius and s >= (0,) * parts]
    near = F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps)))
    left = (tiles.select(F.col("cell").alias("home"), F.col("blk").alias("blk_a"), F.col("fps").alias("a"), near.alias("step"))
            .select("home", "blk_a", "a", F.zip_with("home", "step", lambda x, y: x + y).alias("cell")))
    return (left.join(tiles.select("cell", "blk", F.col("fps").alias("b")), "cell")
            .where("home <> cell OR blk_a <= blk").select("a", "b"))


def _bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of every pair; numpy counts those of the absolute value of a signed number."""
    return np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :])


def _within(x: list, y: list, radius: int) -> np.ndarray:
    """Both fingerprints of every pair of different ones within ``radius``, as two rows."""
    x, y, found = np.array(x, np.int64), np.array(y, np.int64), [np.zeros((2, 0), np.int64)]
    for at in range(0, len(x), 128):
        part = x[at:at + 128]
        i, j = np.nonzero(_bits(part, y) <= radius)
        other = part[i] != y[j]
        found.append(np.stack([part[i[other]], y[j[other]]]))
    return np.concatenate(found, axis=1)


def linked(prints: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct values of ``fp``, a forest of all pairs within ``radius`` per batch."""
    def compare(a: list, b: list) -> dict[str, object]:
        ends = np.concatenate([_within(x, y, radius) for x, y in zip(a, b)], axis=1)
        child, root = forest(*ends.tolist())
        return {"a": np.array(child, np.int64), "b": np.array(root, np.int64)}

    return map_batches(_tile_pairs(prints, radius, block), compare, "a long, b long", "a", "b")


def _links(x: np.ndarray, y: np.ndarray, radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of different fingerprints (``ROW``) within ``radius`` whose sketches allow a similarity of
    ``least``: the smallest partner of each, and a forest of all, as two rows each."""
    values, place = np.unique(np.concatenate([x["fp"], y["fp"]]), return_inverse=True)
    of_x, of_y = place[:len(x)], place[len(x):]
    every, first, root = np.arange(len(values)), np.full(len(values), len(values)), np.arange(len(values))
    print_x, print_y = (np.ascontiguousarray(k["fp"]) for k in (x, y))
    for at in range(0, len(x), 64):
        i, j = np.nonzero(_bits(print_x[at:at + 64], print_y) <= radius)
        i += at
        m, n = x["n"][i], y["n"][j]
        ok = (of_x[i] != of_y[j]) & (np.minimum(m, n) >= least * np.maximum(m, n))
        i, j, m, n = i[ok], j[ok], m[ok], n[ok]
        apart = np.bitwise_count(x["sketch"][i] ^ y["sketch"][j]).sum(axis=1, dtype=np.int64)
        ok = apart * (1 + least) <= (m + n) * (1 - least) + 1e-6
        u, v = of_x[i[ok]], of_y[j[ok]]
        np.minimum.at(first, u, v)
        np.minimum.at(first, v, u)
        u, v = root[u], root[v]
        if (u != v).any():
            pairs = np.unique(u[u != v] * len(values) + v[u != v])
            child, top = forest((pairs // len(values)).tolist(), (pairs % len(values)).tolist())
            to = every.copy()
            to[child] = top
            root = to[root]
    one, two = first < len(values), root != every
    return np.stack([values[one], values[first[one]]]), np.stack([values[two], values[root[two]]])


def plausible(prints: DataFrame, radius: int, least: float, block: int = 4 * BLOCK) -> DataFrame:
    """Edges (a, b, nominee) of ``prints`` (fp, packed), by ``_links`` for each pair of tiles."""
    def compare(a: list, b: list) -> Iterator[dict[str, object]]:
        for x, y in zip(a, b):
            found = _links(*(np.frombuffer(b"".join(k), ROW) for k in (x, y)), radius, least)
            for ends, nominee in zip(found, (True, False)):
                yield {"a": ends[0], "b": ends[1], "nominee": np.full(len(ends[0]), nominee)}

    return map_batches(_tile_pairs(prints, radius, block, "packed"), compare, "a long, b long, nominee boolean", "a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 2,
                    scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fp, component_id, class_rows) of every row of ``docs``.

    component_id is the smallest id reachable over links of ``radius`` or fewer
    differing bits. A null text has no words; rows without words share fingerprint
    zero. A row without an id keeps its fingerprint and gets the smallest id of its
    component, null if that has none. class_rows counts the rows of the fingerprint.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.put(fingerprints(docs, id_col, text_col, n), "prints")
    classes = scratch.put(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("class_rows")), "classes")
    found = components(linked(classes.select("fp"), radius), scratch)
    member = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", "class_rows", F.coalesce("component", "fp").alias("component"))
    heads = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    member = scratch.put(member.join(heads, "component").select("fp", "class_rows", "component_id"), "members")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id", "class_rows")


def word_shingles(text: bytes | None, n: int) -> set[bytes]:
    words = (text or b"").lower().split()
    return {b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


def _sketched(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, fp, th, packed) of every row of ``docs``: a hash of the text, and a ``ROW``."""
    def run(ids: list, texts: list, ths: list) -> dict[str, object]:
        rows = np.zeros(len(ids), ROW)
        for row, text in zip(rows, texts):
            hashes = shingle_hashes(text, n)
            own = np.unique(hashes)
            odd = np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=512) & 1
            row["fp"], row["n"], row["sketch"] = _majority(hashes), len(own), np.packbits(odd.astype(bool)).view("<u8")
        return {"doc_id": ids, "fp": rows["fp"], "th": ths, "packed": [row.tobytes() for row in rows]}

    rows = id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    return map_batches(rows, run, "doc_id long, fp long, th long, packed binary", "doc_id", "text", "th")


@contextmanager
def _few_at_once(spark: SparkSession) -> Iterator[None]:
    """Jobs inside hand rows to Python in batches of ``HANDED``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(HANDED))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, radius: int = 12,
             least: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that are alone or have the smallest id of their group; all columns stay.

    Texts of one fingerprint are a group. All fingerprints within ``radius`` of each other whose sets of n-word shingles
    have a Jaccard similarity of ``least`` or more are linked. Sketches leave out pairs only that can't be so similar;
    each fingerprint's smallest partner of a tile is verified first, and where that leaves pairs between two components,
    the components are compared in tiles. How many of the similar pairs lie within the radius is for the README. Rows that
    share the smallest id all stay, and so do rows without id; rows of one id are told apart by a hash of their text. Null and blank texts are one group.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.put(_sketched(docs, id_col, text_col, n), "prints")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th", "packed"))).alias("first")
    classes = scratch.put(prints.groupBy("fp").agg(first).select(
        "fp", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("th"), F.col("first.packed").alias("packed")), "classes")
    with _few_at_once(docs.sparkSession):
        close = scratch.put(plausible(classes.where("first_id IS NOT NULL").select("fp", "packed"), radius, least).distinct(), "close")
    used = (close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
            .join(classes.select(F.col("fp").alias("id"), "first_id", "th"), "id"))
    texts = id_and_text(docs, id_col, text_col).withColumn("own", F.xxhash64("text"))
    texts = scratch.put(texts.join(used, (F.col("doc_id") == F.col("first_id")) & (F.col("own") == F.col("th")))
                        .groupBy("id").agg(F.min("text").alias("line")), "texts")
    pairs = close.where("nominee").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("line").alias("text_b")), "b"))

    def shingle_sets(texts: list) -> list[set[bytes]]:
        return [word_shingles(t, n) for t in texts]

    def check(a: list, b: list, text_a: list, text_b: list) -> dict[str, object]:
        same = [jaccard(*shingle_sets(k), least) for k in zip(text_a, text_b)]
        return {"a": [i for i, s in zip(a, same) if s], "b": [i for i, s in zip(b, same) if s]}

    links = scratch.put(map_batches(both, check, "a long, b long", "a", "b", "text_a", "text_b"), "links")
    found = scratch.put(components(links, scratch), "found")
    groups = components(close.select("a", "b"), scratch, "groups").select(F.col("node").alias("id"), F.col("component").alias("band"))
    members = scratch.put(groups.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "band", "id", F.coalesce("component", "id").alias("component")), "members")
    tiles = scratch.put(across(members, texts, least, shingle_sets, radius), "tiles")
    scratch.drop("texts", "close", "members")
    if not tiles.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(tiles), scratch, "all")
    member = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    heads = member.groupBy("component").agg(F.min("first_id").alias("head"))
    heads = scratch.put(member.join(heads, "component").select("fp", "head"), "heads")
    return without_rows(docs, prints.join(heads, "fp").where("doc_id <> head"), id_col, text_col)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op5: three-word shingles, links at two or fewer bits."""
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_rows")
