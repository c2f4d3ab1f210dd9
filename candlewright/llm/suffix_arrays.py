"""Exact removal of repeated byte strings by suffix arrays of shards.

Where a window of ``window`` bytes may match is told by its anchor: the place of the smallest hash (of its
upper 32 bits) among its grams of 32 bytes, ties to the first. Equal windows have equal anchors, at the same place. So a
text is cut into pieces, the windows of one anchor each, and shards are filled by anchor: windows that
are equal lie in one shard, unless an anchor has more pieces than a shard takes. Pieces that are equal
as a whole are one piece there, and an anchor with a single piece needs no comparison.

A shard's suffixes are sorted by Larsson-Sadakane refinement of groups, to 448 bytes for windows of 400;
common prefixes of neighbours follow in text order, each at least the one before less one (Kasai).
The shards of one anchor send sorted digests of their windows, a range of digests to each place, and
what several shards hold is looked up in each one's by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from candlewright.llm.suffixes import Groups
from candlewright.llm.tables import Scratch, map_batches, spans

GRAM, FIRST = 32, 7
#: Bytes of text cut into pieces at once, bytes of a shard, pieces of one anchor in a shard.
SPAN, SHARD, PIECES = 1_000_000, 1_500_000, 2048
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _words(t: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on as one number, first byte lowest; zeros behind the end."""
    w = np.append(t, np.zeros(7, np.uint8)).astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | w[k:] << np.uint64(8 * k)
    return w


def _gram_hashes(t: np.ndarray) -> np.ndarray:
    w = _words(t)
    size = len(t) - GRAM + 1
    h = w[:size] * _A
    for k in (8, 16, 24):
        h = (h ^ h >> np.uint64(29)) * _B + w[k:k + size] * _A
    return (h ^ h >> np.uint64(32)) * _B


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each position on."""
    size, width = len(x) - n + 1, 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:size], x[n - width:n - width + size])


def pieces(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, first digest, second digest, start, windows) of all pieces."""
    body = b"".join(texts)
    none = np.zeros(0, np.int64)
    if len(body) < window:
        return none, none, none, none, none, none
    t = np.frombuffer(body, np.uint8)
    lengths = np.array([len(x) for x in texts])
    ends = np.cumsum(lengths)
    h = _gram_hashes(t)
    bits = np.uint64(32)        # the same in every batch, or ties would fall differently
    places = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
    anchor = (_least(places, window - GRAM + 1) & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)[:len(anchor)]
    s = np.flatnonzero(np.arange(len(anchor)) + window <= ends[text])
    new = np.flatnonzero(np.append(True, (np.diff(s) != 1) | (np.diff(anchor[s]) != 0))[:len(s)])
    count = np.diff(np.append(new, len(s)))
    s = s[new]
    digests = b"".join(xxhash.xxh3_128_digest(body[i:j]) for i, j in zip(s.tolist(), (s + count + window - 1).tolist()))
    digests = np.frombuffer(digests, "<i8").reshape(-1, 2)
    text = text[s]
    return text, h[anchor[s]].view(np.int64), digests[:, 0], digests[:, 1], s - (ends - lengths)[text], count


def _suffix_order(t: np.ndarray, depth: int) -> tuple[Groups, np.ndarray, int]:
    """Suffixes sorted by ``depth`` bytes or more, with the ranks by half as many and that half."""
    w = _words(np.append(t, np.zeros(2 * depth, np.uint8)))
    groups, h = Groups(len(t)), FIRST
    # the first byte is the highest
    first = (w[:len(t)].byteswap() >> np.uint64(8)).astype(np.int64)
    groups.refine(lambda items: first[items])
    while h < depth:
        half = np.append(groups.rank, np.zeros(h, np.int64))
        groups.refine(lambda items: half[items + h])
        h *= 2
    return groups, half[:len(t)], h // 2


def _common(w: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """How many bytes from i and j on agree, of which ``size`` are known to; ``most`` is as good as more."""
    live = np.flatnonzero(size < most)
    while len(live):
        x = w[i[live] + size[live]] ^ w[j[live] + size[live]]
        equal = x == 0
        bit = np.where(equal, np.uint64(1), x & (~x + np.uint64(1)))
        size[live] += np.where(equal, 8, np.frexp(bit.astype(np.float64))[1] - 1 >> 3)
        live = live[equal & (size[live] < most)]
    return size


def shard_repeats(bodies: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte position of the joined bodies: does a window start there, and a class of equal windows.

    Windows of one class are equal; classes of one member are windows found once. -1 where none starts.
    """
    t = np.frombuffer(b"".join(bodies), np.uint8)
    lengths = np.array([len(b) for b in bodies])
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(t))
    starts = left >= window
    groups, half, h = _suffix_order(t, window)
    order = groups.order[starts[groups.order]]                # only windows inside a body
    before = np.full(len(t) + 1, -1)
    before[order[1:]] = order[:-1]
    i = np.flatnonzero(before[:-1] >= 0)
    j = before[i]
    same = groups.rank[i] == groups.rank[j]                   # agree in more than a window
    near = ~same & (half[i] == half[j])
    i, j = i[near], j[near]
    # in text order the common prefix falls by one at most, while the neighbour moves along
    w = _words(np.append(t, np.zeros(2 * h + 8, np.uint8)))
    size = np.full(len(i), h)
    linked = np.append(False, (i[1:] == i[:-1] + 1) & (starts[np.minimum(j[:-1] + 1, len(t) - 1)]))[:len(i)]
    turn = np.arange(len(i)) - np.maximum.accumulate(np.where(linked, 0, np.arange(len(i))))
    by = np.argsort(turn, kind="stable")
    edges = np.searchsorted(turn[by], np.arange(int(turn.max(initial=-1)) + 2))
    for a, b in zip(edges[:-1], edges[1:]):
        k = by[a:b]
        if a:
            size[k] = np.maximum(size[k], size[k - 1] - 1)
        size[k] = _common(w, i[k], j[k], size[k], 2 * h)
    alike = np.zeros(len(t) + 1, bool)                        # equal to the window before it in the order
    full = np.flatnonzero(before[:-1] >= 0)[same]
    alike[full] = True
    alike[i[size >= window]] = True
    kind = np.full(len(t), -1)
    kind[order] = np.cumsum(~alike[order])
    return starts, kind


def _row_keys(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text), "body": text})


def _runs(at: np.ndarray) -> np.ndarray:
    """Pairs (first, behind the last) of runs of ascending numbers, one after the other."""
    cut = np.flatnonzero(np.diff(at) != 1)
    return np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1], axis=1).reshape(-1) if len(at) else at


_FOUND = "s1 long, s2 long, runs array<int>, key long, sub int, share int, digests binary, own binary"


def _shards(asked: DataFrame, window: int) -> DataFrame:
    """Repeated windows of the pieces of each shard; for anchors with several, sorted digests of them as well.

    Rows have runs (s1, s2, runs) or a share of digests (key, sub, share, digests, own); ``own`` holds s1, s2
    and the place in the piece for windows found once in their shard, and zeros for others.
    """
    kinds = to_arrow_schema(T.StructType.fromDDL(_FOUND))

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        bodies = [r[5] for r in rows]
        starts, kind = shard_repeats(bodies, window)
        count = np.bincount(kind[starts])
        lengths = np.array([len(b) for b in bodies])
        first = np.cumsum(lengths) - lengths
        many = np.flatnonzero(starts & (count[np.maximum(kind, 0)] > 1))
        owner = np.searchsorted(first, many, "right") - 1
        out: dict[str, list] = {f: [] for f in kinds.names}
        edges = np.flatnonzero(np.append(True, np.diff(owner) != 0))[:len(owner)].tolist()
        for a, b in zip(edges, [*edges[1:], len(owner)]):
            row = rows[owner[a]]
            for name, value in zip(out, (row[3], row[4], _runs(many[a:b] - first[owner[a]]), None, None, None, None, None)):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=kinds)
        hot = [k for k, r in enumerate(rows) if r[2] > 1]
        at = 0
        while at < len(hot):
            key, sub, subs = rows[hot[at]][:3]
            end = at
            while end < len(hot) and rows[hot[end]][:2] == (key, sub):
                end += 1
            yield from _digests(rows, hot[at:end], key, sub, subs, first, kind, count)
            at = end

    def _digests(rows, which, key, sub, subs, first, kind, count) -> Iterator[pa.RecordBatch]:
        digests, own, seen = [], [], set()
        for k in which:
            body = rows[k][5]
            for p in range(len(body) - window + 1):
                c = int(kind[first[k] + p])
                if count[c] > 1:
                    if c in seen:
                        continue
                    seen.add(c)
                digests.append(xxhash.xxh3_128_digest(body[p:p + window]))
                own.append((rows[k][3], rows[k][4], p) if count[c] == 1 else (0, 0, -1))
        digests = np.array(digests, "V16")
        top = np.frombuffer(digests.tobytes(), ">u8").reshape(-1, 2)
        share = (top[:, 0] >> np.uint64(32)).astype(np.int64) * subs >> 32
        own = np.array(own, "<i8")
        by = np.lexsort((top[:, 1], top[:, 0]))
        share, digests, own = share[by], digests[by], own[by]
        edges = np.flatnonzero(np.append(True, np.diff(share) != 0))
        out = [{"key": key, "sub": sub, "share": int(share[a]), "digests": digests[a:b].tobytes(), "own": own[a:b].tobytes()}
               for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(share)])]
        yield pa.RecordBatch.from_pylist(out, schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "sub", "subs", "s1", "s2", "piece"))):
                if size >= SHARD and row[:2] != held[-1][:2]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from solve(held)

    return asked.select("key", "sub", "subs", "s1", "s2", "piece").mapInArrow(run, _FOUND)


def _merge(parts: pd.DataFrame) -> pd.DataFrame:
    """Windows that several shards of an anchor hold, for those that have them once: one share of the digests."""
    lists = [np.frombuffer(d, "S16") for d in parts["digests"]]
    every = np.sort(np.concatenate(lists))
    several = np.unique(every[1:][every[1:] == every[:-1]])
    found = []
    if len(several):
        for digests, own in zip(lists, parts["own"]):
            own = np.frombuffer(own, "<i8").reshape(-1, 3)
            at = np.minimum(np.searchsorted(several, digests), len(several) - 1)
            found.append(own[(several[at] == digests) & (own[:, 2] >= 0)])
    found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return pd.DataFrame({"s1": found[:, 0], "s2": found[:, 1], "runs": pd.Series([[p, p + 1] for p in found[:, 2].tolist()], dtype=object)})


def repeated_windows(texts: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(t1, t2, runs) of different texts (t1, t2, body): ranges of starts of windows that start anywhere else too."""
    def cut(t1: list, t2: list, bodies: list) -> Iterator[dict[str, object]]:
        for part in spans(bodies, SPAN):
            text, key, s1, s2, at, count = pieces(bodies[part], window)
            text = text.tolist()
            yield {"t1": [t1[part][k] for k in text], "t2": [t2[part][k] for k in text], "key": key, "s1": s1, "s2": s2,
                   "at": at, "windows": count}

    long = texts.where(F.length("body") >= window)
    found = scratch.put(map_batches(long, cut, "t1 long, t2 long, key long, s1 long, s2 long, at int, windows int",
                                    "t1", "t2", "body"), "pieces")
    # of equal pieces one stands for all; where it is does not matter, but all its columns are of one row
    kinds = scratch.put(found.groupBy("key", "s1", "s2").agg(
        F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("t1", "t2", "at", "windows"))), "kinds")
    contested = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(
        "key", F.ceil(F.col("kinds") / PIECES).cast("int").alias("subs"))
    asked = kinds.join(contested, "key").groupBy("t1", "t2").agg(
        F.collect_list(F.struct("key", "subs", "s1", "s2", "at", "windows")).alias("asked"))

    def take(bodies: list, lists: list) -> Iterator[dict[str, object]]:
        for part in spans(bodies, SPAN):
            rows = [(body, a) for body, own in zip(bodies[part], lists[part]) for a in own]
            yield {**{c: [a[c] for _, a in rows] for c in ("key", "subs", "s1", "s2")},
                   "piece": [body[a["at"]:a["at"] + a["windows"] + window - 1] for body, a in rows]}

    asked = map_batches(long.join(asked, ["t1", "t2"]), take, "key long, subs int, s1 long, s2 long, piece binary", "body", "asked")
    asked = asked.withColumn("sub", F.pmod("s1", "subs").cast("int")).repartition("key", "sub").sortWithinPartitions("key", "sub", "s1", "s2")
    solved = scratch.put(_shards(asked, window), "solved")
    merged = solved.where("share IS NOT NULL").groupBy("key", "share").applyInPandas(_merge, "s1 long, s2 long, runs array<int>")
    parts = solved.where("share IS NULL").select("s1", "s2", "runs").union(merged).union(
        kinds.where("n > 1").select("s1", "s2", F.array(F.lit(0), F.col("windows"))))
    at = F.transform("runs", lambda x: x + F.col("at"))
    return found.join(parts, ["s1", "s2"]).groupBy("t1", "t2").agg(F.flatten(F.collect_list(at)).alias("runs"))


def remove_repeats(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text",
                   scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, kept_sha256) of every row of ``docs``.

    Texts are UTF-8 bytes. Bytes covered by a string of ``window`` bytes that also starts anywhere else, in the
    same text or another, are removed; all strings are judged on the input. ``spans`` are the removed runs as
    pairs (first byte, byte behind), one after the other; ``kept`` the other bytes, which may not be
    UTF-8 any more. A null or empty text has no bytes. Equal rows, null ids among them, repeat each other.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffix-arrays")
    if window < 2 * GRAM:
        raise ValueError(f"windows of at least {2 * GRAM} bytes are needed")
    keyed = _row_keys(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text")
    texts = scratch.put(keyed.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.first("body").alias("body")), "texts")
    found = repeated_windows(texts, window, scratch)

    def cut(t1: list, t2: list, copies: list, bodies: list, lists: list) -> Iterator[dict[str, object]]:
        for part in spans(bodies):
            out: dict[str, list] = {k: [] for k in ("t1", "t2", "n_bytes", "n_removed", "spans", "kept", "kept_sha256")}
            for a, b, n, body, runs in zip(t1[part], t2[part], copies[part], bodies[part], lists[part]):
                runs = [0, len(body) - window + 1] if n > 1 and len(body) >= window else runs or ()
                gone = np.zeros(len(body) + 2, np.int64)
                np.add.at(gone, np.array(runs[::2], np.int64) + 1, 1)
                np.add.at(gone, np.array(runs[1::2], np.int64) + window, -1)
                edges = np.flatnonzero(np.diff(np.cumsum(gone) > 0)).tolist()
                kept = b"".join(body[i:j] for i, j in zip([0, *edges[1::2]], [*edges[::2], len(body)]))
                for name, value in zip(out, (a, b, len(body), len(body) - len(kept), edges, kept, hashlib.sha256(kept).hexdigest())):
                    out[name].append(value)
            yield out

    done = scratch.put(map_batches(
        texts.join(found, ["t1", "t2"], "left"), cut, "t1 long, t2 long, n_bytes long, n_removed long, spans array<int>, "
        "kept binary, kept_sha256 string", "t1", "t2", "copies", "body", "runs"), "done")
    scratch.drop("pieces", "kinds", "solved", "texts")
    return keyed.select("doc_id", "t1", "t2").join(done, ["t1", "t2"]).drop("t1", "t2")


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op13: strings of 400 bytes."""
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_bytes", "n_removed", F.floor(F.size("spans") / 2).alias("n_spans"), "kept_sha256")
