"""Exact removal of repeated word windows, found by difference-cover anchors.

A difference cover D of period v has for any two positions p, q a step below v that
brings both into D. So two equal windows of ``window`` words share an equal anchor of
``window - v + 1`` words that starts at a cover position of both, and it is enough to
hash anchors there, 5 in 21 words. Anchors that occur more than once extend to the
windows they lie in, and those are compared by a 128-bit hash of all their words.

Equal keys of one batch are known to repeat at once: one of them goes to the shuffle
for the others, the rest travels under a key of its own. A passage of every document
thus has a row per batch and no more in the task of its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewright.llm.tables import Scratch, map_batches, spans

#: A perfect difference cover: every step from 1 to 20 is one difference modulo 21.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hash of the n words from each position on, by doubling."""
    size = len(h) - n + 1
    out, done, part, width, power = np.zeros(size, np.uint64), 0, h, 1, base
    while True:
        if n & width:
            out = out * power + part[done:done + size]
            done += width
        if 2 * width > n:
            return _mix(out)
        part = part[:-width] * power + part[width:]
        width, power = 2 * width, np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)


def _send(keys: list[np.ndarray], rows: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(keys, places): which of equal keys stand for the others; a place ~at is known to repeat."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    for k in keys[:1]:
        new[1:] = k[order][1:] != k[order][:-1]
    for k in keys[1:]:
        new[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(order)))
    known, extra = np.empty(len(order), bool), np.empty(len(order), bool)
    known[order], extra[order] = np.repeat(counts > 1, counts), ~new
    others = np.flatnonzero(extra)
    own = [k.copy() for k in keys]
    own[0][others] = _mix(own[0][others] ^ _mix(rows[others] * _BASE[1] + at[others].astype(np.uint64)))
    return own, np.where(known, ~at, at)


def _sent(keys: list[list[np.ndarray]], which: list[np.ndarray], at: list[np.ndarray], ids: list, ths: list) -> dict[str, object]:
    which, at = np.concatenate(which), np.concatenate(at)
    th = np.array(ths, np.int64)[which]
    # rows of all batches, equal ones too, have keys of their own
    own, places = _send([np.concatenate(k) for k in keys], _mix(th.view(np.uint64)) + which.astype(np.uint64), at)
    out = {name: k.view(np.int64) for name, k in zip(("key", "more"), own)}
    return out | {"doc_id": [ids[i] for i in which.tolist()], "th": th, "place": places}


def _row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows are told apart by id and a 64-bit hash of the text, so rows of one id may differ."""
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _repeats(sent: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, th, at) of the rows whose key is there more than once."""
    many = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    at = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    return sent.withColumn("many", many | (F.col("place") < 0)).where("many").select("doc_id", "th", at.cast("int").alias("at"))


def _lists(found: DataFrame) -> DataFrame:
    """Each place once, however many equal rows there are."""
    return found.groupBy("doc_id", "th").agg(F.collect_set("at").alias("ats"))


def _with(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    lists = lists.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "ats")
    return rows.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), how)


def repeated_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
                     scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, th, at): starts of windows of ``window`` words that occur anywhere else too.

    ``th`` tells rows of the same id apart. Words are runs of anything but space and \\t to \\r.
    """
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"windows of at least {PERIOD} words are needed")
    rows = _row_keys(docs, id_col, text_col)
    cover = np.isin(np.arange(PERIOD), COVER)

    def anchors(ids: list, ths: list, texts: list) -> Iterator[dict[str, object]]:
        for part in spans(texts):
            keys, which, places = [], [], []
            for i in range(part.start, part.stop):
                words = texts[i].split() if texts[i] else []
                if len(words) < window:
                    continue
                at = np.flatnonzero(np.resize(cover, len(words) - anchor + 1))
                keys.append(rolling(word_hashes(words), anchor, _BASE[0])[at])
                which.append(np.full(len(at), i))
                places.append(at)
            if keys:
                yield _sent([keys], which, places, ids, ths)

    sent = map_batches(rows, anchors, "key long, doc_id long, th long, place int", "doc_id", "th", "text")
    anchors_found = scratch.put(_lists(_repeats(sent, ["key"])), "anchors")

    def windows(ids: list, ths: list, texts: list, lists: list) -> Iterator[dict[str, object]]:
        for part in spans(texts):
            first, second, which, places = [], [], [], []
            for i in range(part.start, part.stop):
                words = texts[i].split()
                last = len(words) - window
                near = np.zeros(len(words) + 1, np.int64)
                hits = np.array(lists[i])
                np.add.at(near, np.maximum(hits - (PERIOD - 1), 0), 1)
                np.add.at(near, hits + 1, -1)
                at = np.flatnonzero(np.cumsum(near)[:last + 1] > 0)
                h = word_hashes(words)
                first.append(rolling(h, window, _BASE[0])[at])
                second.append(rolling(_mix(h ^ _BASE[1]), window, _BASE[1])[at])
                which.append(np.full(len(at), i))
                places.append(at)
            yield _sent([first, second], which, places, ids, ths)

    sent = map_batches(_with(rows, anchors_found, "inner"), windows,
                       "key long, more long, doc_id long, th long, place int", "doc_id", "th", "text", "ats")
    found = scratch.put(_repeats(sent, ["key", "more"]), "windows")
    scratch.drop("anchors")
    return found


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
                   scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every row of ``docs``.

    Words covered by a window that occurs anywhere else, in the same text or another, are removed; all
    windows are judged on the input. ``kept`` has the other words joined by one space; ``spans`` the removed
    runs as pairs (first word, word behind). A null or empty text has no words. Equal rows repeat each other.
    """
    found = repeated_windows(docs, window, id_col, text_col, scratch)

    def cut(ids: list, texts: list, lists: list) -> Iterator[dict[str, object]]:
        for part in spans(texts):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "spans", "kept")}
            for key, text, ats in zip(ids[part], texts[part], lists[part]):
                words = text.split() if text else []
                gone = np.zeros(len(words) + 1, np.int64)
                if ats:
                    ats = np.array(ats)
                    gone[ats] += 1
                    np.add.at(gone, ats + window, -1)
                    gone = np.cumsum(gone)
                gone = np.minimum(gone, 1)
                edges = np.flatnonzero(np.diff(gone, prepend=0)).reshape(-1, 2).tolist() if ats is not None else []
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if edges else words
                for name, value in zip(out, (key, len(words), len(words) - len(kept), edges, b" ".join(kept))):
                    out[name].append(value)
            yield out

    return map_batches(_with(_row_keys(docs, id_col, text_col), _lists(found), "left"), cut,
                       "doc_id long, n_words long, n_removed long, spans array<array<int>>, kept binary",
                       "doc_id", "text", "ats")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op1: windows of 35 words."""
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
x AS (SELECT r, p AS s, string_agg(x, ' ') OVER t AS k, count(*) OVER t AS words FROM u
  WINDOW t AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
n AS (SELECT r, s, count(*) OVER (PARTITION BY k) AS n FROM x WHERE words = 35),
g AS (SELECT DISTINCT r, s + i AS p FROM n, range(35) AS t(i) WHERE n > 1),
k AS (SELECT u.r, count(g.p) AS gone, string_agg(x, ' ' ORDER BY u.p) FILTER (WHERE g.p IS NULL) AS kept
  FROM u LEFT JOIN g ON g.r = u.r AND g.p = u.p GROUP BY u.r)
SELECT doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""
