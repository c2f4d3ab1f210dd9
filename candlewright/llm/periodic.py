"""Maximal repetitions of words (runs), by common extensions over a difference cover.

A run of period q and exponent e holds a multiple of (e - 1) q that equals the word q further on, so
for every period the words of that harmonic grid are looked at: n log n places in all. Where the two
words agree, longest common extensions to both sides give the whole run.

An extension is asked of a text's suffixes at the positions of a difference cover (3 of 7). Any two
positions come after at most 6 words to two positions of the cover, whose suffixes are sorted; from
there the least common prefix between their ranks, from a sparse table, is the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.suffixes import Groups
from candlewright.llm.tables import id_and_text, map_batches, spans

#: A perfect difference cover: every step from 1 to 6 is one difference modulo 7.
PERIOD, COVER = 7, (0, 1, 3)
#: Bytes of text handled at once, places of the grid looked at at once.
SPAN, PLACES = 1_000_000, 1_000_000

_IN = np.isin(np.arange(PERIOD), COVER)
_SLOT = np.cumsum(_IN) - 1
#: Steps from positions of these residues to the next two of the cover.
_STEPS = np.array([[next(d for d in range(PERIOD) if _IN[(a + d) % PERIOD] and _IN[(b + d) % PERIOD])
                    for b in range(PERIOD)] for a in range(PERIOD)])


class Extensions:
    """Longest common extensions of two positions of ``x``, whole numbers from 1 on.

    The last number of ``x`` occurs nowhere else, so that no suffix begins another.
    """

    def __init__(self, x: np.ndarray):
        self.x = np.append(x, np.zeros(2 * PERIOD, np.int64))
        at = np.flatnonzero(np.resize(_IN, len(x)))
        bits = int(x.max()).bit_length()
        per = max(min(63 // bits, PERIOD), 1)
        groups = Groups(len(at))
        for first in range(0, PERIOD, per):
            def words(items: np.ndarray) -> np.ndarray:
                key = np.zeros(len(items), np.int64)
                for d in range(first, min(first + per, PERIOD)):
                    key = key << bits | self.x[at[items] + d]
                return key
            groups.refine(words)
        levels, step = [groups.rank.astype(np.int32)], len(COVER)
        while len(groups.open):
            before = levels[-1]
            groups.refine(lambda items: before[items + step].astype(np.int64))
            levels.append(groups.rank.astype(np.int32))
            step *= 2
        self.rank = levels[-1]
        self.table = [self._prefixes(at, groups.order, levels)]
        while len(self.table[-1]) > (half := 1 << len(self.table) - 1):
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def _prefixes(self, at: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sorted suffix with the one before it; 0 for the first."""
        a, b = order[:-1].copy(), order[1:].copy()
        size = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step = len(COVER) << k
            live = np.flatnonzero((a + step <= len(at)) & (b + step <= len(at)))
            live = live[levels[k][a[live]] == levels[k][b[live]]]
            a[live], b[live] = a[live] + step, b[live] + step
            size[live] += PERIOD << k
        p, q = at[order[:-1]] + size, at[order[1:]] + size
        live = np.arange(len(p))
        for _ in range(PERIOD):
            live = live[self.x[p[live]] == self.x[q[live]]]
            size[live] += 1
            p[live] += 1
            q[live] += 1
        return np.append(0, size).astype(np.int32)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on are equal, i and j different."""
        steps = _STEPS[i % PERIOD, j % PERIOD]
        size = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for d in range(PERIOD):
            live = live[size[live] == d]                         # equal so far
            near = live[steps[live] > d]
            size[near] += self.x[i[near] + d] == self.x[j[near] + d]
        whole = np.flatnonzero(size == steps)
        a, b = i[whole] + steps[whole], j[whole] + steps[whole]
        a = self.rank[a // PERIOD * len(COVER) + _SLOT[a % PERIOD]]
        b = self.rank[b // PERIOD * len(COVER) + _SLOT[b % PERIOD]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        k = np.frexp(high - low)[1] - 1
        for level in np.unique(k):
            own = np.flatnonzero(k == level)
            row = self.table[level]
            size[whole[own]] += np.minimum(row[low[own]], row[high[own] - (1 << level)])
        return size


def _grid(starts: np.ndarray, sizes: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the harmonic grids of all texts, some at a time."""
    periods = sizes // exponent
    text = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (exponent - 1) * q
    count = -((q - sizes[text]) // step)                         # places t * step with t * step + q < size
    ends = np.cumsum(count)
    at = 0
    while at < len(q):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, "right")), at + 1)
        part = slice(at, to)
        c = count[part]
        turn = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        which = np.repeat(text[part], c)
        yield which, starts[which] + turn * np.repeat(step[part], c), np.repeat(q[part], c)
        at = to


def runs_of(texts: list[list], exponent: int = 4, least: int = 6) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in that order of the first, second and fourth.

    A run is a stretch of words with smallest period q, at least ``exponent`` times q and ``least`` words
    long, that no neighbouring word extends.
    """
    sizes = np.array([len(words) for words in texts], np.int64)
    known: dict = {}
    flat = [known.setdefault(w, len(known)) for words in texts for w in words]
    none = np.zeros((0, 4), np.int64)
    if not flat:
        return none
    # a number of its own before each text and behind the last keeps extensions inside
    starts = np.cumsum(sizes + 1) - sizes
    x = np.zeros(len(flat) + len(texts) + 1, np.int64)
    inside = np.ones(len(x), bool)
    inside[starts - 1] = inside[-1] = False
    x[inside] = np.array(flat, np.int64) + 1
    x[~inside] = len(known) + 1 + np.arange(len(texts) + 1)
    ahead = back = None
    found = []
    for text, i, q in _grid(starts, sizes, exponent):
        equal = x[i] == x[i + q]
        if not equal.any():
            continue
        text, i, q = text[equal], i[equal], q[equal]
        if ahead is None:
            ahead, back = Extensions(x), Extensions(x[::-1].copy())
        after, before = ahead(i, i + q), back(len(x) - i, len(x) - i - q)
        size = before + after + q
        kept = size >= np.maximum(exponent * q, least)
        found.append(np.stack([text, i - before - starts[text], size, q], axis=1)[kept])
    if not found:
        return none
    found = np.concatenate(found)
    # a stretch has its smallest period among those it is found with
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    first = np.append(True, (found[1:, :3] != found[:-1, :3]).any(axis=1))[:len(found)]
    found = found[first]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def find_runs(docs: DataFrame, exponent: int = 4, least: int = 6, rewrite: Rewrite | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of every row of ``docs``.

    Words are runs of anything but space and \\t to \\r; ``rewrite`` may change a row's words first. ``runs``
    are structs (start, length, period) by start, then period; ``best`` is the longest (ties: smallest
    start, then period), null without runs. ``collapsed`` has the words joined by one space, without those
    that any run holds after its first period. A null or empty text has no words, runs or best, and an
    empty collapsed text. Equal rows give equal rows.
    """
    def run(ids: list, texts: list) -> Iterator[dict[str, object]]:
        for part in spans(texts, SPAN):
            words = [(t or b"").split() for t in texts[part]]
            if rewrite:
                words = [rewrite(i, w) for i, w in zip(ids[part], words)]
            found = runs_of(words, exponent, least)
            ends = np.searchsorted(found[:, 0], np.arange(len(words)), "right").tolist()
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "runs", "best", "collapsed")}
            at = 0
            for key, own, end in zip(ids[part], words, ends):
                runs = [dict(zip(("start", "length", "period"), r)) for r in found[at:end, 1:].tolist()]
                if runs:
                    gone = np.zeros(len(own) + 1, np.int64)
                    np.add.at(gone, found[at:end, 1] + found[at:end, 3], 1)
                    np.add.at(gone, found[at:end, 1] + found[at:end, 2], -1)
                    kept = [w for w, g in zip(own, np.cumsum(gone).tolist()) if not g]
                else:
                    kept = own
                top = min(runs, key=lambda r: (-r["length"], r["start"], r["period"]), default=None)
                for name, value in zip(out, (key, len(own), runs, top, b" ".join(kept))):
                    out[name].append(value)
                at = end
            yield out

    one = "struct<start: bigint, length: bigint, period: bigint>"
    return map_batches(id_and_text(docs, id_col, text_col), run,
                       f"doc_id long, n_words long, runs array<{one}>, best {one}, collapsed binary", "doc_id", "text")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The rewriting of the contract of op11: a tenth of the documents repeat their words from some place on.

    It goes by the CRC-32 of the decimal id; a row without id is left as it is.
    """
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % len(words)
    left = len(words) - a
    p = 1 + left // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (left // p + 1))[:left]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op11: runs of exponent 4 and 6 words at least, in rewritten documents."""
    got = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=planted)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
