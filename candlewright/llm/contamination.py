"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

One pass over the corpus counts the n-grams and words of the test items. An n-gram seen at most ``COMMON``
times is a seed by itself. A commoner one, a phrase or an item that leaked often, is a seed only together
with one of the rare words of its item: an alignment of the least score matches ``ceil(least * L)`` of L
words, so the passage holds at least one of the ``L - ceil(least * L) + 1`` words of the item that are
rarest in the corpus. Counts thus decide which key a seed has, never whether a passage is found.
A second pass takes the seeds of every text with the words around them, a join by seed gives the
items, and each passage that shares enough words is aligned with its item word by word.

The score is that of the best local alignment over that of the item with itself, so a copy with a fifth
of its words exchanged has about 0.7. A copy that keeps no n-gram of the item is not found. Items of
fewer than n words are found as they stand only. Items of 128 words or more take their rare words by
pieces of ``PIECE`` words or more: one of them must match as well as the whole and hold a seed.

The tasks get three bit tables of a fixed size as filters, whatever the number of items; items, seeds and
passages are tables that Spark joins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.substrings import rolling, word_hashes
from candlewright.llm.tables import Scratch, id_and_text, map_batches, spans, without_rows

#: n-grams with more occurrences are looked for only beside a rare word of their item.
COMMON = 1_000
#: Words from which a part of an item has rare words of its own.
PIECE = 64
#: Bits of a filter; each is half a megabyte.
SLOTS = 1 << 22
#: Places of common n-grams that are looked around at once.
AROUND = 2_048
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of the passages that are aligned at once.
CELLS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = bytes.maketrans(_PUNCTUATION + bytes(range(65, 91)), b" " * len(_PUNCTUATION) + bytes(range(97, 123)))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.translate(_PLAIN).split() if text else []


def align(item: np.ndarray, passages: list[np.ndarray]) -> list[int]:
    """Smith-Waterman scores of one item against passages (word numbers), all passages at once."""
    width = max(map(len, passages))
    grid = np.full((len(passages), width), -1, np.int64)
    for row, p in zip(grid, passages):
        row[:len(p)] = p
    slope = -GAP * np.arange(width + 1)
    above, best = np.zeros((len(passages), width + 1), np.int64), np.zeros(len(passages), np.int64)
    for word in item.tolist():
        here = np.zeros_like(above)
        np.maximum(above[:, :-1] + np.where(grid == word, MATCH, MISMATCH), above[:, 1:] + GAP, out=here[:, 1:])
        np.maximum(here, 0, out=here)
        # a run of gaps in the item: the best start to the left, less its distance
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        best = np.maximum(best, here.max(axis=1))
        above = here
    return best.tolist()


def _reach(words: int, least: float) -> int:
    """Words of a text that an alignment of the least score covers at most: all match, gaps take the rest."""
    return words + max(0, int(MATCH * words * (1 - least) / -GAP))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return rolling(h, n, _BASE) if len(h) >= n else h[:0]


def _beside(gram: Column, word: Column) -> Column:
    """The seed that a common n-gram makes with a word; ``seeds_of`` does the same to arrays."""
    return gram.bitwiseXOR(F.shiftleft(word, 1))


def _filter(keys: DataFrame) -> bytes:
    """A table of ``SLOTS`` bits with those of the column ``key`` set."""
    slot = F.col("key").bitwiseAND(F.lit(SLOTS - 1))
    parts = (keys.groupBy(F.shiftright(slot, 15).alias("part"))
             .agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits")).collect())
    out = bytearray(SLOTS // 8)
    for r in parts:
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = r["bits"]
    return bytes(out)


def _opened(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)


def _is_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return table[keys & np.uint64(SLOTS - 1)]


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(no, item_id, item, size): test items as plain words, each version of an item once."""
    def plain(ids: list, texts: list) -> dict[str, object]:
        words = [words_of(t) for t in texts]
        return {"item_id": ids, "item": [b" ".join(w) for w in words], "size": list(map(len, words))}

    rows = id_and_text(benchmark, item_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return (map_batches(rows, plain, "item_id long, item binary, size int", "doc_id", "text").where("size > 0").distinct()
            .withColumn("no", F.monotonically_increasing_id()))


def _pieces(items: DataFrame, n: int, least: float) -> DataFrame:
    """(no, piece, grams, own, spare, wide): n-grams and words of the parts of an item."""
    def cut(nos: list, texts: list) -> Iterator[dict[str, object]]:
        for no, text in zip(nos, texts):
            h = word_hashes(text.split(b" "))
            grams = _grams(h, min(n, len(h)))
            parts = np.array_split(np.arange(len(h)), max(1, len(h) // PIECE))
            own = [h[p].view(np.int64).tolist() for p in parts]
            share = [least if len(h) >= n else 1.0] * len(parts)
            yield {"no": [no] * len(parts), "piece": list(range(len(parts))), "own": own,
                   "grams": [np.unique(grams[p[0]:p[-1] + 1]).view(np.int64).tolist() for p in parts],
                   "spare": [len(p) - math.ceil(s * len(p) - 1e-9) + 1 for p, s in zip(parts, share)],
                   "wide": [_reach(len(p), s) for p, s in zip(parts, share)]}

    return map_batches(items, cut, "no long, piece int, grams array<long>, own array<long>, spare int, wide int", "no", "item")


def _counts(rows: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, times): how often each key of ``known`` occurs in all texts."""
    bits = _filter(known)

    def count(texts: list) -> Iterator[dict[str, object]]:
        wanted = _opened(bits)
        for part in spans(texts):
            found = []
            for text in texts[part]:
                h = word_hashes(words_of(text))
                for keys in (h, *(_grams(h, m) for m in lengths)):
                    found.append(keys[_is_in(wanted, keys)])
            keys, times = np.unique(np.concatenate(found), return_counts=True)
            yield {"key": keys.view(np.int64), "times": times}

    found = map_batches(rows, count, "key long, times long", "text").groupBy("key").agg(F.sum("times").alias("times"))
    return known.join(found, "key", "left").select("key", F.coalesce("times", F.lit(0)).alias("times"))


def _seeds(pieces: DataFrame, counts: DataFrame, common: int) -> tuple[DataFrame, DataFrame]:
    """(key, kind, no) of every seed, and the (key) of the common n-grams."""
    grams = pieces.select("no", "piece", F.explode("grams").alias("key")).join(counts, "key")
    scarce = (pieces.select("no", "piece", "spare", F.explode("own").alias("key")).join(counts, "key")
              .groupBy("no", "piece", "spare").agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("words"))
              .select("no", "piece", F.explode(F.array_distinct(F.expr("slice(words.key, 1, spare)"))).alias("word")))
    often = grams.where(F.col("times") > common)
    pairs = often.join(scarce, ["no", "piece"]).select(_beside(F.col("key"), F.col("word")).alias("key"), F.lit(1).alias("kind"), "no")
    return grams.where(F.col("times") <= common).select("key", F.lit(0).alias("kind"), "no").union(pairs).distinct(), often.select("key").distinct()


def _passages(rows: DataFrame, seeds: DataFrame, often: DataFrame, lengths: list[int], near: int, reach: int) -> DataFrame:
    """(doc_id, th, passage, places, keys, kinds): words around seeds, and the seeds in them."""
    tables = [_filter(t) for t in (seeds.where("kind = 0"), often, seeds.where("kind = 1"))]

    def seeds_of(h: np.ndarray, opened: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        alone, phrase, beside = opened
        places, keys, kinds = [], [], []
        for m in lengths:
            grams = _grams(h, m)
            at = np.flatnonzero(_is_in(alone, grams))
            places, keys, kinds = [*places, at], [*keys, grams[at]], [*kinds, np.zeros(len(at), np.int32)]
            at = np.flatnonzero(_is_in(phrase, grams))
            for some in (at[i:i + AROUND] for i in range(0, len(at), AROUND)):
                around = np.clip(some[:, None] + np.arange(-near, near + m), 0, len(h) - 1)
                pair = grams[some][:, None] ^ (h[around] << np.uint64(1))
                row, col = np.nonzero(_is_in(beside, pair))
                both = np.unique(np.stack([some[row].astype(np.uint64), pair[row, col]]), axis=1)
                places.append(both[0].astype(np.int64))
                keys.append(both[1])
                kinds.append(np.ones(both.shape[1], np.int32))
        places, keys, kinds = map(np.concatenate, (places, keys, kinds))
        order = np.argsort(places, kind="stable")
        return places[order], keys[order], kinds[order]

    def seek(ids: list, ths: list, texts: list) -> Iterator[dict[str, object]]:
        opened = list(map(_opened, tables))
        for part in spans(texts):
            out: dict[str, list] = {k: [] for k in ("doc_id", "th", "passage", "places", "keys", "kinds")}
            for key, th, text in zip(ids[part], ths[part], texts[part]):
                words = words_of(text)
                if not words:
                    continue
                places, keys, kinds = seeds_of(word_hashes(words), opened)
                if not len(places):
                    continue
                for own in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) > 2 * reach) + 1):
                    first = max(0, int(places[own[0]]) - reach)
                    out["doc_id"].append(key)
                    out["th"].append(th)
                    out["passage"].append(b" ".join(words[first:int(places[own[-1]]) + max(lengths) + reach]))
                    out["places"].append((places[own] - first).tolist())
                    out["keys"].append(keys[own].view(np.int64).tolist())
                    out["kinds"].append(kinds[own].tolist())
            yield out

    return map_batches(rows, seek, "doc_id long, th long, passage binary, places array<int>, keys array<long>, kinds array<int>",
                       "doc_id", "th", "text")


def _aligned(pairs: DataFrame, n: int, least: float) -> DataFrame:
    """(doc_id, th, item_id, score) of pairs of a passage and an item that align with the least score or more."""
    def score(ids: list, ths: list, items: list, targets: list, passages: list, places: list) -> Iterator[dict[str, object]]:
        by: dict[bytes, list[int]] = {}
        for row, target in enumerate(targets):
            by.setdefault(target, []).append(row)
        for target, rows in by.items():
            item = target.split(b" ")
            number = {w: i for i, w in enumerate(dict.fromkeys(item))}
            wanted, counts = np.array([number[w] for w in item]), Counter(number[w] for w in item)
            share = least if len(item) >= n else 1.0
            reach, own = _reach(len(item), share), []
            for row in rows:
                line = np.array([number.get(w, -2) for w in passages[row].split(b" ")])
                at = np.array(places[row])
                for some in np.split(at, np.flatnonzero(np.diff(at) > reach) + 1):
                    part = line[max(0, int(some[0]) - reach):int(some[-1]) + n + reach]
                    # each word of the item matches once at most
                    if sum(min(c, counts[w]) for w, c in Counter(part.tolist()).items()) >= share * len(item):
                        own.append((row, part))
            own.sort(key=lambda x: -len(x[1]))
            out: dict[str, list] = {"doc_id": [], "th": [], "item_id": [], "score": []}
            at = 0
            while at < len(own):
                some = own[at:at + max(1, min(256, CELLS // len(own[at][1])))]
                at += len(some)
                for (row, _), got in zip(some, align(wanted, [p for _, p in some])):
                    if got >= share * MATCH * len(item):
                        for column, value in zip(out, (ids[row], ths[row], items[row], round(got / (MATCH * len(item)), 6))):
                            out[column].append(value)
            yield out

    return map_batches(pairs, score, "doc_id long, th long, item_id long, score double",
                       "doc_id", "th", "item_id", "item", "passage", "places")


def _found(docs: DataFrame, benchmark: DataFrame, n: int, least: float, id_col: str, text_col: str, item_col: str,
           item_text_col: str, common: int, scratch: Scratch | None) -> DataFrame:
    """(doc_id, th, item_id, score) of every passage that aligns, th being the hash of the row's text."""
    scratch = scratch or Scratch(docs.sparkSession, "contamination")
    items = scratch.put(_items(benchmark, item_col, item_text_col), "items")
    pieces = scratch.put(_pieces(items, n, least), "pieces")
    near = pieces.agg(F.max("wide")).first()[0]
    if near is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, th long, item_id long, score double")
    sizes = items.agg(F.max("size").alias("most"), F.collect_set(F.least("size", F.lit(n))).alias("lengths")).first()
    lengths, reach = sorted(sizes["lengths"]), max(_reach(sizes["most"], least), near)
    rows = id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    known = scratch.put(pieces.select(F.explode(F.concat("grams", "own")).alias("key")).distinct(), "known")
    counts = scratch.put(_counts(rows, known, lengths), "counts")
    seeds, often = (scratch.put(t, name) for t, name in zip(_seeds(pieces, counts, common), ("seeds", "often")))
    passages = _passages(rows, seeds, often, lengths, near, reach).withColumn("at", F.monotonically_increasing_id())
    passages = scratch.put(passages, "passages")
    hits = (passages.select("at", F.explode(F.arrays_zip("places", "keys", "kinds")).alias("hit"))
            .select("at", F.col("hit.places").alias("place"), F.col("hit.keys").alias("key"), F.col("hit.kinds").alias("kind")))
    pairs = (hits.join(seeds, ["key", "kind"]).groupBy("at", "no").agg(F.sort_array(F.collect_set("place")).alias("places"))
             .join(items, "no").join(passages.select("at", "doc_id", "th", "passage"), "at"))
    found = scratch.put(_aligned(pairs, n, least), "found")
    scratch.drop("passages", "pieces", "known", "counts", "seeds", "often", "items")
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 scratch: Scratch | None = None, common: int = COMMON) -> DataFrame:
    """(doc_id, item_id, score): every document and test item that align with ``least`` or more.

    The best passage counts; rows of one id count together. A null or empty text holds nothing, an item
    of fewer than n words is found only whole, and rows of one item id are versions of it, of which the best
    counts. Items without id or words are never found.
    """
    found = _found(docs, benchmark, n, least, id_col, text_col, item_col, item_text_col, common, scratch)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      scratch: Scratch | None = None, common: int = COMMON) -> DataFrame:
    """The rows of ``docs`` that no test item aligns with; all columns stay, and so do rows without id.

    Rows that share an id are told apart by the hash of their text.
    """
    found = _found(docs, benchmark, n, least, id_col, text_col, item_col, item_text_col, common, scratch)
    return without_rows(docs, found, id_col, text_col)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document of ``documents`` with the item it holds."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
