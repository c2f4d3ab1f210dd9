"""Token ids in files compressed by Re-Pair grammars, with random access.

Documents are dealt out by ranges of their id, so each shard is a run of documents
in order and no task holds more than its range. A shard is cut into blocks of about
``block_ids`` ids at document ends; a block has its own grammar. Re-Pair replaces
frequent adjacent pairs by new symbols until no pair is there often enough to save
space: a rule costs two symbols and a length and saves a symbol where it is used, so
three uses pay. Pairs that overlap give way to the more frequent one, and a round
replaces all that are left; pairs seen too rarely can't come back and are not looked
at again. A block is one row: the rules, the length each rule expands to, the
remaining sequence, all in as many bits as the largest number takes, and where
documents end. Ids from any place are found by adding up lengths and expanding only
what is asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from candlewright.llm.bpe import Encoder, Vocabulary, held
from candlewright.llm.tables import Scratch, id_and_text, map_batches, spans, values

#: Ids of a block, about; one document may be longer.
BLOCK_IDS = 1 << 20
#: Uses from which a rule saves space.
LEAST = 3
#: Ids read back at a time, about; ids of a rule up to which all that it stands for is held while a block is read.
READ_IDS, SHORT = 1 << 16, 64

BLOCK_SCHEMA = ("shard long, block long, n_ids long, first_rule long, doc_ids array<long>, doc_ends binary, "
                "n_rules int, longest long, n_symbols int, rules binary, lengths binary, sequence binary")


@dataclass
class Grammar:
    """Symbols from ``first_rule`` on stand for the two of their rule, and ``lengths`` ids."""

    first_rule: int
    rules: np.ndarray       # (n, 2)
    lengths: np.ndarray     # of each rule
    sequence: np.ndarray

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Ids each symbol stands for."""
        return self.every_size[symbols]

    @cached_property
    def every_size(self) -> np.ndarray:
        return np.append(np.ones(self.first_rule, np.int64), self.lengths)

    @cached_property
    def ends(self) -> np.ndarray:
        """Ids up to the end of each symbol of the sequence."""
        return np.cumsum(self.sizes(self.sequence))

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, what the short rules stand for behind them, and the place of each symbol's ids there (-1: not short)."""
        at = np.arange(len(self.every_size))
        made = np.flatnonzero(self.lengths <= SHORT)
        ends = self.first_rule + np.cumsum(self.lengths[made])
        at[self.first_rule:] = -1
        at[self.first_rule + made] = ends - self.lengths[made]
        ids = np.arange(int(ends[-1]) if len(made) else self.first_rule, dtype=np.uint32)
        # a rule's parts are shorter, so those of one length need only what is there
        made = made[np.argsort(self.lengths[made], kind="stable")]
        for some in np.split(made, np.flatnonzero(np.diff(self.lengths[made])) + 1) if len(made) else ():
            left, right = self.rules[some].T
            k, n = np.arange(self.lengths[some[0]]), self.sizes(left)[:, None]
            ids[at[self.first_rule + some][:, None] + k] = ids[np.where(k < n, at[left][:, None] + k, at[right][:, None] + k - n)]
        return ids, at

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids of some symbols: long rules are broken up, what is left is looked up."""
        ids, place = self.table
        while len(long := np.flatnonzero(place[symbols] < 0)):
            halves = self.rules[symbols[long] - self.first_rule]
            twice = np.ones(len(symbols), np.int64)
            twice[long] = 2
            symbols = np.repeat(symbols, twice)
            long += np.arange(len(long))
            symbols[long], symbols[long + 1] = halves.T
        size = self.sizes(symbols)
        ends = np.cumsum(size)
        return ids[np.repeat(place[symbols] - ends + size, size) + np.arange(int(size.sum()))]

    def slice(self, start: int, count: int) -> np.ndarray:
        """Ids start to start + count, expanding no other symbols than those they lie in."""
        first, last = np.searchsorted(self.ends, [start, start + count - 1], side="right") if count else (0, -1)
        skip = start - (int(self.ends[first - 1]) if first else 0)
        return self.expand(self.sequence[first:last + 1])[skip:skip + count]


def _pairs(left: np.ndarray, right: np.ndarray, overlap: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of symbols up to ``top`` but for those at ``overlap``: as sorted numbers, the place of each, and the bits of ``right`` in one."""
    width, places = int(top).bit_length(), int(len(left)).bit_length()
    key = left.astype(np.int64)
    key <<= width
    key |= right
    if 2 * width + places > 63:
        key[overlap] = -1
        order = np.argsort(key)[len(overlap):]
        return key[order], order, width
    # a sort of numbers takes a fourth of the time of one of places
    key <<= places
    key |= np.arange(len(left))
    key[overlap] = -1
    key.sort()
    key = key[len(overlap):]
    return key >> places, key & (1 << places) - 1, width


def repair(ids: np.ndarray, first_rule: int, least: int = LEAST) -> Grammar:
    """Grammar of ``ids``, all below ``first_rule``, in which no pair is left ``least`` times (2 or more)."""
    sequence = np.array(ids, np.int32)
    grammar = Grammar(first_rule, np.zeros((0, 2), np.int64), np.zeros(0, np.int64), sequence)
    # pairs that may be there often enough: all copies of a pair or none
    opened = np.ones(max(len(sequence) - 1, 0), bool)
    while (at := np.flatnonzero(opened)).size >= least:
        left, right = sequence[at], sequence[at + 1]
        # every other one of aaaa overlaps no copy of itself
        twice = np.flatnonzero(left == right)
        turn = np.arange(len(twice))
        turn -= np.maximum.accumulate(np.where(np.diff(at[twice], prepend=-2) == 1, 0, turn))
        overlap = twice[turn % 2 == 1]
        known, order, width = _pairs(left, right, overlap, first_rule + len(grammar.rules))
        starts = np.flatnonzero(np.concatenate(([True], known[1:] != known[:-1])))
        counts = np.diff(np.append(starts, len(order)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        # places of a mask are taken three times as fast as the mask itself
        order = order[np.flatnonzero(np.repeat(counts >= least, counts))]
        known, counts = known[starts[often]], counts[often]

        # where pairs overlap, the one of more copies (in steps of a fourth root of two) goes first
        mixed = often * 0x9E3779B1 & 0xFFFFFFFF
        rank = np.empty(len(often), np.int32)
        rank[np.argsort((4 * np.log2(counts)).astype(np.int64) << 32 | mixed)] = np.arange(len(often))
        pair = np.full(len(at), -1, np.int32)
        pair[order] = np.repeat(rank, counts)
        some = np.flatnonzero(pair >= 0)
        place, weight = at[some], pair[some]
        pair[overlap] = pair[overlap - 1]
        opened[at] = pair >= 0
        apart = place[1:] - place[:-1] > 1
        most = np.ones(len(some), bool)
        most[1:] &= apart | (weight[1:] > weight[:-1])
        most[:-1] &= apart | (weight[:-1] > weight[1:])
        most = np.flatnonzero(most)
        w, chosen = place[most], weight[most]
        used = np.bincount(chosen, minlength=len(often))[rank] >= least
        name = np.full(len(often), -1, np.int32)
        name[rank[used]] = np.arange(used.sum()) + first_rule + len(grammar.rules)
        name = name[chosen]
        named = np.flatnonzero(name >= 0)
        w, name = w[named], name[named]
        rules = np.stack([known[used] >> width, known[used] & (1 << width) - 1], axis=1)
        lengths = grammar.sizes(rules[:, 0]) + grammar.sizes(rules[:, 1])
        sequence[w] = name
        keep = np.ones(len(sequence), bool)
        keep[w + 1] = False
        opened = np.append(opened, False)
        opened[w] = True
        opened[np.maximum(w - 1, 0)] = True
        keep = np.flatnonzero(keep)
        sequence, opened = sequence[keep], opened[keep[:-1]]
        grammar = Grammar(first_rule, np.concatenate([grammar.rules, rules]), np.concatenate([grammar.lengths, lengths]), sequence)
    grammar.sequence = grammar.sequence.astype(np.int64)
    return grammar


def pack_bits(numbers: np.ndarray, top: int) -> bytes:
    """Numbers up to ``top`` (below 2 ** 32) in as many bits as that takes."""
    width = int(top).bit_length()
    # eight numbers take whole bytes
    eight = np.zeros((-(-len(numbers) // 8), 8), np.uint64)
    eight.reshape(-1)[:len(numbers)] = numbers
    words = np.zeros((len(eight), width // 8 + 2), "<u8")
    for k in range(8):
        word, shift = divmod(k * width, 64)
        words[:, word] |= eight[:, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= eight[:, k] >> np.uint64(64 - shift)
    return words.view(np.uint8)[:, :width].tobytes()[:-(-len(numbers) * width // 8)]


def unpack_bits(packed: bytes, count: int, top: int) -> np.ndarray:
    width = int(top).bit_length()
    # the eight bytes from any byte on as one number
    words = np.ndarray(len(packed) + 1, "<u8", packed + bytes(8), strides=(1,))
    bit = np.arange(count) * width
    return (words[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.int64)


def _pack(shard: int, block: int, doc_ids: list, coded: list[bytes], first_rule: int) -> dict[str, object]:
    ids = np.frombuffer(b"".join(coded), "<u4")
    grammar = repair(ids, first_rule)
    top, longest = first_rule + len(grammar.rules), int(grammar.lengths.max(initial=0))
    return {
        "shard": shard, "block": block, "n_ids": len(ids), "first_rule": first_rule, "doc_ids": doc_ids,
        "doc_ends": np.cumsum([len(c) // 4 for c in coded]).astype("<u8").tobytes(),
        "n_rules": len(grammar.rules), "longest": longest, "n_symbols": len(grammar.sequence),
        "rules": pack_bits(grammar.rules.ravel(), top), "lengths": pack_bits(grammar.lengths, longest),
        "sequence": pack_bits(grammar.sequence, top)}


def unpack(first_rule: int, n_rules: int, longest: int, n_symbols: int, rules: bytes, lengths: bytes, sequence: bytes) -> Grammar:
    top = first_rule + n_rules
    return Grammar(first_rule, unpack_bits(rules, 2 * n_rules, top).reshape(-1, 2),
                   unpack_bits(lengths, n_rules, longest), unpack_bits(sequence, n_symbols, top))


def write_ids(docs: DataFrame, path: str, scratch: Scratch, end_id: int | None = 2, id_col: str = "doc_id",
              text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every row of ``docs``, write the blocks, and return them as read back.

    Rows are in ascending id, null ids first; rows of the same id are in the order of their texts'
    hash. A null text is empty. ``path`` is a byte-level BPE file of the tokenizers library, and the ids are
    those of its encode() without special tokens added; ``end_id`` follows each document.
    """
    kinds = to_arrow_schema(T.StructType.fromDDL(BLOCK_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.at(path)
        encoder = held(("encoder", path), lambda: Encoder(vocabulary))
        tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        first_rule = max(len(vocabulary.tokens), (end_id or 0) + 1)
        shard, block, doc_ids, coded, held_ids = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_pack(shard, block, doc_ids, coded, first_rule)], schema=kinds)

        for batch in batches:
            keys, texts = (values(batch.column(c)) for c in ("doc_id", "text"))
            for part in spans(texts):
                for key, ids in zip(keys[part], encoder.encode(texts[part])):
                    doc_ids.append(key)
                    coded.append(ids + tail)
                    held_ids += len(ids) // 4 + 1
                    if held_ids >= block_ids:
                        yield out()
                        block, doc_ids, coded, held_ids = block + 1, [], [], 0
        if doc_ids:
            yield out()

    rows = id_and_text(docs, id_col, text_col)
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return scratch.put(dealt.mapInArrow(run, BLOCK_SCHEMA), "blocks")


def block_starts(blocks: DataFrame) -> DataFrame:
    """(shard, block, block_start): ids of all blocks before, by shard totals and sums within a shard."""
    sizes = blocks.select("shard", "block", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard").select(
        "shard", "block", (F.col("shard_start") + F.col("inside")).alias("block_start"))


def read_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the blocks."""
    columns = ["shard", "block", "doc_ids", "doc_ends", "first_rule", "n_rules", "longest", "n_symbols", "rules", "lengths", "sequence"]

    def run(*lists: list) -> dict[str, object]:
        out: dict[str, list] = {k: [] for k in ("shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32")}
        for shard, block, doc_ids, doc_ends, *packed in zip(*lists):
            grammar = unpack(*packed)
            ends = np.frombuffer(doc_ends, "<u8").astype(np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            out["shard"] += [shard] * len(doc_ids)
            out["block"] += [block] * len(doc_ids)
            out["doc_id"] += doc_ids
            out["inside"] += starts.tolist()
            out["n_tokens"] += (ends - starts).tolist()
            run = starts // READ_IDS
            firsts = np.flatnonzero(np.diff(run, prepend=-1))
            for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(ends)]):
                ids = grammar.slice(int(starts[a]), int(ends[b - 1] - starts[a])).astype("<u4")
                out["ids_crc32"] += [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(
                    (starts[a:b] - starts[a]).tolist(), (ends[a:b] - starts[a]).tolist())]
        return out

    docs = map_batches(blocks, run, "shard long, block long, doc_id long, inside long, n_tokens long, ids_crc32 long",
                       *columns)
    return docs.join(block_starts(blocks), ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op4: end id 2, files written and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blocks = write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), Scratch(spark, "token-ids"))
    return read_documents(blocks)
