"""BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

``lookahead`` computes from the merge list how far to the right a merge can be
decided: a rule (c, d) may lose d, or a part on d's right edge, to an earlier rule
that takes it as its left part, and that one in turn to a still earlier rule
further right. The longest such chain bounds the bytes that matter. ``Encoder``
therefore cuts long pieces into windows, merges a window as it stands and emits
the tokens that end that far before its edge; the rest goes into the next window.
Windows of many pieces are merged at once in numpy, the lowest rank of each first.

Normalisation and the split into pieces are those of the tokenizer file: neither looks
across white space. Words of ASCII and Latin letters are split by classes of bytes, a
whole batch at once, other words by the library; distinct pieces (and words that the
library splits) are encoded once and kept in a dictionary of bounded size.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from candlewright.llm.tables import id_and_text, map_batches, spans, values

#: Pieces and words an encoder keeps; all are forgotten when there are more.
KEPT_WORDS = 1_000_000
#: Bytes of text that are encoded, decoded and sent on at once, about.
SPAN = 1_000_000
_NONE = np.int32(2 ** 31 - 1)
#: The split pattern of the file as JSON text, and the letters of two bytes that it is followed for here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTERS = re.compile("[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]")
#: Classes of bytes; a lead is the first byte of what may be such a letter, a word with others goes to the library.
_SPACE, _LETTER, _DIGIT, _SIGN, _LEAD, _OTHER = range(6)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte; for a lead less 0xC3 and the byte behind it the two of the small letter, as one number, or 0."""
    kinds, pairs = np.full(256, _OTHER, np.uint8), np.zeros((3, 256), np.uint16)
    kinds[33:127], kinds[[32, *range(9, 14)]], kinds[0xC3:0xC6] = _SIGN, _SPACE, _LEAD
    for span, kind in ((b"09", _DIGIT), (b"AZ", _LETTER), (b"az", _LETTER)):
        kinds[span[0]:span[1] + 1] = kind
    for c in filter(_LETTERS.match, map(chr, range(0xC0, 0x180))):
        lead, behind = c.encode()
        pairs[lead - 0xC3, behind] = int.from_bytes(c.lower().encode(), "big")
    return kinds, pairs


_KINDS, _PAIRS = _byte_classes()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def held(key: object, build: Callable[[], object]) -> object:
    """``build()`` once per Python process: workers outlive their tasks, by-value modules do not."""
    kept = sys.__dict__.setdefault("_candlewright_held", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def byte_chars() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself, or 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def lookahead(merges: Iterable[tuple[int, int, int]], length: Callable[[int], int]) -> int:
    """Bytes behind a token's end that decide it, for merges (left, right, result) in order of rank.

    Raises ValueError if a rule uses a token that no earlier rule makes while a later one does.
    """
    edge: dict[int, int] = {}       # through a token's inner right edge
    taken: dict[int, int] = {}      # through rules so far that take the token as their left part
    used: set[int] = set()
    most = 0
    for left, right, made in merges:
        if made in used:
            raise ValueError("a rule is used before the rule that makes its part")
        used.update((left, right))
        beyond = max(edge.get(right, 0), taken.get(right, 0))
        reach = length(right) + beyond
        edge[made] = max(edge.get(made, 0), beyond)
        taken[left] = max(taken.get(left, 0), reach)
        most = max(most, length(left) + reach)
    return most


class _Ranks:
    """Rank of a pair of ids: two hash tables, the second for what collides in the first."""

    def __init__(self, left: np.ndarray, right: np.ndarray, bits: int = 18):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        rng, todo = np.random.default_rng(7), np.arange(len(keys))
        self.tables = []
        while len(todo):
            mul = rng.integers(1 << 62, 1 << 63, dtype=np.uint64) | np.uint64(1)
            shift = np.uint64(64 - bits)
            slot = (keys[todo] * mul) >> shift
            _, first = np.unique(slot, return_index=True)
            here, ranks = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF)), np.full(1 << bits, _NONE)
            here[slot[first]], ranks[slot[first]] = keys[todo[first]], todo[first]
            self.tables.append((mul, shift, here, ranks))
            todo, bits = np.delete(todo, first), max(bits - 2, 8)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        found = np.full(len(key), _NONE)
        for mul, shift, here, ranks in self.tables:
            slot = (key * mul) >> shift
            hit = np.flatnonzero(here[slot] == key)
            found[hit] = ranks[slot[hit]]
        return found


class Vocabulary:
    """What a byte-level BPE file of the tokenizers library says, as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a byte-level BPE file is needed")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        left, right, made = (np.array(x, np.int64) for x in zip(*rules))
        self.made, self.rank = made, _Ranks(left, right)
        self.size = max(vocab.values()) + 1
        self.tokens = [""] * (max([self.size - 1, *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token.decode()
        width = {i: len(t.removesuffix(end)) for t, i in vocab.items()}
        self.lookahead = lookahead(rules, width.__getitem__)
        self.widths = np.array([width.get(i, 0) for i in range(len(self.tokens))], np.int64)
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.joined_by_space = not spec.get("decoder")
        # the file's rules for words of ASCII and Latin letters, which are in NFC; others go through the library
        known = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
        self.plain = '"NFC"' in known and '"Lowercase"' in known and PATTERN in known

    @staticmethod
    def at(path: str) -> Vocabulary:
        return held(("vocabulary", path), lambda: Vocabulary(path))

    def pieces(self, word: bytes) -> list[bytes]:
        """The bytes of each piece of a word without white space, by the library."""
        text = word.decode("utf-8", "replace")
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in found]

    def split(self, body: np.ndarray, plain: bool, whole: Iterable[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For text that ends in white space: its bytes in lower case, their classes, and which of them begin a piece.

        Words that the library has to split, and ``whole`` words from a byte up to another, stay as
        they are, as one piece of the class of other bytes. With ``plain`` False all words do.
        """
        kind, low = _KINDS[body], _LOWER[body]
        if plain:
            lead = np.flatnonzero(kind == _LEAD)
            pair = _PAIRS[body[lead] - np.uint8(0xC3), body[lead + 1]]
            lead, pair = lead[pair > 0], pair[pair > 0]
            low[lead], low[lead + 1] = pair >> 8, pair & 255
            kind[lead] = kind[lead + 1] = _LETTER
            for a, b in whole:
                kind[a:b] = _OTHER
            other = np.flatnonzero(kind >= _LEAD)
            if len(other):
                space = np.concatenate(([-1], np.flatnonzero(kind == _SPACE)))
                word = np.searchsorted(space, other)
                word = word[np.diff(word, prepend=-1) > 0]
                edge = np.zeros(len(body), np.int8)
                edge[space[word - 1] + 1], edge[space[word]] = 1, -1
                other = np.flatnonzero(np.cumsum(edge, dtype=np.int8))
        else:
            other = np.flatnonzero(kind != _SPACE)
        kind[other], low[other] = _OTHER, body[other]
        first = np.append(True, kind[1:] != kind[:-1])
        first |= kind == _DIGIT
        first &= kind != _SPACE
        # 's 't 'm 'd 're 've 'll are pieces where the sign stands alone before the letters
        at = np.flatnonzero(low == 39)
        at = at[first[at] & (kind[at] == _SIGN)]
        at = at[kind[at + 1] == _LETTER]
        a, b = low[at + 1], low[at + 2]
        size = np.isin(a, np.frombuffer(b"stmd", np.uint8)) + 2 * np.isin(
            a.astype(np.int64) << 8 | b, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
        at, size = at[size > 0], size[size > 0]
        first[at + 1] = False
        behind = at + 1 + size
        first[behind] |= kind[behind] == _LETTER
        return low, kind, first


class Encoder:
    """Texts to ids. ``window`` bytes of a piece are merged at once; memory does not grow with the text."""

    def __init__(self, vocabulary: Vocabulary, window: int = 4096, kept_words: int = KEPT_WORDS):
        self.vocabulary = vocabulary
        self.window = max(window, 2 * vocabulary.lookahead + 2)
        if any(len(name.split()) != 1 or name.strip() != name for name in vocabulary.special):
            raise ValueError("special tokens with white space are not known")
        # between spaces, special tokens are words, and none may be what a piece can be
        self.fixed = {name: i.to_bytes(4, "little") for name, i in vocabulary.special.items()}
        self.plain = vocabulary.plain and all(len(vocabulary.pieces(name)) > 1 for name in self.fixed)
        self.kept_words, self.words = kept_words, dict(self.fixed)
        names = sorted(map(re.escape, vocabulary.special), key=len, reverse=True)
        self.special = re.compile(b"(" + b"|".join(names) + b")") if names else None

    def _merge(self, windows: list[bytes], closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all windows in a row and the number of ids of each; ``closed``: the piece ends there."""
        v = self.vocabulary
        sizes = np.fromiter(map(len, windows), np.int64, len(windows))
        raw = np.frombuffer(b"".join(windows), np.uint8)
        ids = v.first[raw]
        ends = np.cumsum(sizes) - 1
        ids[ends[closed]] = v.last[raw[ends[closed]]]
        ids, owner = ids.astype(np.int32), np.repeat(np.arange(len(windows), dtype=np.int32), sizes)
        out_ids, out_owner = [], []
        last = np.zeros(len(ids), bool)
        last[ends] = True
        ranks = np.full(len(ids), _NONE)
        inner = np.flatnonzero(~last)
        ranks[inner] = v.rank(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
            low = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, len(ids))))
            over = low == _NONE
            done = np.flatnonzero(over)
            out_ids.append(ids[done])
            out_owner.append(owner[done])
            hit = ranks == low
            hit &= ~over
            # of hits in a row every second one, from the left
            if (hit[1:] & hit[:-1]).any():
                at = np.arange(len(hit))
                run = at - np.maximum.accumulate(np.where(hit, -1, at))
                hit &= run % 2 == 1
            at = np.flatnonzero(hit)
            keep = ~over
            keep[at + 1] = False
            ids[at], last[at] = v.made[ranks[at]], last[at + 1]
            place = np.cumsum(keep)
            at = place[at] - 1
            keep = np.flatnonzero(keep)
            ids, owner, ranks, last = ids[keep], owner[keep], ranks[keep], last[keep]
            # only pairs with a new token have another rank
            before = at[at > 0] - 1
            new = np.concatenate([at, before[~last[before]]])
            ranks[new] = _NONE
            new = new[~last[new]]
            ranks[new] = v.rank(ids[new], ids[new + 1])
        if not out_ids:
            return np.zeros(0, np.int64), np.zeros(len(windows), np.int64)
        owner = np.concatenate(out_owner)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(out_ids)[order], np.bincount(owner, minlength=len(windows))

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece (not empty)."""
        done: list[list[np.ndarray]] = [[] for _ in pieces]
        todo = [(i, 0) for i in range(len(pieces))]
        while todo:
            windows = [pieces[i][at:at + self.window] for i, at in todo]
            closed = np.array([at + len(w) == len(pieces[i]) for (i, at), w in zip(todo, windows)])
            ids, counts = self._merge(windows, closed)
            again = []
            for (i, at), part, over in zip(todo, np.split(ids, np.cumsum(counts)[:-1]), closed.tolist()):
                if not over:
                    ends = np.cumsum(self.vocabulary.widths[part])
                    stable = int(np.searchsorted(ends, self.window - self.vocabulary.lookahead, side="right"))
                    again.append((i, at + int(ends[stable - 1])))
                    part = part[:stable]
                done[i].append(part)
            todo = again
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in done]

    def learn(self, words: list[bytes], other: list[bool]) -> None:
        """Encode distinct pieces, of which the ``other`` are words still to split, and keep their ids as
        little-endian unsigned 32-bit integers."""
        flat, upto = words, np.arange(1, len(words) + 1)
        if any(other):
            parts = [self.vocabulary.pieces(word) if split else [word] for word, split in zip(words, other)]
            flat, upto = [piece for part in parts for piece in part], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        if max(map(len, flat), default=0) <= self.window:
            ids, counts = self._merge(flat, np.ones(len(flat), bool))
        else:
            parts = self.pieces(flat)
            ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        blob, ends = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(counts) * 4))
        at = 0
        for word, end in zip(words, ends[upto].tolist()):
            self.words[word] = blob[at:end]
            at = end

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as bytes; a null text has none."""
        spaced = [self.special.sub(rb" \1 ", text) if text and self.special and b"<" in text else text or b"" for text in texts]
        text = b" ".join(spaced) + b" "
        whole = [m.span() for m in self.special.finditer(text)] if self.special and b"<" in text else []
        low, kind, first = self.vocabulary.split(np.frombuffer(text, np.uint8), self.plain, whole)
        at, inside = np.flatnonzero(first), np.flatnonzero(kind != _SPACE)
        # the pieces' bytes in a row, and where each of them begins
        low, offsets = low[inside], np.flatnonzero(first[inside])
        offsets = np.append(offsets, len(low)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        place, distinct = pieces.indices.to_numpy(), values(pieces.dictionary)
        found = list(map(self.words.get, distinct))
        new = [k for k, ids in enumerate(found) if ids is None]
        if len(self.words) + len(new) > self.kept_words:
            self.words = dict(self.fixed)
        if new:
            other = np.zeros(len(distinct), bool)
            other[place[kind[at] == _OTHER]] = True
            words = [distinct[k] for k in new]
            self.learn(words, other[new].tolist())
            for k, word in zip(new, words):
                found[k] = self.words[word]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, start, counts = np.frombuffer(b"".join(found), "<u4"), (np.cumsum(counts) - counts)[place], counts[place]
        upto = np.concatenate(([0], np.cumsum(counts)))
        ids = flat[np.repeat(start - upto[:-1], counts) + np.arange(upto[-1])].tobytes()
        ends = np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)) + 1)
        ends = (4 * upto[np.searchsorted(at, ends)]).tolist()
        return [ids[i:j] for i, j in zip([0, *ends], ends)]


class Decoder:
    """Ids to text, a few at a time: what is complete comes out, a cut character waits for its bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.began = vocabulary, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: np.ndarray, final: bool = False) -> str:
        v = self.vocabulary
        tokens = map(v.tokens.__getitem__, ids.tolist())
        if v.byte_level:
            return self.utf8.decode(bytes(map(v.byte_of.__getitem__, "".join(tokens))), final)
        if not v.joined_by_space:
            raise ValueError("only files without a decoder or with a byte-level one are known")
        text = " ".join(tokens)
        if self.began and len(ids):
            text = " " + text
        self.began |= bool(len(ids))
        return text


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", kept_words: int = KEPT_WORDS) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded) of every row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit integers. ``path`` is a byte-level BPE file of the
    tokenizers library, readable on every executor; the ids are those of its encode() without special
    tokens added, truncation or padding, the text is that of its decode(ids, skip_special_tokens=False).
    A null text counts as empty. No shuffle. A worker keeps the ids of ``kept_words`` words at most.
    """
    return _coded(docs, path, id_col, text_col, "ids binary, n_tokens long, decoded string", lambda ids, text: {
        "ids": ids, "n_tokens": len(ids) // 4, "decoded": text}, kept_words)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, made where the ids are."""
    return _coded(
        docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: {
            "n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(),
            "decoded_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()})


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, columns: str, row: Callable,
           kept_words: int = KEPT_WORDS) -> DataFrame:
    def run(keys: list, texts: list) -> Iterator[dict[str, object]]:
        vocabulary = Vocabulary.at(path)
        encoder = held(("encoder", path, kept_words), lambda: Encoder(vocabulary, kept_words=kept_words))
        for part in spans(texts, SPAN):
            rows = []
            for ids in encoder.encode(texts[part]):
                decoder, text = Decoder(vocabulary), []
                for at in range(0, len(ids), 1 << 20):
                    text.append(decoder.push(np.frombuffer(ids[at:at + (1 << 20)], "<u4")))
                text.append(decoder.push(np.zeros(0, "<u4"), final=True))
                rows.append(row(ids, "".join(text)))
            yield {"doc_id": keys[part]} | {k: [r[k] for r in rows] for k in rows[0]}

    return map_batches(id_and_text(docs, id_col, text_col), run, f"doc_id long, {columns}", "doc_id", "text")


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op7."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
