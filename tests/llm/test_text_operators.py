import collections
import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import Sets, corpus, counted, prose, table  # noqa: E402

from candlewright.llm import bpe, grammar, lines, simhash, substrings  # noqa: E402
from candlewright.llm.components import components  # noqa: E402
from candlewright.llm.tables import Scratch, map_batches, values  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).persist()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- components -----------------------------------------------------------------

def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(200, i) for i in range(201, 260)] + [(300, 300), (-5, 300), (None, 4)]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(7), Scratch(spark, "t"))
    want = {i: 0 for i in range(71)} | {i: 200 for i in range(200, 260)} | {300: -5, -5: -5}
    assert dict(got.collect()) == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# --- 1: substring dedup ---------------------------------------------------------

def brute_repeats(rows, window):
    where = {}
    for i, (_, text) in enumerate(rows):
        own = words(text)
        for s in range(len(own) - window + 1):
            where.setdefault(tuple(own[s:s + window]), []).append((i, s))
    gone = [set() for _ in rows]
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                gone[i].update(range(s, s + window))
    return [(d, len(words(t)), len(g), " ".join(w for j, w in enumerate(words(t)) if j not in g))
            for (d, t), g in zip(rows, gone)]


@pytest.mark.parametrize("window", [35, 21, 60])
def test_substrings_against_all_windows(docs, window):
    got = substrings.remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.col("kept").cast("string"))
    assert counted(got.collect()) == counted(brute_repeats(ROWS, window))


def test_equal_rows_hold_each_place_once(spark):
    text = prose(random.Random(1), 60)
    df = table(spark, [(7, text)] * 300 + [(None, text)] * 100 + [(None, None)])
    found = substrings.repeated_windows(df, 35)
    assert {(r["doc_id"], tuple(sorted(r["ats"]))) for r in substrings._lists(found).collect()} == {
        (7, tuple(range(26))), (None, tuple(range(26)))}
    assert {tuple(r) for r in substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed").collect()} == {
        (7, 60, 60), (None, 60, 60), (None, 0, 0)}


def test_texts_without_id_that_agree_in_half_of_their_hash(spark):
    """Two texts of no id whose hashes share the lower 31 bits, one of them repeated by a third row."""
    seen, pair = {}, None
    rows = spark.range(150_000).select("id", F.concat(F.lit("q "), F.col("id").cast("string")).alias("t")).select(
        "id", F.xxhash64(F.col("t").cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).alias("h")).collect()
    for r in rows:
        if r["h"] in seen:
            pair = seen[r["h"]], r["id"]
            break
        seen[r["h"]] = r["id"]
    assert pair
    keys = substrings._row_keys(table(spark, [(None, f"q {i}") for i in pair]), "doc_id", "text").select("th").collect()
    assert len({r["th"] for r in keys}) == 2 and len({r["th"] & 0x7FFFFFFF for r in keys}) == 1


def test_cover_brings_every_difference_together():
    steps = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert steps == set(range(substrings.PERIOD))


def test_substring_spans_and_empty_table(spark, docs):
    row = substrings.remove_repeats(docs).where("doc_id = 108").first()
    assert row["spans"] == [[0, 60]] and bytes(row["kept"]) == b""
    assert substrings.remove_repeats(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.repeated_windows(docs, 20)


# --- 2: line dedup --------------------------------------------------------------

def brute_lines(rows, least=0.8):
    keys = sorted({(d is not None, d or 0, i) for i, (d, _) in enumerate(rows)})
    found, sets, shingles = {}, Sets(), {}
    for _, _, i in keys:
        for no, raw in enumerate((rows[i][1] or "").split("\n") if rows[i][1] else ()):
            if line := lines.normal(raw):
                found.setdefault(line, []).append((i, no))
                shingles.setdefault(line, lines.shingles(line))
    distinct = list(found)
    for i, x in enumerate(distinct):
        for y in distinct[i + 1:]:
            if lines.jaccard(shingles[x], shingles[y], least):
                sets.join(x, y)
    return found, {x: sets.find(x) for x in distinct}


def test_lines_against_all_pairs(docs):
    got = lines.dedup_lines(docs).collect()
    found, group = brute_lines(ROWS)
    total = sum(map(len, found.values()))
    # the equal rows of id 105 keep the same lines
    twice = sum(1 for line in (ROWS[[d for d, _ in ROWS].index(105)][1]).split("\n"))
    kept = len(set(group.values()))
    assert sum(r["n_removed"] for r in got) in range(total - kept - twice, total - kept + 1)
    assert len(got) == len(ROWS) and got[0].__fields__[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {}
    for r in got:
        for line in (r["text"] or "").split("\n"):
            if lines.normal(line):
                left.setdefault(group[lines.normal(line)], set()).add((r["doc_id"], line))
    assert set(left) == set(group.values()) and all(len(v) == 1 for v in left.values())
    assert [r["text"] for r in got if r["doc_id"] == 100] == [None]


def test_hot_band_of_similar_and_of_different_lines(spark):
    base = "the quick brown fox jumps over the lazy dog while the band plays a long slow song number "
    rows = [(i, base + str(i)) for i in range(300)] + [(1000 + i, f"{i:05d} " * 3 + base[:40] + f" {i:05d}" * 9) for i in range(80)]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(table(spark, rows)).collect()}
    assert sum(got[i] for i in range(300)) == 299 and got[0] == 0
    _, group = brute_lines(rows)
    assert 380 - sum(got.values()) == len(set(group.values()))


@pytest.mark.parametrize("columns", [1 << 14, 64])
def test_similar_pairs_by_bits_against_sets(monkeypatch, columns):
    monkeypatch.setattr(lines, "COLUMNS", columns)
    rng = random.Random(2)
    some = ["".join(rng.choices("abé", k=rng.choice([1, 3, 8, 9, 40]))) for _ in range(200)]
    some += [x[:20] + rng.choice("ab") + x[20:] for x in some[:80]]
    x, y = (np.array([rng.randrange(len(some)) for _ in range(5000)]) for _ in range(2))
    sets = [lines.shingles(line) for line in some]
    for least in (0.1, 0.5, 0.8, 1.0):
        assert lines.similar_pairs(some, x, y, least).tolist() == [lines.jaccard(sets[i], sets[j], least) for i, j in zip(x, y)]
    assert len(lines.similar_pairs(some[:1], x[:0], y[:0], 0.8)) == 0
    assert list(map(tuple, lines.line_keys([*some, "\ud800"]).tolist())) == [lines.line_key(line) for line in [*some, "\ud800"]]


def test_pairs_verified_apart_against_sets():
    rng = random.Random(6)
    x = ["", "a", "aaaaaaaaaaaa", prose(rng, 300, 300)] + [prose(rng, 14, 14) for _ in range(600)]
    y = ["", "b", "aaaaaaaaaaaaaaaa", x[3]] + ["".join(c if rng.random() > 0.03 * (k % 3) else "#" for c in line) for k, line in enumerate(x[4:])]
    want = [lines.jaccard(lines.shingles(a), lines.shingles(b), 0.8) for a, b in zip(x, y)]
    assert lines.alike(x, y, 0.8).tolist() == want and 0.2 < sum(want) / len(want) < 0.9
    assert lines.alike([], [], 0.8).tolist() == []


def test_white_space_of_lines():
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    for line in ["", " ", "a  b", " A b ", "\u200bA\u00ad b", "\ud800 x", *(f"{s}A{s}{t}b{t}" for s in spaces for t in spaces)]:
        assert lines.normal(line) == " ".join(line.split()).lower()


def test_band_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(300):
        x = "".join(rng.choice(list("abcdefghij klmno"), 300))
        cut = list(x)
        cut[150:174] = rng.choice(list("pqrstuv"), 24)
        y = "".join(cut)
        a, b = lines.shingles(x), lines.shingles(y)
        assert 0.78 < len(a & b) / len(a | b) < 0.84
        hits += bool((lines.band_keys([x]) == lines.band_keys([y])).any())
    assert hits >= 294


def test_lines_of_empty_table(spark):
    assert lines.dedup_lines(table(spark, [])).count() == 0


# --- 4: token ids ---------------------------------------------------------------

def test_ids_in_files_against_the_library(spark, docs, library):
    blocks = grammar.write_ids(docs, PATH, Scratch(spark, "t"), block_ids=4000)
    assert blocks.count() > 3
    got = grammar.read_documents(blocks).collect()
    ids = {}
    for d, t in ROWS:
        ids.setdefault(d, []).append(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    assert counted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == counted(
        (d, len(x), zlib.crc32(x.tobytes())) for d, own in ids.items() for x in own)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert grammar.read_documents(grammar.write_ids(table(spark, []), PATH, Scratch(spark, "t"))).count() == 0


def test_grammar_slices_without_expanding_all():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 500, 20_000):
        ids = rng.integers(0, 6, n) ** 2
        g = grammar.repair(ids, 40, least=3)
        assert (g.expand(g.sequence) == ids).all() and g.sizes(g.sequence).sum() == n
        for _ in range(20):
            a = int(rng.integers(0, n + 1))
            b = int(rng.integers(0, n - a + 1))
            assert (g.slice(a, b) == ids[a:a + b]).all()
    assert len(g.sequence) < n / 2


@pytest.mark.parametrize("copies", [3, 11, 40])
def test_copies_of_a_passage_become_a_symbol_each(copies):
    passage = np.random.default_rng(copies).permutation(10_000)
    g = grammar.repair(np.tile(passage, copies), 10_000)
    assert (g.expand(g.sequence) == np.tile(passage, copies)).all()
    assert len(g.sequence) <= 2 * copies and len(g.rules) <= len(passage) + copies and g.lengths.max() > 4_000


def test_no_pair_is_left_that_would_save_space():
    rng = np.random.default_rng(8)
    for ids in (rng.integers(0, 30, 5_000), np.zeros(1_000, int), np.array([1, 1, 1, 2] * 50), np.repeat(rng.integers(0, 4, 90), 7)):
        g = grammar.repair(ids, 40)
        assert (g.expand(g.sequence) == ids).all()
        counts, last = collections.Counter(), None
        for pair in zip(g.sequence.tolist(), g.sequence[1:].tolist()):
            last = None if pair == last else pair      # aaa holds one aa that can be replaced
            counts[pair] += last is not None
        assert max(counts.values(), default=0) < grammar.LEAST
        uses = np.bincount(np.concatenate([g.rules.ravel(), g.sequence]), minlength=40 + len(g.rules))[40:]
        assert (uses > 0).all()


def test_numbers_of_any_width():
    for top in (0, 1, 2, 255, 256, 50_000, 2 ** 32 - 1):
        numbers = np.array([0, top, top // 2, top, 0])
        for some in (numbers, numbers[:0]):
            packed = grammar.pack_bits(some, top)
            assert grammar.unpack_bits(packed, len(some), top).tolist() == some.tolist()
            assert len(packed) == -(-len(some) * top.bit_length() // 8)


# --- 5: SimHash -----------------------------------------------------------------

def brute_fingerprint(text, n=3):
    own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i:i + n]).encode(), 42) for i in range(max(1, len(own) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(docs):
    prints = {i: brute_fingerprint(t) for i, (_, t) in enumerate(ROWS)}
    sets = Sets()
    for i in prints:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                sets.join(i, j)
    least = {}
    for i, (d, _) in enumerate(ROWS):
        if d is not None:
            least[sets.find(i)] = min(d, least.get(sets.find(i), d))
    got = simhash.near_duplicates(docs).collect()
    assert counted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == counted(
        (d, prints[i], least.get(sets.find(i))) for i, (d, _) in enumerate(ROWS))


@pytest.mark.parametrize("radius", [0, 2, 3, 6])
def test_tiles_lose_no_link(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 62, 40)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, int(rng.integers(0, radius + 3)), replace=False)) for b in base for _ in range(6)]
    fps = sorted({*map(int, base), *near, 0, -1})
    got = dict(components(simhash.linked(spark.createDataFrame([(x,) for x in fps], "fp long"), radius, block=16),
                          Scratch(spark, "t")).collect())
    sets = Sets()
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= radius:
                sets.join(x, y)
    assert {x: got.get(x, x) for x in fps} == {x: sets.find(x) for x in fps}


def test_keep_one_of_each_group(spark, docs):
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    left = [r["doc_id"] for r in got.select("doc_id").collect()]
    texts = dict(ROWS)
    shingled = {d: simhash.word_shingles((t or "").encode(), 5) for d, t in texts.items() if d is not None}
    for d in shingled:
        if d not in left:
            assert any(e < d and len(shingled[d] & shingled[e]) >= 0.8 * len(shingled[d] | shingled[e]) for e in shingled)
    assert {100, 103, 105, 110} <= set(left) and not {101, 102, 104, 106, 111} & set(left) and left.count(105) == 2
    assert simhash.keep_one(table(spark, [])).count() == 0


def test_bits_of_negative_differences():
    found = simhash._within([0, 5], [1 - (1 << 63), 5, -1], 2)
    assert found.T.tolist() == [[0, 1 - (1 << 63)], [0, 5], [5, 1 - (1 << 63)]]


@pytest.mark.parametrize("radius", [12, 26])
def test_keep_one_against_all_pairs_within_the_radius(spark, radius):
    # at 26 bits most texts have unrelated neighbours of smaller value, and a third has half-similar ones
    rng = random.Random(radius)
    rows = []
    for _ in range(50):
        base = prose(rng, rng.randrange(60, 200)).split()
        for changes in (0, 1, 2, 3, 6, 9, 14):
            own = list(base)
            for at in rng.sample(range(len(own)), changes):
                own[at] = "changed"
            rows.append((len(rows), " ".join(own)))
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(order[i], t) for i, t in rows]
    prints = {d: simhash.fingerprint(t.encode(), 5) for d, t in rows}
    shingled = {d: simhash.word_shingles(t.encode(), 5) for d, t in rows}
    sets = Sets()
    for d in prints:
        for e in range(d):
            near = ((prints[d] ^ prints[e]) & (1 << 64) - 1).bit_count() <= radius
            if near and lines.jaccard(shingled[d], shingled[e], 0.8):
                sets.join(d, e)
    got = {r["doc_id"] for r in simhash.keep_one(table(spark, rows), radius=radius).select("doc_id").collect()}
    assert got == {d for d in prints if sets.find(d) == d} and len(got) < len(rows) - 60


# --- 7: BPE ---------------------------------------------------------------------

def test_encode_and_decode_against_the_library(docs, library):
    got = bpe.encode_decode(docs, PATH).collect()
    want = []
    for d, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, np.array(ids, "<u4").tobytes(), len(ids), library.decode(ids, skip_special_tokens=False)))
    assert counted((r[0], bytes(r[1]), *r[2:]) for r in got) == counted(want)
    sums = bpe.digests(docs, PATH).where("doc_id = 105").first()
    assert sums["ids_sha256"] == hashlib.sha256(next(w[1] for w in want if w[0] == 105)).hexdigest()


def test_a_batch_is_coded_and_sent_on_in_parts(library, monkeypatch):
    monkeypatch.setattr(bpe, "id_and_text", lambda *_: None)
    monkeypatch.setattr(bpe, "map_batches", lambda df, fn, *_: fn)
    texts = [prose(random.Random(k), 4000).encode() if k % 7 else None for k in range(300)]
    parts = list(bpe.encode_decode(None, PATH)(list(range(300)), texts))
    sizes = [sum(len(texts[k] or b"") for k in part["doc_id"]) for part in parts]
    assert len(parts) > 2 and max(sizes) < bpe.SPAN + max(len(t or b"") for t in texts)
    assert [k for part in parts for k in part["doc_id"]] == list(range(300))
    ids = [x for part in parts for x in part["ids"]]
    for k in (0, 1, 150, 299):
        assert ids[k] == np.array(library.encode((texts[k] or b"").decode(), add_special_tokens=False).ids, "<u4").tobytes()


def test_free_memory_goes_back_after_each_batch():
    calls = []
    kinds = pa.schema([("k", pa.int64())])
    frame = type("Frame", (), {"select": lambda self, *_: self, "mapInArrow": lambda self, fn, _: fn})()
    run = map_batches(frame, lambda keys: {"k": keys}, "k long", "k")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: calls.append(1)})())
        out = list(run(iter([pa.record_batch([pa.array([1, 2])], schema=kinds), pa.record_batch([pa.array([3])], schema=kinds)])))
    assert [x for part in out for x in part.column(0).to_pylist()] == [1, 2, 3] and len(calls) == 2


ODD = ["<|endoftext|>x<|startoftext|>", "a<|endoftext|", "É́ ὈΣ Σ̈x İstanbul ﬁ ½ Ⅷ don't 'sam I'LL", "日本語　全角 x\u0085y z\x1cq", "ab" * 9000 + "." * 5000,
       "क्षि 한국어 ȩ́", "🙂👨‍👩‍👧 7٣४", "ǅ ẞ ŉ Ʉ", "th" * 3 + "an" * 10_000 + "ing"]


@pytest.mark.parametrize("window", [4096, 1])
def test_odd_texts_and_small_windows(library, window):
    encoder = bpe.Encoder(bpe.Vocabulary.at(PATH), window)
    for text, ids in zip(ODD, encoder.encode([t.encode() for t in ODD])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_only_pairs_with_a_new_token_are_looked_up_again(library, monkeypatch):
    vocabulary, asked = bpe.Vocabulary(PATH), []
    rank = vocabulary.rank
    monkeypatch.setattr(vocabulary, "rank", lambda left, right: asked.append(len(left)) or rank(left, right))
    words = ["internationalisation" * 50, "the" * 90 + "aaaaaaa" * 9]
    got = bpe.Encoder(vocabulary).encode([w.encode() for w in words])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(w, add_special_tokens=False).ids for w in words]
    # each byte is in a pair at first, each merge makes two pairs new at most
    assert sum(asked) <= 3 * sum(len(w.encode()) for w in words)


def test_pieces_of_different_words_are_merged_once(library, monkeypatch):
    merged, merge = [], bpe.Encoder._merge
    monkeypatch.setattr(bpe.Encoder, "_merge", lambda self, windows, closed: merged.extend(windows) or merge(self, windows, closed))
    texts = ["Bahn, (bahn) BAHN. «bahn» été-Été!", None, "bahn's bahn 7bahn77 'été' École/école"]
    encoder = bpe.Encoder(bpe.Vocabulary.at(PATH))
    for _ in range(2):
        got = encoder.encode([t and t.encode() for t in texts])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    # the library splits «bahn», so the piece is merged a second time there
    assert {p: merged.count(p) for p in set(merged)} == dict.fromkeys(
        [p.encode() for p in [",", "(", ")", ".", "été", "-", "!", "'s", "7", "'", "école", "/", "«", "»"]], 1) | {b"bahn": 2}


@pytest.mark.parametrize("kept_words", [20, bpe.KEPT_WORDS])
def test_splits_of_random_characters_against_the_library(library, kept_words):
    rng = random.Random(kept_words)
    signs = ["'", "'S", "'ll", "'RE", "'v", *"strevmld .,\n\t0Z[", *"éÉŸ×÷İıſŉĸŁµªK", "\u0301", "\x1c", "\x7f", "\u0085", "日", "<|endoftext|>", "<|"]
    texts = ["".join(rng.choices(rng.choice([signs, list(map(chr, range(0x250)))]), k=rng.randrange(30))) for _ in range(1500)]
    encoder = bpe.Encoder(bpe.Vocabulary.at(PATH), kept_words=kept_words)
    for some in (texts[:1000], texts[1000:1003], texts[1003:]):
        for text, ids in zip(some, encoder.encode([t.encode() for t in some])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("short", [1, 2, 64, 1 << 20])
def test_short_rules_are_looked_up_and_long_ones_broken_up(monkeypatch, short):
    monkeypatch.setattr(grammar, "SHORT", short)
    rng = np.random.default_rng(3)
    for ids in (np.tile(rng.integers(0, 40, 700), 9), np.zeros(1000, np.int64), np.arange(30), np.zeros(0, np.int64)):
        g = grammar.repair(ids, 40)
        table, place = g.table
        assert len(table) == 40 + g.lengths[g.lengths <= short].sum() and ((place[40:] < 0) == (g.lengths > short)).all()
        assert g.expand(g.sequence).tolist() == ids.tolist()
        assert all(g.slice(at, 25).tolist() == ids[at:at + 25].tolist() for at in range(0, max(len(ids) - 25, 1), 97))


def test_columns_as_lists():
    for column in (pa.array([1, None, 3]), pa.array([2 ** 63 - 1, -2 ** 63]), pa.array(["a", None, "\0é"]), pa.array([b"\xff\0", None]),
                   pa.array([], pa.string()), pa.array([True, None]), pa.array([[1], None]), pa.array([["a"], [], ["b", None]]).slice(1), pa.array([[[1], [2, 3]], []]), pa.array([b"x", None, b"zz"]).slice(1)):
        assert values(column) == column.to_pylist() and list(map(type, values(column))) == list(map(type, column.to_pylist()))


def test_byte_level_decoder_holds_cut_characters():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, vocabulary = Tokenizer.from_file(path), bpe.Vocabulary.at(path)
    for text in [*ODD, "naïve – “quotes” 🙂🙂 日本"]:
        ids = library.encode(text, add_special_tokens=False).ids
        if vocabulary.special and any(s.decode() in text for s in vocabulary.special):
            continue
        decoder = bpe.Decoder(vocabulary)
        parts = [decoder.push(np.array(ids[i:i + 1], "<u4")) for i in range(len(ids))] + [decoder.push(np.zeros(0, "<u4"), True)]
        assert "".join(parts) == library.decode(ids, skip_special_tokens=False)


def test_lookahead_of_a_chain_of_rules():
    # rules (a,b) < (b,c) < (c,d) in rank: whether c meets d hangs on b, and so on
    size = {i: 1 for i in range(5)} | {10: 2, 11: 2, 12: 2}
    assert bpe.lookahead([(0, 1, 10)], size.__getitem__) == 2
    assert bpe.lookahead([(2, 3, 10), (1, 2, 11), (0, 1, 12)], size.__getitem__) == 4
    assert bpe.lookahead([(0, 1, 10), (1, 2, 11), (2, 3, 12)], size.__getitem__) == 2
    with pytest.raises(ValueError):
        bpe.lookahead([(10, 1, 11), (0, 1, 10)], (size | {11: 3}).__getitem__)


def test_no_rows(spark):
    assert bpe.digests(table(spark, []), PATH).count() == 0
