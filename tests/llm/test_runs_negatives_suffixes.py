"""Operators 11 to 13 against brute force."""

import collections
import hashlib
import random
import string
import zlib

import numpy as np
import pytest
from helpers import corpus, counted, prose, table

from candlewright.llm import hard_negatives, periodic, suffix_arrays


# --- runs ---------------------------------------------------------------------------------

def runs_by_hand(words, exponent, least):
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            if i > start and size >= max(exponent * q, least) and not any(
                    all(words[start + t] == words[start + t + p] for t in range(size - p)) for p in range(1, q)):
                found.append((start, size, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 1)])
def test_runs_against_brute_force(exponent, least):
    rng = random.Random(exponent)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 12)):
            kinds, n = rng.choice([1, 2, 3, 50]), rng.choice([0, 1, 3, 20, 60, 150])
            words = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randrange(1, 12)
                words = words[:a] + (words[a:a + p] * n)[:n - a]
            texts.append([str(x).encode() for x in words])
        want = [(d, *r) for d, words in enumerate(texts) for r in runs_by_hand(words, exponent, least)]
        assert list(map(tuple, periodic.runs_of(texts, exponent, least).tolist())) == want


def test_extensions_of_all_pairs():
    rng = random.Random(4)
    x = np.array([rng.randrange(1, 4) for _ in range(120)] * 2 + [9])
    i, j = (a.ravel() for a in np.meshgrid(np.arange(len(x)), np.arange(len(x))))
    i, j = i[i != j], j[i != j]
    want = []
    for a, b in zip(i.tolist(), j.tolist()):
        k = 0
        while max(a, b) + k < len(x) and x[a + k] == x[b + k]:
            k += 1
        want.append(k)
    assert periodic.Extensions(x)(i, j).tolist() == want


def op11_by_hand(key, text):
    words = (text or "").encode().split()
    if key is not None and words and zlib.crc32(str(key).encode()) % 10 == 0:
        g, n = zlib.crc32(str(key).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_hand(words, 4, 6)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("rows", [[], corpus(5, 150) + [(200, "a b " * 400), (200, "a b " * 400), (None, "x " * 9)]])
def test_op11(spark, tmp_path, rows):
    rows = [(k, t if t is None or len(t.split()) < 1500 else " ".join(t.split()[:1200])) for k, t in rows]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert counted(got.collect()) == counted(op11_by_hand(k, t) for k, t in rows)


def test_a_long_text_of_one_word_and_one_of_two():
    words = [b"a"] * 100_000 + [b"b"] + [b"a", b"b"] * 50_000
    assert periodic.runs_of([words]).tolist() == [[0, 0, 100_000, 1], [0, 99_999, 100_002, 2]]


# --- hard negatives -----------------------------------------------------------------------

def negatives_by_hand(rows, scale=256):
    kept = {}
    for key, v, label in rows:
        if None in (key, v, label) or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept[key, (label + 1) % 10 if key % 7 == 0 else label, tuple(int(np.floor(scale * x)) for x in v)] = 1
    out = []
    for a, la, va in kept:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), k, lab) for k, lab, v in kept if k != a and len(v) == len(va)]
        for p, pos, _ in sorted(s for s in scored if s[2] == la)[:5]:
            near = sorted(s for s in scored if s[2] != la and 80 * -p <= 100 * -s[0] <= 100 * -p)[:5]
            out += [(a, pos, i + 1, k, -p, -s) for i, (s, k, _) in enumerate(near)]
    return collections.Counter(out)


def vectors(spark, path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("v", "x", "name", "dims", "ids", "turn", "positives", "rank", "score"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    df.repartition(3).write.parquet(f"{path}/embeddings.parquet")


def clustered(rng, n, dims=12):
    centres = rng.normal(0, 1, (6, dims))
    return [(i, (centres[i % 6] + rng.normal(0, 0.4, dims)).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def test_op12_with_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 900)
    rows += [(1000, None, 1), (1100, [1.0, None], 1), (1200, [float("nan")] * 12, 2), (1300, [float("inf")] * 12, 2), (None, [0.5] * 12, 1),
             (1400, [1.0] * 12, None), (1500, [0.0] * 12, 3), (1600, [], 3), (1601, [], 2), (1602, [], 3), (1700, [1.0, 2.0], 0),
             (1701, [1.0, 2.0], 0), (1702, [1.0, 1.5], 1), rows[100], rows[3]]
    vectors(spark, tmp_path, rows)
    got = hard_negatives.op12_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert counted(got.collect()) == negatives_by_hand(rows)


def test_op12_thousands_of_equal_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    same = rng.normal(0, 1, 12).tolist()
    rows = clustered(rng, 300) + [(1000 + i, same, i % 3) for i in range(4000)]
    vectors(spark, tmp_path, rows)
    assert counted(hard_negatives.op12_hard_negatives(spark, str(tmp_path)).collect()) == negatives_by_hand(rows)


def test_op12_empty_and_one_row(spark, tmp_path):
    for i, rows in enumerate([[], [(100, [1.0, 2.0], 1)]]):
        vectors(spark, tmp_path / str(i), rows)
        assert hard_negatives.op12_hard_negatives(spark, str(tmp_path / str(i))).collect() == []


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(1)
    v = np.array([np.floor(256 * np.array(r[1])) for r in clustered(rng, 600)], np.int64)
    v[5] = 0
    v[6] = v[7]
    refs = hard_negatives._units(v[[0, 1, 2, 3, 4, 8]].astype(float))
    norms, thetas = np.sqrt((v.astype(float) ** 2).sum(axis=1)), hard_negatives.angles(v, refs)
    low, high = hard_negatives.score_bounds(norms, thetas, norms, thetas)
    scores = v @ v.T
    assert (low <= scores).all() and (scores <= high).all()
    assert (high < np.quantile(scores, 0.95)).mean() > 0.3


def test_scores_of_many_bits():
    a = np.array([[2 ** 30, -2 ** 30], [3, 4]])
    assert hard_negatives.products(a, a).tolist() == (a.astype(object) @ a.T.astype(object)).tolist()
    with pytest.raises(OverflowError):
        hard_negatives.products(a * 2 ** 10, a)


# --- suffix arrays ------------------------------------------------------------------------

def repeats_by_hand(texts, window):
    texts = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i:i + window] = True
        kept = bytes(b for b, g in zip(t, gone.tolist()) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts_for_bytes(seed, n=60):
    rng = random.Random(seed)
    shared, out = [prose(rng, 120) for _ in range(3)], []
    for i in range(n):
        text = prose(rng, rng.randrange(0, 160))
        if i % 3 == 0:
            text = text[:rng.randrange(len(text) + 1)] + rng.choice(shared)[rng.randrange(200):] + prose(rng, rng.randrange(60))
        if i % 5 == 0 and out:
            other = rng.choice(out)
            at = rng.randrange(len(other) + 1)
            text = other[:at] + rng.choice(["é", "", "日本", "x"]) + other[at + 1:]
        out.append(text)
    return out + ["ab" * 900, "a" * 1000, "a" * 500 + "b" + "a" * 499, "\0" * 700, prose(rng, 80) * 2, "", " ", "é" * 300]


@pytest.mark.parametrize("window", [64, 400])
def test_shard_repeats(window):
    bodies = [t.encode() for t in texts_for_bytes(window) if len(t.encode()) >= window]
    starts, kind = suffix_arrays.shard_repeats(bodies, window)
    every = [b[i:i + window] if i + window <= len(b) else None for b in bodies for i in range(len(b))]
    assert starts.tolist() == [w is not None for w in every]
    first = {}
    assert all((kind[i] == -1) if w is None else first.setdefault(w, kind[i]) == kind[i] for i, w in enumerate(every))
    assert len(set(first.values())) == len(first)


def test_pieces_hold_each_window_once():
    texts = [t.encode() for t in texts_for_bytes(1)]
    found, anchors = collections.Counter(), {}
    for text, key, s1, s2, at, count in zip(*(a.tolist() for a in suffix_arrays.pieces(texts, 100))):
        for i in range(at, at + count):
            found[text, i] += 1
            assert anchors.setdefault(texts[text][i:i + 100], key) == key
        assert anchors.setdefault((s1, s2), texts[text][at:at + count + 99]) == texts[text][at:at + count + 99]
    assert found == collections.Counter((k, i) for k, t in enumerate(texts) for i in range(len(t) - 99))


@pytest.mark.parametrize("window,shard,in_a_shard", [(64, 1_500_000, 2048), (64, 3000, 2), (400, 20_000, 1)])
def test_repeated_bytes(spark, monkeypatch, window, shard, in_a_shard):
    """Also with shards so small that an anchor takes several."""
    monkeypatch.setattr(suffix_arrays, "SHARD", shard)
    monkeypatch.setattr(suffix_arrays, "PIECES", in_a_shard)
    texts = texts_for_bytes(window + shard)
    rows = list(enumerate(texts)) + [(1, texts[1]), (1, "other text of the id"), (None, texts[3]), (None, None), (None, "")]
    got = suffix_arrays.remove_repeats(table(spark, rows), window)
    want = counted((k, *r) for (k, _), r in zip(rows, repeats_by_hand([t for _, t in rows], window)))
    assert counted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans) // 2, r.kept_sha256) for r in got.collect()) == want


def test_op13_empty_and_odd(spark, tmp_path):
    for i, rows in enumerate([[], corpus(9, 40)]):
        table(spark, rows).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        got = suffix_arrays.op13_suffix_array_dedup(spark, f"{tmp_path}/{i}")
        assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        want = counted((k, *r) for (k, _), r in zip(rows, repeats_by_hand([t for _, t in rows], 400)))
        assert counted(got.collect()) == want


def gram_of(rng, value):
    """32 letters whose hash is ``value``: the last eight bytes follow from the others."""
    a, b, mask = int(suffix_arrays._A), int(suffix_arrays._B), 2 ** 64 - 1
    x = value * pow(b, -1, 2 ** 64) & mask
    x ^= x >> 32
    while True:
        head = "".join(rng.choice(string.ascii_letters) for _ in range(24)).encode()
        h = int.from_bytes(head[:8], "little") * a & mask
        for k in (8, 16):
            h = (h ^ h >> 29) * b + int.from_bytes(head[k:k + 8], "little") * a & mask
        tail = ((x - (h ^ h >> 29) * b) * pow(a, -1, 2 ** 64) & mask).to_bytes(8, "little")
        if all(32 < c < 127 for c in tail):
            assert suffix_arrays._gram_hashes(np.frombuffer(head + tail, np.uint8)).tolist() == [value]
            return (head + tail).decode()


def test_anchors_do_not_depend_on_the_batch(spark, monkeypatch):
    """Two hashes of a window that differ in low bits only, the text alone or with much text behind it."""
    rng = random.Random(4)
    text = (prose(rng, 9) + gram_of(rng, 2 << 12) + prose(rng, 9) + gram_of(rng, 1 << 12) + prose(rng, 30))[:200]
    texts = [text, text + prose(rng, 15_000)]
    alone, longer = (suffix_arrays.pieces([t.encode()], 200) for t in texts)
    assert alone[1][0] == longer[1][0]
    monkeypatch.setattr(suffix_arrays, "SPAN", 1)
    got = suffix_arrays.remove_repeats(table(spark, list(enumerate(texts))), 200)
    want = counted((k, *r) for k, r in enumerate(repeats_by_hand(texts, 200)))
    assert counted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans) // 2, r.kept_sha256) for r in got.collect()) == want
