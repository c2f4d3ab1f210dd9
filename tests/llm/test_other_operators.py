import base64
import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path[:0] = [str(Path(__file__).resolve().parent), str(ROOT)]

from helpers import corpus, counted, prose, table  # noqa: E402

import corpus_pipeline  # noqa: E402
from candlewright.llm import contamination, labelling, licenses, topk, warc  # noqa: E402
from candlewright.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from candlewright.llm.tables import Scratch  # noqa: E402

SMALL = "/root/testdata/sf0.001"


# --- 3: classifier --------------------------------------------------------------

def labelled_corpus():
    rng, rows, labels = random.Random(1), [], []
    for i in range(900):
        words = prose(rng, rng.randrange(40, 200)).replace("\n", " ").split()
        for at in range(0, len(words), 6):
            words[at] = "the of and to in".split()[at % 5]
        kind = i % 9
        if kind == 1:
            words = [w + "###" for w in words]
        if kind == 2:
            words = " | ".join(words).split(" ")
        if kind == 3:
            words[3] = "idiot"
        if kind == 4:
            words[5] = "vrazzok" + "abcdefgh"[i % 8]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if kind in (1, 2) else 1, 1 if kind in (3, 4) else 0))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = labelled_corpus()
    odd = [(None, "x"), (None, None), (2000, None), (2001, ""), (2002, " "), (2002, "ok"), (2003, "a " * 100_000)]
    given = spark.createDataFrame([*labels[:450], (None, 1, 1), (5, 1, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = labelling.score(table(spark, rows + odd), given, fitted=500).collect()
    assert len(got) == len(rows) + len(odd)
    keep = {r["doc_id"]: r["keep"] for r in got}
    held_out = labels[450:]
    clean = [i for i, q, t in held_out if q and not t]
    assert all(keep[i] for i in clean)
    assert np.mean([not keep[i] for i, q, _ in held_out if not q]) > 0.98
    assert np.mean([not keep[i] for i, _, t in held_out if t]) > 0.95
    assert keep[2000] and keep[2001] and keep[2002] and keep[None]
    left = labelling.drop_rejected(table(spark, rows + odd), given, fitted=500)
    assert left.columns[:2] == ["doc_id", "text"] and left.count() == sum(r["keep"] or r["doc_id"] is None for r in got)


def test_classifier_without_rows_or_labels(spark):
    assert labelling.score(table(spark, [])).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert labelling.score(table(spark, [(1, "a b c")]), none).first()["keep"]


def test_em_finds_how_good_labellers_are():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.2
    votes = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth).astype(int) for a in (0.95, 0.9, 0.85, 0.6)], axis=1)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = labelling.expectation_maximisation(patterns, counts.astype(float))[inverse.ravel()]
    majority = np.where(votes >= 0, votes * 2 - 1, 0).sum(axis=1) > 0
    assert ((post >= 0.5) == truth).mean() > max(0.95, (majority == truth).mean())


# --- 6: WARC --------------------------------------------------------------------

PAGES = [(1, "http://a", "x"), (2, "http://b\r\nInjected: y", "x"), (3, None, None), (4, "http://d", ""), (5, "http://e", "é" * 1000),
         (5, "http://e", "é" * 1000), (6, "http://f", "é" * 1000), (6, "http://f", "é" * 1000), (None, "http://n", "x"), (None, "m", "alone"),
         (7, "http://g", "long" * 100_000), (8, "http://h", "a\r\n\r\nWARC-Type: b\r\n")]


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' AS header", "'x' AS address", "'x' AS payload", "'x' AS sha1", "1 AS head")


@pytest.mark.parametrize("least", [0, 2])
def test_records_and_revisits(spark, least):
    headers, payloads = warc.write_archive(pages(spark, PAGES), Scratch(spark, "t"), least_bytes=least)
    assert payloads.count() == len({h or "" for _, _, h in PAGES})
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        head = max(same) if same and len(data) >= least else None
        revisit = head is not None and page != head
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "revisit" if revisit else "response", head if revisit else None))
    got = warc.read_archive(headers, payloads)
    assert counted(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == counted(want)
    assert {r["url"] for r in got.where("page_id = 2").collect()} == {"http://b%20%20Injected:%20y"}


def test_record_bytes_and_damage(spark):
    headers, payloads = warc.write_archive(pages(spark, PAGES), Scratch(spark, "t"))
    records = [bytes(r[0]) for r in warc.record_bytes(warc.records(headers, payloads)).collect()]
    assert all(r.startswith(b"WARC/1.1\r\nWARC-Type: ") and r.endswith(b"\r\n\r\n") for r in records)
    for r in records:
        head, body = r.split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert int(fields[b"Content-Length"]) == len(body) - 4
        assert fields[b"WARC-Date"] == warc.DATE.encode()
        assert (b"Content-Type" in fields) == (fields[b"WARC-Type"] == b"response")
    damaged = payloads.withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    with pytest.raises(PySparkException):
        warc.read_archive(headers, damaged).collect()
    assert warc.read_archive(*warc.write_archive(pages(spark, PAGES).where("false"), Scratch(spark, "t"))).count() == 0


def test_dates_of_records(spark):
    dated = spark.sql("SELECT 1 AS page_id, 'u' AS url, 'x' AS html, timestamp '2024-02-03 04:05:06Z' AS at UNION ALL "
                      "SELECT 2, 'u', 'y', NULL")
    headers, _ = warc.write_archive(dated, Scratch(spark, "t"), date_col="at")
    found = sorted(bytes(r["header"]).decode().split("WARC-Date: ")[1].split("\r\n")[0] for r in headers.collect())
    assert found == [warc.DATE, "2024-02-03T04:05:06Z"]


# --- 8: licences ----------------------------------------------------------------

def test_licences_by_brute_force(spark):
    rows = corpus()[:20] + [(300, "x\nReleased under the MIT License.\ny"), (301, "released UNDER the, mit license"), (302, "Licensed under CC BY-NC 4.0."),
                            (303, "This is licensed under the GNU General Public License, version 3"), (None, "Released under the MIT License."),
                            (304, None), (305, "\n \n"), (306, "MIT"), (307, "Released under the MIT License. " * 4000),
                            (308, "Licensed under CC BY-NC 4.0."), (308, "Licensed under CC BY-NC 4.0.")]

    def grams(text):
        own = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        return set(zip(own, own[1:])) if len(own) > 1 else {(w,) for w in own}
    want = set()
    for d, t in rows:
        cut = (t or "").split("\n")
        for no, part in [*enumerate(cut, 1), *([(0, t)] if len(cut) > 1 else [])]:
            for name, template in licenses.TEMPLATES:
                a, b = grams(part), grams(template)
                dice = round(2 * len(a & b) / (len(a) + len(b)), 6) if a else 0
                if dice >= 0.8:
                    want.add((d, no, name, dice))
    best = {}
    for d, no, name, dice in want:
        best[d, no, name] = max(dice, best.get((d, no, name), 0))
    got = licenses.scan(table(spark, rows)).collect()
    assert counted(got) == counted((*k, v) for k, v in best.items())
    assert {(d, n) for d, n, *_ in best} >= {(300, 2), (301, 1), (302, 1), (None, 1)}


def test_licences_without_rows_or_templates(spark):
    assert licenses.scan(table(spark, [])).count() == 0
    none = spark.createDataFrame([], "license string, text string")
    assert licenses.scan(table(spark, [(1, "MIT License")]), none).count() == 0


# --- 9: decontamination ---------------------------------------------------------

def brute_alignment(item, text):
    above, best = [0] * (len(text) + 1), 0
    for x in item:
        here = [0]
        for j, y in enumerate(text):
            here.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, here[j] - 1))
        best, above = max(best, *here), here
    return best


def test_contamination_against_full_alignment(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"{rng.choice('bcdfg')}{rng.randrange(3000)}" for _ in range(rng.randrange(12, 40)))) for i in range(12)]
    rows = []
    for i in range(120):
        text = prose(rng, 60)
        if i % 2:
            words = items[i % 12][1].split()
            for _ in range(i % 8):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice([[], ["new"], [words[at], "more"]])
            text += "\n" + " ".join(words).upper() + ". " + prose(rng, 20)
        rows.append((i, text))
    rows += [(500, None), (501, ""), (None, items[0][1]), (502, items[1][1] + " z " + items[2][1]), (503, prose(rng, 20_000) + " " + items[3][1])]
    bench = spark.createDataFrame([*items, (90, None), (91, "two words"), (None, "a b c d"), (0, items[0][1] + " longer now")],
                                  "item_id long, text string")
    got = counted(contamination.contaminated(table(spark, rows), bench).collect())
    want = {}
    for d, t in rows:
        for i, item in [*items, (0, items[0][1] + " longer now")]:
            own = contamination.words_of(item.encode())
            score = round(brute_alignment(own, contamination.words_of((t or "").encode())) / (2 * len(own)), 6)
            if score >= 0.5:
                want[d, i] = max(score, want.get((d, i), 0))
    assert got == counted((*k, v) for k, v in want.items()) and len(want) > 50
    for common in (0, 2, 10):           # n-grams that need a rare word of their item beside them
        assert counted(contamination.contaminated(table(spark, rows), bench, common=common).collect()) == got


def test_edited_copies_beside_exact_ones(spark):
    rng = random.Random(4)
    item = [f"w{i}" for i in range(30)]
    every = {k: [w if i % k else f"new{i}" for i, w in enumerate(item)] for k in (4, 5)}
    wide = [x for i, w in enumerate(item) for x in ([w, "more"] if i % 2 and i < 27 else [w])]
    around = lambda words: f"{prose(rng, 40)} {' '.join(words)} {prose(rng, 40)}"
    rows = [(0, around(item)), (1, around(every[4])), (2, around(wide)), *((10 + i, around(every[5])) for i in range(200)),
            *((300 + i, around(item[:3])) for i in range(50))]
    got = contamination.contaminated(table(spark, rows), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    want = {d: round(brute_alignment(item, t.split()) / 60, 6) for d, t in rows}
    assert counted(got.collect()) == counted((d, 7, s) for d, s in want.items() if s >= 0.5)
    assert [d for d in want if want[d] >= 0.5] == [0, 1, 2, *range(10, 210)]


def test_contamination_without_rows(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contamination.contaminated(table(spark, []), bench).count() == 0
    assert contamination.contaminated(table(spark, [(1, "a b c d e f")]), bench.where("false")).count() == 0
    left = contamination.drop_contaminated(table(spark, [(1, "a b c d e f"), (2, "x"), (None, "a b c d e f")]), bench)
    assert counted(left.select("doc_id").collect()) == counted([(2,), (None,)])


# --- 10: top-k ------------------------------------------------------------------

def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(400)]
    data += [(1000 + i, data[0][1]) for i in range(40)]                    # ties
    data += [(2000, None), (2020, [1.0, None] * 4), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (2080, []),
             (2100, [0.5] * 3), (2120, [0.25] * 3), (2140, [1e6] * 8), (None, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS v", "'x' AS score", "'x' AS rank")
    got = counted(topk.top_k(df, "vec_id % 20 = 0", k=7).collect())
    sound = [(i, np.floor(np.array(v, np.float32).astype(float) * 64).astype(np.int64)) for i, v in data
             if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in sound:
        if q % 20 == 0:
            scores = sorted((-int(x @ y), i) for i, y in sound if i != q and len(y) == len(x))[:7]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    assert got == counted(want) and topk.top_k(df.where("false"), "vec_id % 20 = 0").count() == 0


def test_top_k_among_thousands_of_equal_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.integers(-9, 9, 6)]) for i in range(300)]
    data += [(1000 + i, data[17][1]) for i in range(4000)] + [(6000 + i, data[i % 3][1]) for i in range(600)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(7)
    asked = []
    score = topk._score
    monkeypatch.setattr(topk, "_score", lambda pairs, *rest: asked.append(pairs.count()) or score(pairs, *rest))
    got = counted(topk.top_k(df, "vec_id % 20 = 0", k=5, scale=1).collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], np.int64)
    want = []
    for at in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[at]
        order = [j for j in np.lexsort((ids, -scores))[:6] if j != at][:5]
        want += [(int(ids[at]), rank, int(ids[j]), int(scores[j])) for rank, j in enumerate(order, 1)]
    assert got == counted(want)
    assert sum(asked) < 300 * 30        # pairs of classes, not of rows


@pytest.mark.parametrize("rows", [1, 3])
def test_top_k_of_fewer_rows_than_asked(spark, rows):
    df = spark.createDataFrame([(20 * i, [1.0, 2.0]) for i in range(rows)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, "vec_id % 20 = 0", k=4, scale=1)
    want = [(20 * a, rank, b, 5) for a in range(rows) for rank, b in enumerate([20 * b for b in range(rows) if b != a], 1)]
    assert counted(got.collect()) == counted(want)


# --- the pipeline ---------------------------------------------------------------

def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scratch = Scratch(spark, "t")
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, scratch.put(stage(spark, docs, SMALL), f"s{at}")
        if at < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    want = corpus_pipeline.run(spark, SMALL)
    assert counted(docs.select("doc_id", "n_tokens").collect()) == counted(want.select("doc_id", "n_tokens").collect())
    assert docs.count() > 100


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_statements_are_sql():
    assert all(isinstance(sql, str) for sql in ORACLE_SQL.values())
