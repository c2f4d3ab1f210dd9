"""The pipeline against a plain-Python one; decisions of its filters on rows that share an id."""

import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path[:0] = [str(Path(__file__).resolve().parent), str(ROOT)]

from helpers import Sets, counted, prose, table  # noqa: E402
from test_other_operators import brute_alignment, labelled_corpus  # noqa: E402
from test_text_operators import brute_fingerprint, words  # noqa: E402

import corpus_pipeline  # noqa: E402
from candlewright.llm import contamination, labelling, simhash  # noqa: E402

RNG = random.Random(12)


def clean(n, width=None):
    own = prose(RNG, n).split()
    for at in range(0, len(own), 6):
        own[at] = "the of and to in".split()[at % 5]
    width = width or len(own)
    return "\n".join(" ".join(own[i:i + width]) for i in range(0, len(own), width))


ITEMS = [(i, " ".join(f"{RNG.choice('bcdfg')}{RNG.randrange(3000)}" for _ in range(25))) for i in range(3)]


def fixture():
    rows, labels = labelled_corpus()
    rows, labels = rows[:400], labels[:400]
    for i in range(20):                                         # copies with other line ends and a changed word
        base = clean(90, 12)
        own = base.split()
        own[-1] = "changed"
        rows += [(5000 + i, base), (4000 - i if i % 2 else 6000 + i, "\n".join(" ".join(own[k:k + 7]) for k in range(0, 90, 7)))]
    for i in range(15):
        rows.append((7000 + i, f"{clean(40)}\nshare this page with your friends and read our newsletter tomorrow{'.' * (i % 3)}"))
    for i in range(12):
        own = ITEMS[i % 3][1].split()
        for at in range(0, i // 3 * 2, 2):
            own[at * 3 % 25] = "new"
        rows.append((8000 + i, f"{clean(50)} {' '.join(own).upper()}. {clean(30)}"))
    junk = " ".join(w + "###" for w in clean(80).split())
    rows += [(9000, clean(60)), (9000, f"{clean(40)} {ITEMS[0][1]}"), (9001, clean(60)), (9001, junk), (None, clean(60)), (None, None),
             (9002, None), (9003, ""), (9004, " \n "), (9005, clean(6000, 15)), (9006, "the word"), (9007, clean(70)), (9007, rows[-1][1])]
    return rows, labels


def normal(line):
    return " ".join(line.lower().split())


def without_similar_lines(rows):
    order = sorted({(d is not None, d or 0, xxhash.xxh64_intdigest(t.encode(), 42) - (xxhash.xxh64_intdigest(t.encode(), 42) >> 63 << 64), t)
                    for d, t in rows if t})
    first, shingled, sets = {}, {}, Sets()
    for has, d, _, t in order:
        for no, line in enumerate(t.split("\n")):
            if own := normal(line):
                first.setdefault(own, (has, d, t, no))
                shingled[own] = {own[i:i + 8] for i in range(max(1, len(own) - 7))}
    places = list(first)                                        # in the order of the first place
    for i, x in enumerate(places):
        for y in places[:i]:
            a, b = shingled[x], shingled[y]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                sets.join(i, places.index(y))
    kept = {first[x] for i, x in enumerate(places) if sets.find(i) == i}
    return [(d, t and "\n".join(line for no, line in enumerate(t.split("\n"))
                                if not normal(line) or (d is not None, d or 0, t, no) in kept)) for d, t in rows]


def without_near_copies(rows):
    prints, sets, first = [brute_fingerprint(t, 5) for _, t in rows], Sets(), {}

    def shingled(t):
        own = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        own = words(own)
        return {tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))}

    for (d, t), fp in zip(rows, prints):
        if d is not None and (fp not in first or d < first[fp][0]):
            first[fp] = d, shingled(t)
    for x in first:
        for y in first:
            a, b = first[x][1], first[y][1]
            if x < y and (x ^ y).bit_count() <= 12 and len(a & b) >= 0.8 * len(a | b):
                sets.join(x, y)
    head = {}
    for x, (d, _) in first.items():
        head[sets.find(x)] = min(d, head.get(sets.find(x), d))
    return [(d, t) for (d, t), fp in zip(rows, prints) if d is None or head[sets.find(fp)] == d]


def holds_an_item(text):
    own = contamination.words_of((text or "").encode())
    for _, item in ITEMS:
        target = contamination.words_of(item.encode())
        if (Counter(own) & Counter(target)).total() * 2 >= len(target) and brute_alignment(target, own) >= len(target):
            return True
    return False


def test_pipeline_against_plain_python(spark, tmp_path):
    rows, labels = fixture()
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # a trained model: planted junk and toxic texts go, no clean one does
    kept = [tuple(r) for r in corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).select("doc_id", "text").collect()]
    gone = counted(rows) - counted(kept)
    bad = {d for d, q, t in labels if t or not q}
    assert not counted(kept) - counted(rows)
    assert all(d in bad or d == 9001 for d, _ in gone) and len({d for d, _ in gone} & bad) > 0.95 * len(bad)
    assert [t for d, t in kept if d == 9001] == [next(t for d, t in rows if d == 9001)]
    lines = without_similar_lines(kept)
    single = without_near_copies(lines)
    want = [(d, t) for d, t in single if d is None or not holds_an_item(t)]
    assert len(lines) - len(single) > 20 and 9 <= len(single) - len(want) and sum(a != b for a, b in zip(kept, lines)) > 14
    assert [t for d, t in want if d == 9000] == [next(t for d, t in rows if d == 9000)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = []
    for d, t in want:
        ids = library.encode(t or "", add_special_tokens=False).ids
        coded.append((d, len(ids), tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def numbers(ids):
        return tuple(memoryview(bytes(ids)).cast("I")) if isinstance(ids, (bytes, bytearray)) else tuple(ids)

    assert counted((r["doc_id"], r["n_tokens"], numbers(r["ids"]), r["decoded_sha256"]) for r in got) == counted(coded)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_row_of_an_id_goes_alone(spark):
    copy, other = clean(60), clean(60)
    left = simhash.keep_one(table(spark, [(1, copy), (2, copy), (2, other), (None, copy)]))
    assert counted(left.select("doc_id", "text").collect()) == counted([(1, copy), (2, other), (None, copy)])
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = contamination.drop_contaminated(table(spark, [(2, ITEMS[1][1]), (2, other), (None, ITEMS[1][1])]), bench)
    assert counted(left.select("doc_id", "text").collect()) == counted([(2, other), (None, ITEMS[1][1])])


# --- seeds of decontamination ---------------------------------------------------

def plain(text):
    return [w.decode() for w in contamination.words_of(text.encode())]


@pytest.mark.parametrize("common", [0, 5, 1000])
def test_short_and_long_items(spark, common):
    rng = random.Random(5)
    long = [f"w{rng.randrange(400)}" for _ in range(300)]
    items = [(1, "Zebra"), (2, "zebra crossing."), (3, " ".join(long)), (4, "..."), (5, None)]
    edited = [w if i % 7 else "new" for i, w in enumerate(long)]
    rows = [(0, clean(40) + " zebra " + clean(40)), (1, clean(20) + "\nZEBRA, crossing! " + clean(9)), (2, " ".join(edited)),
            (3, clean(500) + " " + " ".join(edited) + " " + clean(800)), (4, "crossing zebra"), (5, clean(300)), (6, " ".join(long[:120]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = counted((r["doc_id"], r["item_id"], r["score"]) for r in contamination.contaminated(table(spark, rows), bench, common=common).collect())
    want = {(d, 1): 1.0 for d in (0, 1, 4)} | {(1, 2): 1.0}
    for d, t in rows:
        score = round(brute_alignment(long, plain(t)) / 600, 6)
        if score >= 0.5:
            want[d, 3] = score
    assert got == counted((*k, v) for k, v in want.items()) and {(2, 3), (3, 3)} <= set(want)


def test_recall_of_edited_copies(spark):
    """Copies with up to a fifth of the words exchanged, left out or put in: of those that score 0.5, 0.99 are found."""
    rng = random.Random(9)
    items = [[f"{rng.choice('bcdfg')}{rng.randrange(5000)}" for _ in range(rng.randrange(15, 60))] for _ in range(40)]
    rows = []
    for i in range(1200):
        own = []
        for w in items[i % 40]:
            own += rng.choice([["new"], [], [w, "more"]]) if rng.random() < i % 5 / 20 else [w]
        rows.append((i, f"{clean(30)} {' '.join(own)} {clean(30)}"))
    want = {(d, d % 40) for d, t in rows if brute_alignment(items[d % 40], plain(t)) >= len(items[d % 40])}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(table(spark, rows), bench).collect()}
    assert got <= want and len(got & want) >= 0.99 * len(want) and len(want) > 1000
