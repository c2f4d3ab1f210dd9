"""Weak-label classifier: labellers, their accuracies by EM, a hashed linear scorer.

For each fault (junk, toxic language) several labellers say fault, no fault or nothing.
Their votes on all documents make a table of patterns, which has at most 3^labellers rows
whatever the corpus; expectation-maximisation on the counts estimates how often a
labeller says what about either class, and so the probability of the fault given a
pattern. Those posteriors are the labels of a logistic scorer over hashed words, word
beginnings and word ends, fitted on a bounded sample. The scorer decides.

Word lists that labellers use beside the fixed ones are learned from a bounded sample of
labelled rows, where a label table is given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.tables import Scratch, map_batches, spans, without_rows

#: Documents the scorer is fitted on at most, labelled rows that word lists are learned from, words of a list.
FITTED, LABELLED, LEARNED = 12_000, 20_000, 5_000
#: Hashed features.
BITS = 18
FAULT, FINE, SILENT = 1, 0, -1
JUNK = ("symbols", "symbol_words", "capitals", "exclamations", "stutter", "stopwords", "word_length", "repeated_lines",
        "vocabulary", "any_shape")
TOXIC = ("insults", "learned_words", "learned_stems", "any_list")
#: Common words of four languages, and insults.
STOPWORDS = frozenset((
    "the of and to in a is that it for on was be with as by this are or from at an have not "
    "de la le les des et en un une que qui dans pour est pas sur au plus par "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch "
    "el los las y del se una con no su para es al lo como").encode().split())
INSULTS = frozenset((
    "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile bastard "
    "asshole bitch retard dumbass cretin").encode().split())
_SYMBOLS = b"#$%&*|<>{}[]\\^~=_@+"
_SYMBOL_RUN = re.compile(rb"[#$%&*|<>{}\[\]\\^~=_@+]+")
_SPACED = bytes.maketrans(b".,;:!?\"()'", b" " * 10)
_CAPITALS = bytes(range(65, 91))
#: Words that stand for a repeated exclamation mark, for a text in capitals and for one that repeats words.
_LOUD, _CAPITAL, _STUTTER = b"\x02", b"\x03", b"\x04"


def capitals(text: bytes) -> float:
    """Share of A-Z in the bytes that are not white space."""
    return (len(text) - len(text.translate(None, _CAPITALS))) / max(1, len(text) - text.count(b" "))


def stutter(words: list[bytes]) -> float:
    """Share of words that are the same as the one before."""
    return sum(map(eq, words, words[1:])) / max(1, len(words) - words.count(_LOUD))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words without punctuation, and the words for a shape, if there are at least 5."""
    if not text:
        return []
    words = text.lower().replace(b"!!", b" \x02 ").translate(_SPACED).split()
    if len(words) < 5:
        return words
    shapes = [w for w, seen in ((_CAPITAL, capitals(text) >= 0.3), (_STUTTER, stutter(words) >= 0.2)) if seen]
    return [*words, *shapes]


def junk_votes(text: bytes | None, words: list[bytes]) -> list[int]:
    """A vote of every labeller in JUNK; the shares of short texts say nothing.

    The last hears any of those that look for a shape, as they look for different ones.
    """
    if not words:
        return [SILENT] * len(JUNK)

    def vote(value: float, fine: float, fault: float) -> int:
        low, high = min(fine, fault), max(fine, fault)
        side = FINE if (value <= fine if fine < fault else value >= fine) else FAULT
        return SILENT if low < value < high else side

    n, size = len(words), max(1, len(text) - text.count(b" "))
    symbols = (len(text) - len(text.translate(None, _SYMBOLS))) / size
    out = [vote(symbols, 0.01, 0.05), vote(len(_SYMBOL_RUN.findall(text)) / n, 0.05, 0.2)]
    out += [SILENT] * 3 if n < 5 else [
        vote(capitals(text), 0.12, 0.3), vote(words.count(_LOUD) / n, 0.01, 0.1), vote(stutter(words), 0.05, 0.2)]
    if n < 20:
        out += [SILENT] * 4
    else:
        lines = [line for line in text.split(b"\n") if line]
        out += [
            vote(sum(map(STOPWORDS.__contains__, words)) / n, 0.1, 0.04), FINE if 3 <= sum(map(len, words)) / n <= 11 else FAULT,
            vote(1 - len(set(lines)) / len(lines), 0.2, 0.5) if len(lines) > 3 else SILENT,
            vote(len(set(words)) / n ** 0.8, 0.6, 0.15)]
    return [*out, max(*out[:5], *out[7:])]


def toxic_votes(own: set[bytes], learned: frozenset[bytes], stems: frozenset[bytes]) -> list[int]:
    """A vote of every labeller in TOXIC; the last hears any of the lists, as they look for different words."""
    def seen(words: frozenset[bytes], has: set[bytes]) -> int:
        return SILENT if not words or not has else FINE if words.isdisjoint(has) else FAULT
    votes = [seen(INSULTS, own), seen(learned, own), seen(stems, {w[:5] for w in own if len(w) > 5})]
    return [*votes, max(votes)]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability of the fault for each pattern of votes (-1, 0, 1), from how often each pattern occurs.

    A labeller that says nothing counts for nothing. To begin with, a voice for the fault is heard. A small
    prior count keeps a labeller from being certain.
    """
    said = np.stack([(patterns == v).astype(float) for v in (FINE, FAULT)], axis=2)
    for_fault, spoken = said[:, :, 1].sum(axis=1), np.maximum(1, said.sum(axis=(1, 2)))
    # one voice against several that see nothing is heard: labellers look for different faults
    post = np.clip(np.where(for_fault > 0, 0.5 + 0.4 * for_fault / spoken, 0.05), 0.02, 0.98)
    for _ in range(rounds):
        prior = np.clip((counts * post).sum() / counts.sum(), 1e-4, 1 - 1e-4)
        total = []
        for weight in (counts * (1 - post), counts * post):
            rate = np.einsum("p,plv->lv", weight, said) + 0.5
            total.append(np.einsum("plv,lv->p", said, np.log(rate / rate.sum(axis=1, keepdims=True))))
        odds = np.log(prior / (1 - prior)) + total[1] - total[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


def features(words: list[bytes]) -> np.ndarray:
    """Hashed features a text has: its words, their first five and their last two bytes."""
    own = set(words)
    raw = [*map(crc32, own), *(crc32(w[:5], 1) for w in own if len(w) > 5), *(crc32(w[-2:], 2) for w in own if len(w) > 2)]
    return np.unique(np.array(raw, np.int64) & ((1 << BITS) - 1))


def fit(rows: list[np.ndarray], labels: np.ndarray, least: int = 10, sure: float = 5.0,
        rounds: int = 300) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, features, weights) of a logistic scorer; features that tell nothing about the labels are left out."""
    n, p = max(1, len(rows)), float(np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6))
    bias = np.log(p / (1 - p))
    flat = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), list(map(len, rows)))
    seen = np.bincount(flat, minlength=1 << BITS)
    bad = np.bincount(flat, labels[owner], minlength=1 << BITS)
    z = (bad - seen * p) / np.sqrt(np.maximum(seen, 1) * p * (1 - p))
    chosen = np.flatnonzero((seen >= least) & (np.abs(z) >= sure))
    if not len(chosen):
        return bias, chosen, np.zeros(0)
    slot = np.full(1 << BITS, -1)
    slot[chosen] = np.arange(len(chosen))
    keep = slot[flat] >= 0
    owner, flat = owner[keep], slot[flat[keep]]
    weights, scale_w, scale_b = np.zeros(len(chosen)), np.full(len(chosen), 1e-8), 1e-8
    for _ in range(rounds):
        score = bias + np.bincount(owner, weights[flat], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(score, -40, 40))) - labels
        step_w = np.bincount(flat, error[owner], minlength=len(chosen)) / n + 1e-5 * weights
        step_b = error.mean()
        scale_w, scale_b = scale_w + step_w ** 2, scale_b + step_b ** 2
        weights -= 0.3 * step_w / np.sqrt(scale_w)
        bias -= 0.3 * step_b / np.sqrt(scale_b)
    return bias, chosen, weights


def _learn_words(rows: DataFrame, labels: DataFrame, labelled: int) -> tuple[frozenset[bytes], frozenset[bytes]]:
    """Words and five-byte beginnings that at least 10 toxic and almost no other labelled text has."""
    sample = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(labelled))
    # at most ``labelled`` rows of two numbers
    texts = rows.join(F.broadcast(sample), "doc_id")

    def count(toxic: list, texts: list) -> Iterator[dict[str, object]]:
        seen: dict[tuple[bool, bytes], list[int]] = {}
        for bad, text in zip(toxic, texts):
            own = set(words_of(text))
            for key in [*((False, w) for w in own), *{(True, w[:5]) for w in own if len(w) > 5}]:
                seen.setdefault(key, [0, 0])[1 if bad else 0] += 1
        yield {"stem": [k[0] for k in seen], "word": [k[1] for k in seen],
               "clean": [v[0] for v in seen.values()], "toxic": [v[1] for v in seen.values()]}

    counts = (map_batches(texts, count, "stem boolean, word binary, clean long, toxic long", "toxic", "text")
              .groupBy("stem", "word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
              .where("toxic >= 10 AND clean <= 0.02 * toxic").orderBy(F.desc("toxic"), "stem", "word").limit(2 * LEARNED))
    found = [(r["stem"], bytes(r["word"])) for r in counts.collect()]
    return (frozenset(w for stem, w in found if not stem), frozenset(w for stem, w in found if stem))


def score(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
          fitted: int = FITTED, labelled: int = LABELLED, scratch: Scratch | None = None, hashes: bool = False) -> DataFrame:
    """(doc_id, junk, toxic, junk_posterior, toxic_posterior, keep) of every row of ``docs``.

    junk and toxic are the scorers' probabilities, the posteriors those of the labellers' votes; keep is
    false where a scorer gives 0.5 or more. ``labels`` (doc_id, toxic) may be left out, and ids it lacks or
    has twice do no harm. ``fitted`` documents, those of the smallest hashes of their ids, fit the scorers, and
    ``labelled`` rows of ``labels``, chosen alike, the word lists. A null or empty text gets no votes and the score
    of no features, and is kept. ``hashes`` adds th, the hash of the row's text.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "labelling")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                       F.xxhash64(F.col(id_col).cast("long")).alias("turn"))
    learned, stems = _learn_words(rows, labels, labelled) if labels is not None else (frozenset(), frozenset())
    last = rows.select("turn").orderBy("turn").limit(fitted).agg(F.max("turn")).first()[0]

    def vote(ids: list, turns: list, texts: list) -> Iterator[dict[str, object]]:
        for part in spans(texts):
            junk, toxic, own = [], [], []
            for turn, text in zip(turns[part], texts[part]):
                words = words_of(text)
                junk.append(junk_votes(text, words))
                toxic.append(toxic_votes(set(words), learned, stems))
                own.append(features(words) if turn <= last else None)
            yield {"turn": turns[part], "junk": junk, "toxic": toxic, "features": own}

    votes = scratch.put(map_batches(rows, vote, "turn long, junk array<int>, toxic array<int>, features array<int>",
                                    "doc_id", "turn", "text"), "votes")
    # at most ``fitted`` rows of hashed features, as arrays
    sample = votes.where("features IS NOT NULL").orderBy("turn", "junk", "toxic").limit(fitted).toArrow()
    owned = [row.values.to_numpy() for row in sample.column("features")]
    models, posteriors = [], []
    for name in ("junk", "toxic"):
        table = votes.groupBy(name).count().orderBy(name).collect()
        patterns = np.array([r[0] for r in table]) if table else np.zeros((0, 1), int)
        post = expectation_maximisation(patterns, np.array([r[1] for r in table], float)) if table else np.zeros(0)
        known = {tuple(p): float(v) for p, v in zip(patterns.tolist(), post)}
        # a text without votes tells nothing
        known = {p: 0.0 if set(p) == {SILENT} else v for p, v in known.items()}
        models.append(fit(owned, np.array([known[tuple(v)] for v in sample.column(name).to_pylist()])))
        posteriors.append(known)

    def judge(ids: list, ths: list, texts: list) -> Iterator[dict[str, object]]:
        tables = []
        for bias, chosen, weights in models:
            table = np.zeros(1 << BITS)
            table[chosen] = weights
            tables.append((bias, table))
        for part in spans(texts):
            out: dict[str, list] = {k: [] for k in ("doc_id", "th", "junk", "toxic", "junk_posterior", "toxic_posterior")}
            for key, th, text in zip(ids[part], ths[part], texts[part]):
                words = words_of(text)
                own = features(words)
                found = [round(float(1 / (1 + np.exp(-np.clip(b + t[own].sum(), -40, 40)))), 6) for b, t in tables]
                cast = tuple(junk_votes(text, words)), tuple(toxic_votes(set(words), learned, stems))
                for column, value in zip(out, (key, th, *found, *(round(p[v], 6) for p, v in zip(posteriors, cast)))):
                    out[column].append(value)
            yield out

    scored = map_batches(rows.withColumn("th", F.xxhash64("text")), judge, "doc_id long, th long, junk double, toxic double, "
                         "junk_posterior double, toxic_posterior double", "doc_id", "th", "text")
    scored = scored.withColumn("keep", (F.col("junk") < 0.5) & (F.col("toxic") < 0.5))
    return scored if hashes else scored.drop("th")


def drop_rejected(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """``docs`` without the rows that ``score`` rejects; all columns stay, and so do rows without id.

    Rows that share an id are told apart by the hash of their text.
    """
    return without_rows(docs, score(docs, labels, id_col, text_col, hashes=True, **options).where("NOT keep"), id_col, text_col)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and decision of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
