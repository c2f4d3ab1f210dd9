"""Fuzzy line dedup: MinHash over character shingles, verified, one line per component.

Equal lines (white space collapsed, lower case) are one class before anything is
compared. A class has a one-permutation signature of its character shingles, cut into
bands; classes that share a band are candidates. Every member of a band is verified
against the band's first of its batch, and that one against the first of all, with the
Jaccard similarity of all shingles: a band of thousands of similar lines costs one
comparison each, and a row per batch in the shuffle. Where members of a band fail and the
band still holds several components, all but the largest are compared with all members in
tiles of bounded size, which send on the edges of a forest. With 14 bands of 5 rows two
lines of similarity 0.8 share a band with probability 0.996, of 0.9 with 1 - 1e-5.
Components of verified edges keep their first line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlewright.llm.components import components, forest
from candlewright.llm.tables import Scratch, fresh, map_batches, spans

SHINGLE, BANDS, ROWS = 8, 14, 5
#: Lines of a tile's side, about, and characters hashed at once.
TILE, SPAN = 64, 500_000
#: Shingles held against all lines of a batch at once.
COLUMNS = 1 << 14
#: Pairs verified at once; their places have eight bits.
PAIRS = 256
_LINE = "k1 long, k2 long"


def normal(line: str) -> str:
    # of white space, only the space is printable
    if "  " not in line and line.isprintable():
        return line.strip(" ").lower()
    return " ".join(line.split()).lower()


def line_key(line: str) -> tuple[int, int]:
    """Signed halves of a 128-bit hash."""
    h = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def line_keys(lines: Iterable[str]) -> np.ndarray:
    """A row with the ``line_key`` of each line."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(line.encode("utf-8", "surrogatepass")) for line in lines]), "<i8").reshape(-1, 2)


def shingles(line: str, n: int = SHINGLE) -> set[str]:
    """The distinct runs of n characters; a shorter line is its own one."""
    return {line[i:i + n] for i in range(max(1, len(line) - n + 1))}


def jaccard(a: set, b: set, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_shingles(lines: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all lines in a row, repeats included, and how many each line has."""
    padded = [line if len(line) >= n else line.ljust(n, "\0") for line in lines]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    h, width, power = codes.astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
    while width < n:    # n is a power of two
        h = h[:-width] * power + h[width:]
        width, power = 2 * width, np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
    inside = np.ones(len(h), bool)
    ends = np.cumsum(sizes)[:-1]
    for i in range(1, n):
        inside[ends - i] = False
    return _mix(h[inside]), sizes - n + 1


def similar_pairs(lines: list[str], x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs lines[x], lines[y] have a Jaccard similarity of ``least``: exact, by distinct hashed shingles.

    A shingle that two lines or more have is a column of bits; a pair shares the bits that both rows have.
    """
    h, counts = hashed_shingles(lines)
    order = np.argsort(h)
    h, line = h[order], np.repeat(np.arange(len(lines)), counts)[order]
    kind = np.cumsum(np.append(False, h[1:] != h[:-1]))
    cells = np.sort(kind * len(lines) + line)
    cells = cells[np.append(True, cells[1:] != cells[:-1])]
    kind, line = np.divmod(cells, len(lines))
    sizes = np.bincount(line, minlength=len(lines))
    several = np.bincount(kind) > 1
    line, kind = line[several[kind]], (np.cumsum(several) - 1)[kind[several[kind]]]
    near = np.flatnonzero(np.minimum(sizes[x], sizes[y]) >= least * np.maximum(sizes[x], sizes[y]))
    shared = np.zeros(len(near), np.int64)
    for first in range(0, int(several.sum()) if len(near) else 0, COLUMNS):
        i, j = np.searchsorted(kind, [first, first + COLUMNS])
        grid = np.zeros((len(lines), min(COLUMNS, -(-int(kind[j - 1] - first + 1) // 64) * 64)), bool)
        grid[line[i:j], kind[i:j] - first] = True
        bits = np.packbits(grid, axis=1).view(np.uint64)
        for at in range(0, len(near), 4096):
            some = near[at:at + 4096]
            shared[at:at + 4096] += np.bitwise_count(bits[x[some]] & bits[y[some]]).sum(axis=1, dtype=np.int64)
    out = np.zeros(len(x), bool)
    out[near] = (shared >= least * (sizes[x[near]] + sizes[y[near]] - shared)) | (x[near] == y[near])
    return out


def alike(x: list[str], y: list[str], least: float) -> np.ndarray:
    """Which of the pairs x[i], y[i] have a Jaccard similarity of ``least``: exact, by distinct hashed shingles.

    A shingle of a pair is a number of 64 bits, the pair's place (256 pairs at once) above 56 bits of the hash.
    """
    out = []
    for at in range(0, len(x), PAIRS):
        sides = []
        for lines in (x[at:at + PAIRS], y[at:at + PAIRS]):
            h, counts = hashed_shingles(lines)
            cells = np.sort((np.repeat(np.arange(len(counts)), counts).astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8)))
            sides.append(cells[np.append(True, cells[1:] != cells[:-1])])
        n = len(x[at:at + PAIRS])
        own, other = (np.bincount((cells >> np.uint64(56)).astype(np.int64), minlength=n) for cells in sides)
        both = np.sort(np.concatenate(sides))
        shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(56)).astype(np.int64), minlength=n)
        out.append(shared >= least * (own + other - shared))
    return np.concatenate(out) if out else np.zeros(0, bool)


def band_keys(lines: list[str], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys of each line's bands: minima of hashed shingles in bands * rows bins."""
    k, none = bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF)
    least = []
    for part in spans(lines, SPAN):
        h, counts = hashed_shingles(lines[part])
        cell = np.repeat(np.arange(len(counts)) * k, counts)
        cell += ((h >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        own = np.full(len(counts) * k, none)
        np.minimum.at(own, cell, h)
        least.append(own.reshape(-1, k))
    least = np.concatenate(least)
    # an empty bin takes the next one that is not, changed by its distance
    gaps = np.flatnonzero((least == none).any(axis=1))
    own = least[gaps]
    place = np.where(own == none, 2 * k, np.arange(k))
    place = np.concatenate([place, np.minimum(place + k, 2 * k)], axis=1)
    ahead = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :k]
    least[gaps] = np.take_along_axis(own, ahead % k, axis=1) + (ahead - np.arange(k)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    key = np.zeros((len(least), bands), np.uint64)
    for r in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r::rows] + np.arange(bands, dtype=np.uint64))
    return key.view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows are told apart by id and a hash of the text, so rows of one id may differ."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("th"), F.col(text_col).alias("text"))


def _classes(rows: DataFrame) -> DataFrame:
    """(k1, k2, line, first, n) of every distinct line, blank ones left out; first: (doc_id, th, no)."""
    def run(ids: list, ths: list, texts: list) -> Iterator[dict[str, object]]:
        for part in spans(texts):
            seen: dict[str, list] = {}
            for key, th, text in zip(ids[part], ths[part], texts[part]):
                for no, raw in enumerate(text.split("\n") if text else ()):
                    if line := normal(raw):
                        own = seen.get(line)
                        if own is None:
                            seen[line] = [key, th, no, 1]
                            continue
                        own[3] += 1
                        if (key is not None, key or 0, th, no) < (own[0] is not None, own[0] or 0, own[1], own[2]):
                            own[:3] = key, th, no
            keys = line_keys(seen)
            yield {"k1": keys[:, 0], "k2": keys[:, 1], "line": list(seen),
                   **{name: [v[i] for v in seen.values()] for i, name in enumerate(("doc_id", "th", "no", "n"))}}

    found = map_batches(rows, run, f"{_LINE}, line string, doc_id long, th long, no int, n long", "doc_id", "th", "text")
    return found.groupBy("k1", "k2").agg(
        F.min("line").alias("line"), F.min(F.struct("doc_id", "th", "no")).alias("first"), F.sum("n").alias("n"))


def _verified(pairs: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """(id, c, similar) of pairs of classes by their exact similarity."""
    both = pairs.join(lines, "id").join(lines.select(F.col("id").alias("c"), F.col("line").alias("other")), "c")

    def run(ids: list, cs: list, lines: list, others: list) -> Iterator[dict[str, object]]:
        for part in spans([max(pair, key=len) for pair in zip(lines, others)], SPAN):
            yield {"id": ids[part], "c": cs[part], "similar": alike(lines[part], others[part], least)}

    return map_batches(both, run, "id long, c long, similar boolean", "id", "c", "line", "other")


def _similar(x: list[set[int]], y: list[set[int]], x_groups: list[int], y_groups: list[int],
             least: float) -> list[tuple[int, int]]:
    """Places of similar sets of two groups; a large tile counts what they share by a product of 0/1 tables."""
    if len(x) * len(y) <= 256:
        return [(i, j) for i, own in enumerate(x) for j, other in enumerate(y)
                if x_groups[i] != y_groups[j] and jaccard(own, other, least)]
    both = set().union(*x) & set().union(*y)
    column = {h: i for i, h in enumerate(both)}
    has = []
    for sets in (x, y):
        grid = np.zeros((len(sets), len(column)), np.float32)
        for row, own in zip(grid, sets):
            row[[column[h] for h in own & both]] = 1
        has.append(grid)
    shared = has[0] @ has[1].T
    sizes = np.array(list(map(len, x)))[:, None] + np.array(list(map(len, y)))[None, :]
    apart = np.array(x_groups)[:, None] != np.array(y_groups)[None, :]
    return list(zip(*(k.tolist() for k in np.nonzero((shared >= least * (sizes - shared)) & apart))))


def _similar_lines(known: list[str], lefts: list, rights: list, left_groups: list, right_groups: list,
                   least: float) -> Iterator[list[tuple[int, int]]]:
    """The same for the lines of several tiles, all of them ``known``."""
    number = {line: i for i, line in enumerate(known)}
    tiles, x, y = [], [], []
    for left, right, a, b in zip(lefts, rights, left_groups, right_groups):
        i, j = np.nonzero(np.array(a)[:, None] != np.array(b)[None, :])
        tiles.append((i, j))
        x.append(np.array(list(map(number.__getitem__, left)))[i])
        y.append(np.array(list(map(number.__getitem__, right)))[j])
    alike = similar_pairs(known, np.concatenate(x), np.concatenate(y), least)
    for (i, j), own in zip(tiles, np.split(alike, np.cumsum([len(i) for i, _ in tiles])[:-1])):
        yield list(zip(i[own].tolist(), j[own].tolist()))


def across(members: DataFrame, lines: DataFrame, least: float, sets_of: Callable[[list], list[set]] | None = None,
           radius: int | None = None) -> DataFrame:
    """Edges (a, b) between similar ``members`` (band, id, component) of one band and two components.

    All but the largest component of a band are compared with all its members. lines (id, line) has what ``sets_of``
    makes sets of, or else lines, which are compared by their shingles; with a ``radius`` only ids that differ in so many bits at most are linked.
    """
    largest = (members.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band")
               .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("groups"))
               .where("groups > 1").select("band", "main"))
    few = members.join(largest, "band").where("component <> main").drop("main")
    return _tiles(few, members, lines, least, sets_of, radius)


def _tiles(few: DataFrame, members: DataFrame, lines: DataFrame, least: float, sets_of: Callable[[list], list[set]] | None,
           radius: int | None) -> DataFrame:
    """Edges (a, b) between rows of ``few`` and of ``members`` (band, id, component) of one band and two components."""
    sizes = few.groupBy("band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("nf")).join(
        members.groupBy("band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("na")), "band")

    def side(rows: DataFrame, own: str, other: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        spread = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        cells = (block.alias("f"), spread.alias("a")) if own == "nf" else (spread.alias("f"), block.alias("a"))
        return (rows.join(sizes, "band").join(lines, "id")
                .select("band", *cells, F.struct("id", "component", "line").alias("row"))
                .groupBy("band", "f", "a").agg(F.collect_list("row").alias(name)))

    pairs = side(few, "nf", "na", "left").join(side(members, "na", "nf", "right"), ["band", "f", "a"])

    def run(left_ids: list, left_groups: list, lefts: list, right_ids: list, right_groups: list, rights: list) -> dict[str, object]:
        a, b, at = [], [], 0
        while at < len(lefts):
            # lines of many tiles are hashed at once, each of them once
            known: dict[str, None] = {}
            end, compared = at, 0
            while end < len(lefts) and (end == at or len(known) < 4 * TILE and compared < 64 * TILE * TILE):
                known.update(dict.fromkeys(lefts[end]))
                known.update(dict.fromkeys(rights[end]))
                compared += len(lefts[end]) * len(rights[end])
                end += 1
            if sets_of:
                sets = dict(zip(known, sets_of(list(known))))
                found = (_similar([sets[x] for x in lefts[k]], [sets[x] for x in rights[k]], left_groups[k], right_groups[k], least)
                         for k in range(at, end))
            else:
                found = _similar_lines(list(known), lefts[at:end], rights[at:end], left_groups[at:end], right_groups[at:end], least)
            for k, pairs in enumerate(found, at):
                for i, j in pairs:
                    x, y = left_ids[k][i], right_ids[k][j]
                    if radius is None or ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius:
                        a.append(x)
                        b.append(y)
            at = end
        child, root = forest(a, b)
        return {"a": child, "b": root}

    # lists of numbers and of lines, not of rows: a row would be a dictionary in Python
    parts = {f"{side}_{c}": F.col(f"{side}.{c}") for side in ("left", "right") for c in ("id", "component", "line")}
    return map_batches(pairs.select(*(c.alias(name) for name, c in parts.items())), run, "a long, b long", *parts)


def similar_lines(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                  scratch: Scratch | None = None) -> DataFrame:
    """(k1, k2, keep) of every line that is there more than once or has a similar one.

    k1 and k2 are ``line_key`` of the normalised line, keep is (doc_id, th, no) of the first line of its component.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    classes = scratch.put(_classes(_keyed(docs, id_col, text_col)).withColumn("id", F.monotonically_increasing_id()),
                          "classes")

    def sign(ids: list, lines: list) -> Iterator[dict[str, object]]:
        for part in spans(lines, 8 * SPAN):
            keys = band_keys(lines[part])
            own = np.repeat(np.array(ids[part], np.int64), keys.shape[1])
            band = keys.ravel() & ~1
            order = np.lexsort((own, band))
            band, own = band[order], own[order]
            new = np.concatenate(([True], band[1:] != band[:-1]))
            first = own[np.flatnonzero(new)[np.cumsum(new) - 1]]
            # the others of a band have their candidate already and travel under a key of their own, an odd one;
            # a window by one number is sorted by radix
            key = np.where(new, band, _mix((band + own * 2654435761).view(np.uint64)).view(np.int64) | 1)
            yield {"key": key, "band": band, "id": own, "c": np.where(new, -1, first)}

    signed = map_batches(classes, sign, "key long, band long, id long, c long", "id", "line")
    first = F.when(F.col("c") >= 0, F.col("c")).otherwise(F.min("id").over(Window.partitionBy("key")))
    pairs = scratch.put(signed.withColumn("c", first).where("id <> c").select("band", "id", "c"), "pairs")
    # the lines that are compared at all, so that the others move once
    used = pairs.select("id").union(pairs.select("c")).distinct()
    lines = scratch.put(classes.select("id", "line").join(used, "id", "left_semi"), "lines")
    checked = scratch.put(_verified(pairs.select("id", "c").distinct(), lines, least), "checked")
    edges = checked.where("similar").select(F.col("id").alias("a"), F.col("c").alias("b"))
    failed = pairs.join(checked.where("NOT similar"), ["id", "c"]).select("band", "id")
    bands = scratch.put(failed.select("band").distinct(), "failed")
    found = components(edges, scratch)
    if not bands.isEmpty():
        # bands that hold more than one component yet: all but the largest component against all members
        found = scratch.put(found, "found")
        members = pairs.select("band", "id").union(pairs.select("band", "c")).distinct().join(bands, "band", "left_semi")
        members = scratch.put(members.join(found.withColumnRenamed("node", "id"), "id", "left").select(
            "band", "id", F.coalesce("component", "id").alias("component")), "in-bands")
        tiles = scratch.put(across(members, lines, least), "tiles")
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(tiles), scratch, "all")
    members = classes.join(found.withColumnRenamed("node", "id"), "id", "left").where("n > 1 OR component IS NOT NULL")
    members = scratch.put(members.select("k1", "k2", "first", F.coalesce("component", "id").alias("component")), "members")
    keeps = members.groupBy("component").agg(F.min("first").alias("keep"))
    out = scratch.put(members.join(keeps, "component").select("k1", "k2", "keep"), "keeps")
    scratch.drop("classes", "lines", "pairs", "checked", "failed", "found", "in-bands", "tiles", "members")
    return out


def dedup_lines(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the text less every line that is similar to an earlier one, and n_lines, n_removed behind.

    Similar: a Jaccard similarity of ``least`` or more of the sets of 8-character shingles, white space
    collapsed and case ignored, or a chain of such lines. The first line of a component by (id, hash of the
    text, place) stays, null ids first. Blank lines stay; a null text stays null and has no lines; rows equal in
    id and text keep the same lines. A text may end up empty; its row stays.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    keeps = similar_lines(docs, least, id_col, text_col, scratch)

    def places(ids: list, ths: list, texts: list) -> Iterator[dict[str, object]]:
        for part in spans(texts):
            found, nos, rows = [], [], []
            for row, text in enumerate(texts[part], part.start):
                own = [(no, line) for no, raw in enumerate(text.split("\n") if text else ()) if (line := normal(raw))]
                nos += [no for no, _ in own]
                found += [line for _, line in own]
                rows += [row] * len(own)
            keys = line_keys(found)
            yield {"k1": keys[:, 0], "k2": keys[:, 1], "doc_id": [ids[row] for row in rows], "th": [ths[row] for row in rows], "no": nos}

    seen = map_batches(_keyed(docs, id_col, text_col), places, f"{_LINE}, doc_id long, th long, no int",
                       "doc_id", "th", "text")
    gone = (seen.join(keeps, ["k1", "k2"]).where(~F.struct("doc_id", "th", "no").eqNullSafe(F.col("keep")))
            .groupBy("doc_id", "th").agg(F.collect_set("no").alias("nos")))
    names = {n: fresh(n, docs.columns) for n in ("d_", "t_", "nos", "n_lines", "n_removed")}
    gone = gone.select(F.col("doc_id").alias(names["d_"]), F.col("th").alias(names["t_"]), F.col("nos").alias(names["nos"]))
    text, nos = F.col(text_col), F.col(names["nos"])
    cut = F.split(text, "\n")
    kept = F.array_join(F.filter(cut, lambda line, i: ~F.array_contains(nos, i.cast("int"))), "\n")
    joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(names["d_"]))
                       & (F.coalesce(F.xxhash64(text_col), F.lit(0)) == F.col(names["t_"])), "left")
    return joined.select(
        *(F.when(nos.isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns),
        F.when(text.isNull() | (text == ""), 0).otherwise(F.size(cut)).cast("long").alias(names["n_lines"]),
        F.when(nos.isNull(), 0).otherwise(F.size(nos)).cast("long").alias(names["n_removed"]))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept and removed of every document, with the digest of its text without the latter."""
    got = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed",
                      F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
