"""Small tables and brute-force twins."""

import collections
import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of other types.
CLASH = ["fp", "th", "ats", "at", "key", "component", "line", "n", "k1", "junk", "keep", "place", "start", "nos", "D_", "t_",
         "n_lines", "band", "turn", "toxic", "cell", "item", "grams", "a", "b", "c", "id", "first_id", "head", "template"]


def table(spark, rows, clash=True):
    """Documents from (id, text), with columns of clashing names."""
    if not rows:
        df = spark.createDataFrame([], DOC)
    else:
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)
    if clash:
        for name in CLASH:
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df.repartition(3)


WORDS = [a + b for a in ("ka", "lo", "mi", "su", "ter", "an", "be", "ro") for b in ("no", "ri", "ta", "ve", "x", "qu", "dal", "")]


def prose(rng, n, line=12):
    words = [rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i:i + line]) for i in range(0, n, line))


def corpus(seed=3, n=60):
    """Texts with copies, shared passages, edited lines, and odd ones."""
    rng = random.Random(seed)
    shared = prose(rng, 60)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randrange(5, 150))
        if i % 7 == 0:
            text += "\n" + shared
        if i % 11 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1] or text
        if i % 13 == 0 and rows and rows[-1][1]:
            words = rows[-1][1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        rows.append((i, text))
    long = prose(rng, 3000)
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "word"), (104, "Word"), (105, long), (105, long), (106, long + " end"),
             (107, "two\nlines"), (107, "other text of the same id"), (None, shared), (None, None), (108, shared), (109, "é日本  x y"),
             (110, "a" * 50_000), (111, "a" * 50_000), (112, "b " * 5_000)]
    return rows


class Sets:
    """Union-find; the smallest member stands for its set."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)
