"""Small tables with awkward rows, and plain brute-force versions."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i}" for i in range(9000))

#: Nulls, empty and blank texts, repeated rows, ties, a very long text and a near copy of it.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f g h i j k"), (4, "a b c d e f g h i j k"),
    (5, "a  b\nc d e f g h\u000bi j k"), (None, "a b c d e f g h i j k"), (None, "only here"), (6, LONG),
    (7, LONG.replace("w4500 ", "x ")), (8, "one"), (9, "ONE"), (10, "one two"), (11, "a b É é 日本 𝒳 z"),
]


def table(spark, rows, parts=3):
    """documents with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    clash = {c: F.lit(c) for c in ("h", "name", "block", "n", "key", "node", "label", "score", "tokens", "shard", "copy", "item_id", "pos")}
    return df.withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") % 3 > 0, "web").otherwise("books"), "n_chars": F.length("text").cast("long"), **clash})


def near_copies(n: int, seed: int, words: int = 40) -> list[tuple[int, str]]:
    """Texts of which most are copies of few bases with some words changed: many pairs about the threshold."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyzuvw") + str(r.randint(0, 30))
    bases = [[word() for _ in range(r.randint(3, words))] for _ in range(max(2, n // 12))]
    out = []
    for i in range(n):
        text = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 1, 2, 3, 6))):
            text[r.randrange(len(text))] = word()
        out.append((i + 1, " ".join(text)))
    return out


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, k):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def similar(a, b, percent=80):
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


def brute_components(rows, k):
    """[(doc_id, n_shingles, component_id)], by all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            root = find(i)
            least[root] = min(least.get(root, doc_id), doc_id)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
