"""Ranked search, spelling variants and exact top-k against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from holdfast.llm import lexical_search as L
from holdfast.llm import spelling as S
from holdfast.llm import topk_search as K

from .helpers import AWKWARD, near_copies, table, tuples


def terms_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_search(rows, items, k):
    held = [(d, Counter(terms_of(t))) for d, t in rows]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m, score = 10 + 90 * sum(c.values()) * n // total, 0
            for t in set(terms_of(text)) & set(c):
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "A b w17 w4500 c"), (1, "b"), (2, None), (3, "?!"), (None, "only here É"), (4, "one two x"), (5, "nowhere"), (6, "日本 𝒳 a a a")]


@pytest.mark.parametrize("shard_terms", [5, 4_000_000])
def test_ranked_search_equals_brute_force(spark, monkeypatch, shard_terms):
    monkeypatch.setattr(L, "QUERIES", 3)
    build = L.build_index
    monkeypatch.setattr(L, "build_index", lambda docs: build(docs, shard_terms))
    rows = [(d, t and t.replace("\u000b", "\n")) for d, t in AWKWARD] + near_copies(150, 5)
    items = spark.createDataFrame(ITEMS + [(7, t) for _, t in near_copies(4, 5)], "item_id long, text string").withColumns({"rank": F.lit(0), "doc_id": F.lit(3)})
    got = L.ranked(table(spark, rows), items, 4)
    assert tuples(got, "item_id", "rank", "doc_id", "score") == brute_search(rows, [(r["item_id"], r["text"]) for r in items.collect()], 4)
    monkeypatch.setattr(L, "BROADCAST_TERMS", 0)  # salted join instead
    assert tuples(L.ranked(table(spark, rows), items, 4), *got.columns) == tuples(got, *got.columns)
    assert L.ranked(table(spark, []), items).count() == 0 == L.ranked(table(spark, rows), items.limit(0)).count()


def test_the_merge_with_bounds_equals_a_full_sort():
    r = random.Random(1)
    for _ in range(300):
        lists, scores = [], Counter()
        for _ in range(r.randint(1, 6)):
            docs = sorted(r.sample(range(60), r.randint(1, 40)))
            gives = [r.choice((1, 5, 5, r.randint(1, 90))) for _ in docs]
            lists.append((max(gives), docs, gives))
            scores.update(dict(zip(docs, gives, strict=True)))
        want = sorted(((s, d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))
        assert L.best(lists, 5) == want[:5]


def test_packed_integers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 5], np.int64)
    data, sizes = L.packed(values)
    assert L.unpacked(data.tobytes()).tolist() == values.tolist() and sizes.tolist() == [1, 1, 1, 2, 2, 3, 5, 6, 1]


def brute_variants(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    beside = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(v, w)] for w in n}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], len(beside[w]), form[w] and n[form[w]]) for w in n), key=str)


def misspelled(seed):
    r = random.Random(seed)
    bases, rows = ["collection", "Ünïversity", "aabbaabb", "catalogue", "\u00d7\u00f7aeiouy", "x" * 63 + "yz", "q" * 130], []
    for i in range(900):
        out = []
        for _ in range(r.randint(1, 6)):
            w = list(r.choice(bases) if r.random() < 0.97 else r.choice(bases[:2]).upper())
            for _ in range(r.choice((0, 0, 0, 0, 0, 0, 1, 2))):
                p = r.randrange(len(w))
                w[p : p + r.randint(0, 1)] = r.choice(("", "a", "b", "e"))
            out.append("".join(w))
        rows.append((i, r.choice((" ", "-", "1", "\u4e2d")).join(out)))
    chain = ["chainlinks"] * 400 + ["chainlink"] * 30 + ["chainlin"] * 2
    return rows + [(2000 + i, w) for i, w in enumerate(chain)]


def test_spelling_variants_equal_brute_force(spark):
    rows = AWKWARD + misspelled(2) + [(None, "collecton Collection"), (None, None)]
    want = brute_variants(rows)
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    assert sum(1 for w in want if w[1]) > 50 and ("chainlin", "chainlink", "chainlinks") in {w[:3] for w in want} and any(len(w[0]) > 100 and w[4] for w in want)
    assert tuples(S.variants(table(spark, rows)), *columns) == want
    assert S.variants(table(spark, [])).count() == 0 == S.variants(table(spark, [(1, None), (2, "short")])).count()


def test_colliding_keys_are_told_apart_by_their_strings():
    n = {"abcdefg": 5, "abcdefgh": 3, "xbcdefg": 9, "ybcdefg": 9, "aabcdefg": 2, "unrelated": 8}
    rows = [(7, p, bool(p <= 0 or w[p] != w[p - 1]), w, n[w]) for w in n for p in range(-1, len(w))]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "place", "new", "word", "n"), r, strict=True)) for r in rows[i : i + 5]]) for i in range(0, len(rows), 5)]
    near, best = Counter(), {}
    for r in (r for b in S._grouped(iter(batches)) for r in b.to_pylist()):
        near[r["word"]] += r["near"]
        best[r["word"]] = min(best.get(r["word"], (0, "")), (r["minus"], r["other"]))
    assert dict(near) == {"abcdefg": 4, "abcdefgh": 1, "xbcdefg": 2, "ybcdefg": 2, "aabcdefg": 1}
    assert best["abcdefg"] == (-9, "xbcdefg") and best["xbcdefg"] == (-9, "ybcdefg") and best["aabcdefg"] == (-5, "abcdefg")


def test_words_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(S, "HELD", 2)
    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "Anotherword anotherword secondword"}, {"doc_id": 2, "text": "anotherword"}])
    monkeypatch.setattr(S, "chunks", lambda texts, size: [slice(i, i + 1) for i in range(len(texts))])
    total = Counter()
    parts = list(S._counted(iter([batch, batch])))
    for r in (r for b in parts for r in b.to_pylist()):
        total[r["word"]] += r["n"]
    assert len(parts) > 2 and total == {"anotherword": 6, "secondword": 2}


def test_rolling_hashes_are_those_of_the_deletions():
    terms = ["abcdefg", "abdefg", "aabbcc", "bcdefg"]
    of, place, new, left, key = S.deletion_keys(terms)
    rest = [terms[o] if p < 0 else terms[o][:p] + terms[o][p + 1 :] for o, p in zip(of, place, strict=True)]
    assert [len(x) for x in rest] == left.tolist()
    assert len(set(rest)) == len(set(key.tolist())) == len(set(zip(rest, key.tolist(), strict=True)))
    assert [bool(x) for o, p, x in zip(of, place, new, strict=True) if o == 2 and p >= 0] == [True, False] * 3


def brute_top(rows, k):
    held = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(held):
        if q is not None and q % 50 == 0:
            s = [(-sum(x * y for x, y in zip(v, w, strict=False)), i is None, i or 0, i) for b, (i, w) in enumerate(held) if a != b]
            out += [(q, n + 1, i, -score) for n, (score, _, _, i) in enumerate(sorted(s, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("values", [7, 100, 1 << 18])
@pytest.mark.parametrize("scale", [1.0, 3e6])
def test_top_k_equals_brute_force(spark, monkeypatch, values, scale):
    r = random.Random(4)
    rows = [(i, [r.choice((-0.5, 0.25, 0.0, r.uniform(-1, 1))) * scale for _ in range(4)]) for i in range(0, 400, 5)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(1000, 1100, 2)]  # copies, many of them queries or ties
    rows += [(50, None), (100, [None, 1.0, 1.0, 1.0]), (150, [float("nan")] * 4), (7, [float("-inf"), 0.0, 0.0, 0.0]), (200, [0.9, 0.9]), (250, []), (None, [0.5] * 4), (300, [1.0, 1.0, 1.0, 1.0, 1.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"rank": F.lit(0), "shard": F.lit(0), "ids": F.lit("x")})
    build = K.build_index
    monkeypatch.setattr(K, "build_index", lambda v: build(v, values, 4))
    columns = ["query_id", "rank", "vec_id", "score"]
    assert tuples(K.top_k(df, 50, 5), *columns) == brute_top(rows, 5)
    monkeypatch.setattr(K, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(K, "QUERIES", 3)
    assert tuples(K.top_k(df, 50, 5), *columns) == brute_top(rows, 5)


def test_top_k_of_few_or_no_vectors(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert K.top_k(one).count() == 0 == K.top_k(one.limit(0)).count()
    two = one.unionByName(spark.createDataFrame([(1, [-1e300])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in K.top_k(two).collect()] == [(0, 1, 1, -K.LIMIT - 1)]


def test_blocks_that_cannot_hold_a_result_are_left_out(monkeypatch):
    r = np.random.default_rng(0)
    centres = r.integers(-100, 100, (40, 8))
    vectors = np.concatenate([c + r.integers(-3, 4, (32, 8)) for c in centres])
    order, at = K.alike(vectors, 32), np.arange(0, len(vectors), 32)
    v = vectors[order]
    shard = K.Shard(1, 32, 8, "<i8", list(range(len(v))), v.tobytes(), np.maximum.reduceat(v, at).tobytes(), np.minimum.reduceat(v, at).tobytes())
    scored = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                scored.append(len(key))
            return np.ndarray.__getitem__(self, key)

        def astype(self, kind):
            return np.asarray(self).astype(kind).view(Counted)

    shard.vectors = shard.vectors.view(Counted)
    [(held, scores)] = shard.search(v[:1], shard.rows[:1], [None], 5)
    assert sorted((v[1:] @ v[0]).tolist())[-5:] == sorted(scores) and sum(scored) < len(v) / 2
