"""What line deduplication joins and names stays in proportion to its rows where lines are near copies of one another."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from holdfast.llm import line_dedup as L
from holdfast.llm.common import Words

from .helpers import near_copies, similar, words_of


def test_a_group_of_near_copies_names_one_candidate_a_class_and_bucket():
    r = random.Random(6)
    base = [f"word{i}" for i in range(40)]
    lines = []
    for i in range(1500):
        own = list(base)
        for _ in range(2):
            own[r.randrange(40)] = f"x{i}y{r.randrange(9)}"
        lines.append(" ".join(own))
    raw = [x.encode() for x in lines]
    found = Words(raw)
    words, owner, _ = L.line_sets(found, len(raw), np.zeros((2, L.COUNTERS), np.uint8))
    n = np.bincount(owner, minlength=len(raw))
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    prefix = place < (n - -(-80 * n // 100) + 1)[owner]
    key, seq, at = words[prefix].view(np.int64), owner[prefix], place[prefix]
    order = np.lexsort((at, n[seq], key))
    key, seq, at = key[order], seq[order], at[order]
    m1, m2 = L.parities(words, n)
    zero = np.zeros(len(key), np.int64)
    b, a, _, _ = L.likely(key, zero, zero - 1, seq, n[seq], at, m1[seq], m2[seq], 80)
    assert len(b) <= L.FEW * len(key) and (seq[a] < seq[b]).all()
    # every line but the first has a similar earlier one, and some bucket names one, by either way of looking
    sets = [set(words_of(x)) for x in lines]
    similar_one = lambda pairs: {i for i, j in pairs if similar(sets[i], sets[j])}
    assert len(similar_one(zip(seq[b].tolist(), seq[a].tolist(), strict=True))) == len(lines) - 1
    order = np.lexsort((seq, key))
    key, seq, at = key[order], seq[order], at[order]
    b, a = L.nearest(key, zero, zero - 1, seq, seq, n[seq], at, m1[seq], m2[seq], zero + (1 << 62), zero, L.FEW, 80)
    assert len(b) <= L.FEW * len(key) and (seq[a] < seq[b]).all()
    assert len(similar_one(zip(seq[b].tolist(), seq[a].tolist(), strict=True))) == len(lines) - 1


def test_word_hashes_and_digests():
    texts = ["", " ", "a", "A  b\tc\n", "exactly8 exactly9! " + "long" * 40, "é 日本語 𝒳", "a b c", "c b a", "a  b c "]
    found = Words([t.encode() for t in texts])
    assert [(int(o), bytes(found.data[s:e]).decode()) for o, s, e in zip(found.owner, found.start, found.end, strict=True)] == [(i, w) for i, t in enumerate(texts) for w in words_of(t)]
    of_word = {}
    for h, s, e in zip(found.hashes.tolist(), found.start, found.end, strict=True):
        assert of_word.setdefault(bytes(found.data[s:e]), h) == h
    assert len(set(of_word.values())) == len(of_word)
    same = {}
    for t, d in zip(texts, found.digests(len(texts)).tolist(), strict=True):
        assert same.setdefault(tuple(words_of(t)), d) == d
    assert len({tuple(d) for d in same.values()}) == len(same)


def _posted(lines, ranks):
    """The postings of lines, each a class of its own, as a sorted Arrow table."""
    found = Words([x.encode() for x in lines])
    words, owner, _ = L.line_sets(found, len(lines), ranks)
    n = np.bincount(owner, minlength=len(lines))
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    prefix = place < (n - -(-80 * n // 100) + 1)[owner]
    m1, m2 = L.parities(words, n)
    seq = owner[prefix]
    size = (n[seq] << 32) + place[prefix]
    t = pa.table({"key": words[prefix].view(np.int64), "seq": seq, "f1": seq * 7, "size": size, "m1": m1[seq], "m2": m2[seq]})
    return t.sort_by([("key", "ascending"), ("size", "ascending")])


@pytest.mark.parametrize(("tile", "block"), [(1 << 18, None), (700, None), (700, 2)])
def test_links_of_near_copies_are_counted_by_class_not_by_pair(monkeypatch, tile, block):
    """Rows stay in proportion to the postings in a group of near copies, and no link is lost or counted twice, whole
    buckets or tiles, cut buckets or not."""
    monkeypatch.setattr(L, "TILE", tile)
    r = random.Random(8)
    base = [f"word{i}" for i in range(30)]
    lines = []
    for i in range(150):
        own = list(base)
        for _ in range(r.choice((1, 2, 3, 5))):
            own[r.randrange(30)] = f"x{r.randrange(40)}"
        lines.append(" ".join([*own, f"only{i}"][: r.choice((28, 31))]))
    lines += [t for t in dict.fromkeys(t for _, t in near_copies(120, seed=4, words=14)) if t not in lines]
    ranks = np.zeros((2, L.COUNTERS), np.uint8)
    posted = _posted(lines, ranks)
    if block:  # each bucket cut into blocks of which each two meet once
        cut = []
        for row in posted.to_pylist():
            own = row["seq"] % block
            cut += [row | {"group": min(own, o) * block + max(own, o) + 1, "side": -1 if own == o else int(own > o)} for o in range(block)]
        posted = pa.Table.from_pylist(cut).sort_by([("key", "ascending"), ("group", "ascending"), ("size", "ascending")])
    met = pa.Table.from_batches(L._meeting(80)(iter(posted.to_batches())))
    pairs, dense = met.filter(pc.field("a_seq").is_valid()), met.filter(pc.field("a_seq").is_null())
    assert len(pairs) <= L.DENSE * len(posted) and len(dense) and (tile < 1 << 18 or len(dense) <= len(posted))

    sets = [set(words_of(x)) for x in lines]
    want = [sum(similar(a, b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    earlier = [max((j for j in range(i) if similar(sets[i], sets[j])), default=-1) for i in range(len(sets))]
    links, best = [0] * len(lines), [-1] * len(lines)
    first = pairs.group_by(["seq", "f1", "a_seq", "a_f1"]).aggregate([("at", "min")])
    for side in ("seq", "a_seq"):
        first = first.append_column(f"{side}_text", pa.array([lines[i] for i in first[side].to_pylist()]))
    batch = first.combine_chunks().to_batches()[0]
    for b, _, a, _ in zip(*(c.to_pylist() for c in next(L._first_shared(80, ranks)(iter([batch]))).columns), strict=True):
        links[a] += 1
        links[b] += 1
        best[b] = max(best[b], a)
    dense = dense.select(["key", "group", "tile", "half", "seq", "f1"]).sort_by([(c, "ascending") for c in ("key", "group", "tile")])
    table = dense.append_column("text", pa.array([lines[i] for i in dense["seq"].to_pylist()]))
    for out in L._counted(80, ranks)(iter(table.to_batches(max_chunksize=37))):
        for seq, _, n, a, _ in zip(*(c.to_pylist() for c in out.columns), strict=True):
            links[seq] += n
            best[seq] = max(best[seq], -1 if a is None else a)
    assert links == want and sum(want) > 2000
    assert best == earlier


def test_buckets_come_in_any_order_of_sizes():
    """Spark deals and sorts postings by key only; rows of a bucket need no order, and single ones are left out."""
    lines = [t for t in dict.fromkeys(t for _, t in near_copies(150, seed=5, words=20))]
    posted = _posted(lines, np.zeros((2, L.COUNTERS), np.uint8))
    met = lambda t: {tuple(sorted((a, b))) for a, b in zip(*(pa.Table.from_batches(L._meeting(80)(iter(t.to_batches(max_chunksize=50))))[c].to_pylist() for c in ("seq", "a_seq")), strict=True) if b is not None}
    want = met(posted)
    backwards = posted.sort_by([("key", "ascending"), ("size", "descending")])
    assert met(backwards) == want and len(want) > 100
    given = L.by_size({c: backwards[c].to_numpy() for c in backwards.column_names})
    keys = backwards["key"].to_pylist()
    assert sorted(given["key"].tolist()) == sorted(k for k in keys if keys.count(k) > 1)


def test_equal_lines_of_a_slice_have_one_prefix(monkeypatch):
    texts = ["one two three\nfour five\n\none two  three", "other words\nONE two three", None, "four five\nthree two one"]
    batch = pa.record_batch([pa.array([7, 3, 4, 5]), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(L._lines(np.zeros((2, L.COUNTERS), np.uint8), 80)(iter([batch]))).to_pylist()
    assert [(r["doc_id"], r["line"]) for r in rows] == [(d, i) for d, t in zip((7, 3, 4, 5), texts, strict=True) for i in range(len((t or "").split("\n")))]
    worded = {(r["doc_id"], r["line"]): r["copies"] for r in rows if r["n"]}
    # the first by (doc_id, line) counts for all that are equal; three two one is another class
    assert worded == {(3, 1): 3, (7, 0): 0, (7, 3): 0, (3, 0): 1, (5, 0): 2, (7, 1): 0, (5, 1): 1}
    assert all(bool(r["prefix"]) == (r["copies"] > 0) for r in rows if r["n"])


def test_lines_are_digested_a_batch_at_once_not_a_document(monkeypatch):
    made = []
    monkeypatch.setattr(L, "Words", lambda lines, **x: made.append(len(lines)) or Words(lines, **x))
    texts = [f"a b {i}\nc d {i}" for i in range(300)]
    f = Words([t.split("\n")[1].encode() for t in texts]).digests(300)
    wanted = [[{"line": 1, "seq": i, "f1": int(f[i, 0])}, {"line": 0, "seq": i, "f1": 1}, {"line": 2, "seq": i, "f1": 1}] for i in range(300)]
    got = pa.Table.from_batches(L._texts_of(iter([pa.record_batch([pa.array(texts), pa.array(wanted)], names=["text", "wanted"])]))).to_pylist()
    assert [(r["seq"], r["f1"], r["f2"], r["text"]) for r in got] == [(i, *map(int, f[i]), f"c d {i}") for i in range(300)]
    assert made == [600]


@pytest.mark.parametrize("apart", [3, 1 << 61])
def test_places_there_and_back(spark, apart):
    rows = [(-apart, 0), (-apart, 5), (2, 1), (apart, 0), (apart, 1)]
    lines = spark.createDataFrame(rows, "doc_id long, line int")
    scratch = L.Scratch(spark, "places")
    places = L.Places(scratch, lines)
    assert (places.order is None) == (apart == 3)
    got = places.of(places.numbered(lines.toDF("doc_id", "line")).select("seq"), "seq").orderBy("seq").collect()
    assert [tuple(r["place"]) for r in got] == rows and len({r["seq"] for r in got}) == len(rows)
    scratch.close()
