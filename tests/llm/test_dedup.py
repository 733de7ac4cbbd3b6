"""Exact, near and line deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from holdfast.llm import minhash
from holdfast.llm.exact_dedup import exact_dedup
from holdfast.llm.line_dedup import duplicate_lines, without_lines
from holdfast.llm.minhash import near_duplicates

from .helpers import AWKWARD, brute_components, near_copies, similar, table, tuples, words_of


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"block_chars": 4}, {"block_chars": 3, "block_key": lambda b: F.length(b).cast("long")}])
def test_exact_groups(spark, options):
    rows = [(d, t if t is None or len(t) < 1000 else t[:600]) for d, t in AWKWARD] + [(20, "abcdefgh"), (21, "abcdefgi"), (22, "abcdefgh"), (23, "defgabch")]
    got = exact_dedup(table(spark, rows), **options)
    assert tuples(got, "doc_id", "keep_id", "group_size", "text_sha256") == brute_exact(rows)
    kept = got.filter("kept").groupBy("text_sha256").count()
    assert {r["count"] for r in kept.collect()} == {1} and kept.count() == got.select("text_sha256").distinct().count()
    assert got.filter("kept AND NOT doc_id <=> keep_id").isEmpty()


def test_exact_long_and_empty(spark):
    got = exact_dedup(table(spark, AWKWARD))
    assert tuples(got, "doc_id", "keep_id", "group_size", "text_sha256") == brute_exact(AWKWARD)
    assert exact_dedup(table(spark, [])).collect() == []


@pytest.mark.parametrize("big", [64, 2])
def test_near_components(spark, monkeypatch, big):
    monkeypatch.setattr(minhash, "BIG", big)
    rows = near_copies(150, seed=big)
    got = near_duplicates(table(spark, rows), k=2, percent=80)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows, 2), key=str)
    assert got.filter("kept != (doc_id = component_id)").isEmpty()


@pytest.mark.parametrize("k", [2, 5])
def test_near_awkward(spark, k):
    got = near_duplicates(table(spark, AWKWARD), k=k, percent=80)
    want = [(d, n, d if n == 0 else c) for d, n, c in brute_components(AWKWARD, k)]
    assert tuples(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=str)
    assert near_duplicates(table(spark, []), k=k).collect() == []


def test_near_group_of_copies_and_chain(spark):
    """A large group of copies, and a chain whose ends are not similar."""
    word = [f"c{i}" for i in range(60)]
    rows = [(i, "same text here again and again with ten words or so") for i in range(1, 400)]
    rows += [(1000 + j, " ".join([f"n{i}" for i in range(3 * j)] + word[3 * j :])) for j in range(8)]
    got = near_duplicates(table(spark, rows), k=2, percent=80)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows, 2), key=str)


def brute_lines(rows):
    by_place = defaultdict(set)
    for doc_id, text in rows:
        if doc_id is not None:
            for n, line in enumerate((text or "").split("\n")):
                by_place[doc_id, n].add(frozenset(words_of(line)))
    removed = defaultdict(set)
    places = sorted(by_place)
    for i, place in enumerate(places):
        for words in by_place[place]:
            if any(similar(words, other) for before in places[:i] for other in by_place[before]):
                removed[place[0]].add(place[1])
    return {d: sorted(removed[d]) for d in {p[0] for p in places}}


def test_line_dedup(spark):
    lines = [t for _, t in near_copies(160, seed=5, words=14)]
    rows = [(i + 1, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "\n \n"), (93, lines[0] + "\n" + lines[0].upper()), (93, lines[0] + "\n" + lines[0].upper()), (None, lines[1])]
    rows += [(94, "\n".join(["very common line of text"] * 300)), (95, "very common line of text")]
    docs = table(spark, rows)
    got = duplicate_lines(docs, percent=80)
    want = brute_lines(rows)
    assert {r["doc_id"]: r["removed"] for r in got.collect()} == want
    n = {r["doc_id"]: r["n_lines"] for r in got.collect()}
    assert n[94] == 300 and n[91] == 1 and n[93] == 4
    left = {r["doc_id"]: r["text"] for r in without_lines(docs, got).filter("doc_id IN (90, 94, 95)").collect()}
    assert left == {90: None, 94: "very common line of text", 95: ""}
    assert duplicate_lines(table(spark, [])).collect() == []


def test_every_link_between_different_lines_counts(spark):
    """All similar pairs of different lines, chains and groups of near copies too; copies count once."""
    base = [f"w{i}" for i in range(30)]
    lines = [t for _, t in near_copies(200, seed=11, words=16)]
    lines += [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(30)] * 2
    lines += [" ".join([f"n{i}" for i in range(2 * j)] + [f"c{i}" for i in range(2 * j, 30)]) for j in range(8)]
    rows = [(i + 1, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(-(-len(lines) // 3))]
    classes = {tuple(words_of(x)) for x in lines}
    links = {c: sum(similar(set(c), set(o)) for o in classes if o != c) for c in classes}
    want = {d: sum(links[tuple(words_of(x))] for x in t.split("\n")) for d, t in rows}
    got = duplicate_lines(table(spark, rows), percent=80)
    assert {r["doc_id"]: r["n_links"] for r in got.collect()} == want and sum(want.values()) > 30 * 29
    assert {r["doc_id"]: r["removed"] for r in got.collect()} == brute_lines(rows)
    alone = duplicate_lines(table(spark, rows), percent=80, links=False)
    assert {r["doc_id"]: r["removed"] for r in alone.collect()} == brute_lines(rows)
