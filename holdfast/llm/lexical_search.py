"""Ranked lexical search: document-at-a-time merge of compressed postings, shard by shard.

The index is split by documents. A task packs the texts that it reads anyway into shards of a bounded number of terms,
so building it shuffles nothing. A shard has one row a term, with its postings in ascending doc_id order as
variable-length integers (gaps of places in the shard, then occurrences), and one row, under the empty term, with its
documents' ids and lengths.

A search looks up the shards' postings of the terms asked for and brings those of one shard and one block of queries
together. There a heap merges a query's postings lists document by document, and a bounded heap keyed by score, then
doc_id, keeps the best. Lists whose greatest contributions together can't lift a document into the full result heap are
not merged, but looked up for the documents that the others bring; nothing is lost by that. A window then merges the
shards' results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, as_bytes, chunks, small

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_TERMS = 2_000_000  #: terms of a shard, about; a longer text makes a shard of its own
QUERIES = 256  #: queries of a block
BROADCAST_TERMS = 100_000  #: terms asked for, of all blocks, that may be broadcast
SALTS = 64  #: into so many parts a term's shards are dealt where its queries aren't broadcast

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes, seven bits each, the last one of a number without the high bit; and their sizes."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >= (1 << bits)
    out, ends = np.empty(int(sizes.sum()), np.uint8), np.cumsum(sizes)
    for i in range(int(sizes.max(initial=0))):
        has = sizes > i
        more = sizes[has] > i + 1
        out[ends[has] - sizes[has] + i] = ((values[has] >> (7 * i)) & 127) | np.where(more, 128, 0)
    return out, sizes


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    begins = np.concatenate(([0], ends[:-1]))
    place = np.arange(len(raw)) - np.repeat(begins, ends - begins)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begins) if len(raw) else np.zeros(0, np.int64)


INDEX = "shard long, term string, df long, postings binary, doc_ids array<long>, lengths array<long>"


class _Shard:
    """Postings of some documents, gathered text by text."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.lengths: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list[int | None], texts: list[bytes]) -> None:
        found = Words(texts, space=_BETWEEN.__getitem__)
        number = found.numbered(self.terms, np.arange(len(found.start)))
        key, tf = np.unique((found.owner.astype(np.int64) << 32) | number, return_counts=True)
        self.parts.append(((key >> 32) + len(self.ids), key & 0xFFFFFFFF, tf))
        self.lengths.append(np.bincount(found.owner, minlength=len(texts)))
        self.ids += ids
        self.size += len(number)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        none = np.array([i is None for i in self.ids])
        ids, lengths = np.array([i or 0 for i in self.ids], np.int64), np.concatenate(self.lengths)
        order = np.lexsort((ids, none))  # rows without doc_id stand last
        order = order[lengths[order] > 0]
        if not len(order):
            return
        place = np.zeros(len(ids), np.int64)
        place[order] = np.arange(len(order))
        docs, terms, tf = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        by = np.lexsort((place[docs], terms))
        docs, terms, tf = place[docs[by]], terms[by], tf[by]
        first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
        df = np.diff(np.concatenate((first, [len(terms)])))
        gaps = np.diff(docs, prepend=0)
        gaps[first] = docs[first]
        # a term's gaps, then its occurrences
        base = np.repeat(first, df) + np.arange(len(docs))
        both = np.empty(2 * len(docs), np.int64)
        both[base], both[base + np.repeat(df, df)] = gaps, tf
        data, sizes = packed(both)
        ends = np.cumsum(np.add.reduceat(sizes, 2 * first))
        names = list(self.terms)
        named = pa.array([names[t].decode("utf-8", "replace") for t in terms[first].tolist()], pa.string())
        at = np.concatenate(([0], ends)).astype(np.int64)
        postings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(df), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
        n, lists = len(df), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), named, pa.array(df), postings, pa.nulls(n, lists), pa.nulls(n, lists)], names=_NAMES)
        held = [None if none[i] else int(ids[i]) for i in order]
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([""]), pa.array([len(order)]), pa.array([b""], pa.binary()), pa.array([held], lists), pa.array([lengths[order]], lists)], names=_NAMES)


_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _indexed(shard_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # shards are numbered within their partition, so a task that runs again makes the same ones
        number, held = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1).to_pylist())
            for part in chunks(texts, 1 << 20):
                held.add(ids[part], texts[part])
                if held.size >= shard_terms:
                    yield from held.rows(number)
                    number, held = number + 1, _Shard()
        if held.ids:
            yield from held.rows(number)

    return run


def build_index(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """One row for each shard and term, and one under the empty term for each shard: see INDEX.

    Reads ``doc_id`` and ``text`` only. Texts without terms, null and empty ones among them, are not in it. Texts of
    any length are read whole.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_indexed(shard_terms), INDEX)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text; A-Z count as lower case."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0)))


def best(lists: list[tuple[int, list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """(score, document), best first, of k documents at most, those of equal scores in ascending order.

    lists: greatest contribution, documents in ascending order and their contributions, all above 0.
    """
    lists = sorted(lists, key=lambda x: x[0])
    reach = np.cumsum([0, *(top for top, _, _ in lists)]).tolist()  # what the first lists can contribute together
    result: list[tuple[int, int]] = []  # (score, -document), the worst first
    floor, merged_from = 0, 0
    at = [0] * len(lists)
    heads = [(docs[0], i) for i, (_, docs, _) in enumerate(lists)]
    heapify(heads)
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            i = heads[0][1]
            _, docs, gives = lists[i]
            p = at[i]
            score += gives[p]
            at[i] = p = p + 1
            if p < len(docs):
                heapreplace(heads, (docs[p], i))
            else:
                heappop(heads)
        for i in range(merged_from - 1, -1, -1):
            if score + reach[i + 1] <= floor:
                break
            _, docs, gives = lists[i]
            at[i] = p = bisect_left(docs, doc, at[i])
            if p < len(docs) and docs[p] == doc:
                score += gives[p]
        if score <= floor:
            continue  # of equal scores the smaller document stays, and it came first
        if len(result) < k:
            heappush(result, (score, -doc))
        else:
            heapreplace(result, (score, -doc))
        if len(result) == k:
            floor = result[0][0]
            if reach[merged_from + 1] <= floor:
                while merged_from < len(lists) and reach[merged_from + 1] <= floor:
                    merged_from += 1
                heads = [h for h in heads if h[1] >= merged_from]
                heapify(heads)
    return [(s, -d) for s, d in sorted(result, reverse=True)]


def _contributions(weight: int, df: int, postings: bytes, m: np.ndarray) -> tuple[int, list[int], list[int]]:
    values = unpacked(postings)
    docs, tf = np.cumsum(values[:df]), values[df:]
    gives = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
    if (gives <= 0).any():
        docs, gives = docs[gives > 0], gives[gives > 0]
    return int(gives.max(initial=0)), docs.tolist(), gives.tolist()


FOUND = "query long, doc_id long, score long"


def _searched(k: int, n: int, total: int):
    """Of one shard and one block of queries: the best documents of each query."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        own = rows["term"].index("")
        ids, lengths = rows["doc_ids"][own], rows["lengths"][own]
        if lengths and 90 * max(lengths) * n < 1 << 63:
            m = 10 + (90 * np.array(lengths, np.int64) * n) // total
        else:
            m = np.array([10 + 90 * length * n // total for length in lengths], np.int64)
        asked: dict[int, list] = {}
        for term, df, postings, weight, queries in zip(*(rows[c] for c in ("term", "df", "postings", "weight", "queries")), strict=True):
            if term and (entry := _contributions(weight, df, postings, m))[1]:
                for q in queries:
                    asked.setdefault(q, []).append(entry)
        found = [(q, ids[d], s) for q, lists in asked.items() for s, d in best(lists, k)]
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query", "doc_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, rank (from 1), doc_id, score: the k best texts of the index for each query, those above 0 only; equal
    scores stand in ascending order of doc_id.

    index: a written table of build_index. queries: ``query`` (long, distinct) and ``text``. Each distinct term of a text
    counts once. A query without terms finds nothing. Texts without doc_id are found like others and stand behind those
    of the same score; texts under one doc_id are separate results. An empty index or no queries give no rows.
    """
    spark, scratch = index.sparkSession, Scratch(index.sparkSession, "lexical-search")
    n, total = index.filter("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "query long, rank int, doc_id long, score long")
    blocks = -(-queries.count() // QUERIES)
    block = F.pmod(F.xxhash64("query"), F.lit(max(1, blocks))).alias("block")
    asked = queries.select("query", block, F.explode(terms_of(F.col("text"))).alias("term"))
    asked = scratch.save(asked.groupBy("block", "term").agg(F.collect_list("query").alias("queries")), "asked")  # at most a block's
    few = small(asked, BROADCAST_TERMS)
    names = asked.select("term").distinct()
    df = index.join(F.broadcast(names) if few else names, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).alias("weight")
    weighted = asked.join(df.select("term", weight), "term").filter("weight > 0")
    shards = asked.select(F.lit("").alias("term"), "block").distinct().withColumns({"queries": F.array().cast("array<long>"), "weight": F.lit(0).cast("long")})
    weighted = scratch.save(weighted.unionByName(shards), "weighted")
    if few:
        met = index.join(F.broadcast(weighted), "term")
    else:  # a frequent term has a row for each shard
        salted = weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = index.withColumn("salt", F.pmod("shard", F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")
    found = met.groupBy("shard", "block").applyInArrow(_searched(k, n, total), FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item.

    Reads ``doc_id``/``text`` and ``item_id``/``text`` only. Rows are queries of their own, so a repeated item has its
    results once for each row; an item without id has results under a null item_id. Otherwise as in ``search``.
    """
    scratch = Scratch(docs.sparkSession, "ranked")
    index = scratch.save(build_index(docs), "index", compression="zstd")
    queries = items.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    queries = scratch.save(queries, "queries")  # numbers must not change between readings
    found = search(index, queries.select("query", "text"), k)
    return found.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
