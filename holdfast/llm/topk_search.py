"""Exact top-k inner product search with block-at-a-time pruning.

Components are integers: floor(256 * x). A task packs the vectors that it reads into shards of a bounded number of
values. In a shard, vectors are ordered by repeated halving along their widest spread, so that neighbours are alike, and
cut into ranges of BLOCK; a block has the maxima and minima of each component (its terms) and a forward index, its
vectors. A query's bound for a block is the sum over components of the query's value times the maximum, or, where the
value is negative, the minimum. Blocks are scored in descending order of bounds, until these fall below the kth score.

Each query first searches the shard it stands in, which gives a kth score that prunes in all others. Then batches
of queries meet all shards. What a shard finds for a query is at most k rows; a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARD_VALUES = 1 << 18  #: components of a shard's vectors
BLOCK = 32  #: vectors of a block
QUERIES = 1024  #: queries of a batch, about
BROADCAST_BYTES = 64 << 20  #: queries that may be broadcast
SALTS = 64  #: into so many parts the shards of a batch of queries are dealt where queries aren't broadcast
EXACT = 1 << 53  #: below this, sums of products in doubles are exact
LIMIT = (1 << 63) - 1

SHARD = "shard long, block int, dims int, kind string, ids array<long>, vectors binary, tops binary, lows binary"
QUERY = "shard long, n long, dims int, kind string, ids array<long>, rows array<long>, floors array<long>, vectors binary"
FOUND = "query long, query_id long, vec_id long, score long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _kind(values: np.ndarray) -> str:
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"


def alike(vectors: np.ndarray, size: int) -> np.ndarray:
    """An order in which ranges of ``size`` hold vectors that are alike: halved again and again along the direction of
    the vector farthest from the mean."""
    order, parts = np.arange(len(vectors)), [(0, len(vectors))]
    while parts:
        a, b = parts.pop()
        if b - a <= size:
            continue
        own = vectors[order[a:b]].astype(np.float64)
        own -= own.mean(axis=0)
        along = own @ own[np.argmax((own * own).sum(axis=1))]
        order[a:b] = order[a:b][np.argsort(along, kind="stable")]
        half = a + -(-(b - a) // (2 * size)) * size  # whole blocks
        parts += [(a, half), (half, b)]
    return order


def _sharded(values: int, block: int):
    def shard(number: int, ids: list, lists: list[np.ndarray]) -> pa.RecordBatch:
        dims = max(map(len, lists))
        vectors = np.zeros((len(lists), dims), np.int64)  # a shorter vector's other components are 0
        for row, v in zip(vectors, lists, strict=True):
            row[: len(v)] = v
        order = alike(vectors, block)
        vectors, at = vectors[order], np.arange(0, len(lists), block)
        kind = _kind(vectors)
        data = [x.astype(kind).tobytes() for x in (vectors, np.maximum.reduceat(vectors, at), np.minimum.reduceat(vectors, at))]
        columns = [pa.array([number]), *(pa.array([x], pa.int32()) for x in (block, dims)), pa.array([kind]), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in data)]
        return pa.RecordBatch.from_arrays(columns, names=_names(SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # shards are numbered within their partition, so a task that runs again makes the same ones
        number, ids, lists, size = TaskContext.get().partitionId() << 20, [], [], 0
        for batch in batches:
            held = batch.column(1)
            flat, ends = held.flatten().to_numpy(), np.cumsum(held.value_lengths().to_numpy())
            for i, v in zip(batch.column(0).to_pylist(), np.split(flat, ends[:-1]) if len(ends) else [], strict=True):
                if lists and size + max(1, len(v)) > values:
                    yield shard(number, ids, lists)
                    number, ids, lists, size = number + 1, [], [], 0
                ids.append(i)
                lists.append(v)
                size += max(1, len(v))
        if lists:
            yield shard(number, ids, lists)

    return run


def build_index(vectors: DataFrame, shard_values: int = SHARD_VALUES, block: int = BLOCK) -> DataFrame:
    """One row for each shard of the vectors that take part: see SHARD. Reads ``vec_id`` and ``embedding`` only."""
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    found = found.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return found.select("vec_id", F.transform("v", lambda x: F.floor(256 * x)).alias("v")).mapInArrow(_sharded(shard_values, block), SHARD)


class Shard:
    def __init__(self, shard, block, dims, kind, ids, vectors, tops, lows):
        self.dims, self.block = dims, block
        self.none = np.array([i is None for i in ids])
        self.ids = np.array([i or 0 for i in ids], np.int64)
        self.rows = (shard << 20) + np.arange(len(ids))
        sizes = len(ids), -(-len(ids) // block), -(-len(ids) // block)
        self.vectors, self.tops, self.lows = (np.frombuffer(x, kind).astype(np.int64).reshape(n, dims) for x, n in zip((vectors, tops, lows), sizes, strict=True))

    def search(self, queries: np.ndarray, rows: np.ndarray, floors: list, k: int) -> Iterator[tuple[np.ndarray, list[int]]]:
        """For each query its best places in the shard and their scores: k at most, those below its floor left out."""
        dims = min(self.dims, queries.shape[1])
        q, v, tops, lows = queries[:, :dims], self.vectors[:, :dims], self.tops[:, :dims], self.lows[:, :dims]
        most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
        kind = np.float64 if max(1, dims) * most(q) * most(v) < EXACT else object  # Python's integers, where doubles aren't exact
        q, v, tops, lows = (x.astype(kind) for x in (q, v, tops, lows))
        bounds = np.maximum(q, 0) @ tops.T + np.minimum(q, 0) @ lows.T if dims else np.zeros((len(q), len(tops)))
        for one, own, floor, bound in zip(q, rows, floors, bounds, strict=True):
            order = np.argsort(-bound, kind="stable")
            bound, kth = bound[order], floor
            held, scores, at, step = np.zeros(0, np.int64), np.zeros(0, kind), 0, 1
            while at < len(order) and (kth is None or bound[at] >= kth):
                blocks = order[at : at + step]
                if kth is not None:
                    blocks = blocks[bound[at : at + step] >= kth]
                places = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
                places = places[(places < len(v)) & (self.rows[np.minimum(places, len(v) - 1)] != own)]
                new = v[places] @ one if dims else np.zeros(len(places))
                if kth is not None:
                    keep = new >= kth
                    places, new = places[keep], new[keep]
                held, scores = np.concatenate((held, places)), np.concatenate((scores, new))
                best = np.lexsort((self.ids[held], self.none[held], -scores))[:k]
                held, scores = held[best], scores[best]
                if len(held) == k:
                    kth = scores[-1] if kth is None else max(kth, scores[-1])
                at, step = at + step, 2 * step
            yield held, [max(-LIMIT - 1, min(LIMIT, int(s))) for s in scores]


def _asked(every: int, k: int):
    """The queries of each shard, with the kth score that they have in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Shard(**row)
                at = np.flatnonzero((own.ids % every == 0) & ~own.none)
                if not len(at):
                    continue
                vectors, rows = own.vectors[at], own.rows[at]
                floors = [s[-1] if len(s) == k else None for _, s in own.search(vectors, rows, [None] * len(at), k)]
                out = {"shard": row["shard"], "n": len(at), "dims": own.dims, "kind": row["kind"], "ids": own.ids[at].tolist(), "rows": rows.tolist(), "floors": floors, "vectors": vectors.astype(row["kind"]).tobytes()}
                yield pa.RecordBatch.from_pylist([out], schema=pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("dims", pa.int32()), ("kind", pa.string()), *((c, pa.list_(pa.int64())) for c in ("ids", "rows", "floors")), ("vectors", pa.binary())]))

    return run


def _met(k: int):
    """What each shard finds for a batch of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blocks, out = row.pop("queries"), []
                shard = Shard(**row)
                for b in blocks:
                    dims = b["dims"]
                    vectors = np.frombuffer(b["vectors"], b["kind"]).astype(np.int64).reshape(len(b["ids"]), dims)
                    for query, i, (held, scores) in zip(b["rows"], b["ids"], shard.search(vectors, b["rows"], b["floors"], k), strict=True):
                        out += [(query, i, None if shard.none[p] else int(shard.ids[p]), s) for p, s in zip(held, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(4)], names=_names(FOUND))

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each vector whose id ``every`` divides, the k vectors with the greatest
    integer inner products; equal scores by ascending vec_id.

    Reads ``vec_id`` and ``embedding`` only. Vectors that are null or hold null or non-finite components take no part;
    a shorter vector's missing components are 0. Every row but the query's own is a candidate, also another one under
    its id; rows without vec_id are no queries and come last among equal scores. Components beyond 64 bits are cut to
    their range, and so are scores. With fewer than k candidates all are returned; an empty table gives no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "top-k")
    index = scratch.save(build_index(vectors), "index", compression="zstd")
    queries = scratch.save(index.mapInArrow(_asked(every, k), QUERY), "queries")
    n, size = queries.agg(F.sum("n"), F.sum(F.length("vectors") + 24 * F.col("n"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    batches = -(-n // QUERIES)
    parts = F.struct(*(c for c in queries.columns if c not in ("shard", "n")))
    queries = queries.groupBy(F.pmod(F.xxhash64("shard"), F.lit(batches)).alias("batch")).agg(F.collect_list(parts).alias("queries"))
    queries = scratch.save(queries, "query-batches")
    # all queries meet all shards, batch by batch
    met = index.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
    if size <= BROADCAST_BYTES:
        met = met.join(F.broadcast(queries), "batch").drop("batch")
    else:
        salted = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = met.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int")).join(salted, ["batch", "salt"]).drop("batch", "salt")
    found = met.mapInArrow(_met(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
