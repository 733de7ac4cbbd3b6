"""Near-duplicate detection with circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct k-word shingles. One permutation scatters shingles over 2**22 slots; a
second permutation of the slots, read circularly from slot + 0, slot + 1, ..., gives all signature coordinates:
the coordinates of one shingle are neighbours in memory. Coordinates are banded; each band is a bucket key.

Documents with the same words in the same order are one class from the start, found by a 128-bit cryptographic digest,
so copies never meet pair by pair. In a bucket, members
are first held against one pivot (a star), then, in a second round, members still apart against a pivot picked
anew per bucket, and at last all members of different components that a signature sketch doesn't rule out; a big
component meets others block by block, so that no pairs of its members are listed.
A link already implied by a component needs no test; no other candidate is left out. Every link is confirmed on
the words of both whole texts. Components come from repeated contraction of the link table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, as_bytes, broadcast_if_small, forget, give_back, kept, mix64, slices, small_batches

SLOT_BITS = 22
BANDS, ROWS = 48, 6  #: a pair at Jaccard 0.8 shares no band with a chance of 5e-7
SKETCH = 512  #: signature coordinates of which the sketch keeps one bit each
#: Bits that may differ: 51 are expected at Jaccard 0.8, where 88 is 5.4 standard deviations off.
SKETCH_APART = 88
SKETCH_SHINGLES = 8_000  #: in larger sets a slot serves several coordinates, so bits are no longer independent: no sketch
BIG = 64  #: classes of a component from which on it is compared block by block
BLOCK, AGAINST = 128, 512  #: classes of a big component, and others, that meet in one group, about
MOST_TASKS = 10_000
BROADCAST_IDS = 1_000_000  #: class ids (8 bytes each) that may be broadcast

_U = np.uint64


def shingle_sets(found: Words, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text and the index of their text, sorted by text."""
    words, text_of = found.hashes, found.owner
    count = np.bincount(text_of, minlength=texts)
    parts, owners = [], []
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, _U)
        for j in range(k):
            h = mix64(h * _U(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j])
        whole = text_of[: len(h)] == text_of[k - 1 :]
        parts.append(h[whole])
        owners.append(text_of[: len(h)][whole])
    first = np.concatenate(([0], np.cumsum(count)))
    for i in np.flatnonzero((count > 0) & (count < k)):
        h = np.full(1, count[i], _U)
        for w in words[first[i] : first[i + 1]]:
            h = mix64(h * _U(0xD6E8FEB86659FD93) + w)
        parts.append(h)
        owners.append(np.full(1, i))
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    sets, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((sets, owner))
    sets, owner = sets[order], owner[order]
    new = np.concatenate(([True], (sets[1:] != sets[:-1]) | (owner[1:] != owner[:-1])))
    return sets[new], owner[new]


class Signatures:
    """Set sizes, band keys, sketches and digests of batches of texts."""

    def __init__(self, k: int):
        self.k, self.size = k, max(BANDS * ROWS, SKETCH)
        slots = np.random.default_rng(7).permutation(1 << SLOT_BITS).astype(np.uint32)
        self.view = np.lib.stride_tricks.sliding_window_view(np.concatenate((slots, slots[: self.size])), self.size)

    def __call__(self, texts: list[bytes]):
        words = Words(texts)
        sets, owner = shingle_sets(words, len(texts), self.k)
        n = np.bincount(owner, minlength=len(texts))
        bounds = np.concatenate(([0], np.cumsum(n)))
        slots = (mix64(sets ^ _U(0x5851F42D4C957F2D)) >> _U(64 - SLOT_BITS)).astype(np.int64)
        sig = np.zeros((len(texts), self.size), np.uint32)
        for i in np.flatnonzero(n):
            low = None
            for at in range(bounds[i], bounds[i + 1], 512):
                part = self.view[slots[at : min(at + 512, bounds[i + 1])]].min(axis=0)
                low = part if low is None else np.minimum(low, part)
            sig[i] = low
        keys = np.tile(np.arange(BANDS, dtype=_U), (len(texts), 1))
        for j in range(ROWS):
            keys = mix64(keys * _U(0x9E3779B97F4A7C15) + sig[:, j : BANDS * ROWS : ROWS])
        sketch = np.packbits((sig[:, :SKETCH] & 1).astype(np.uint8), axis=1).view(np.int64)
        return n, keys.view(np.int64), sketch, words.digests(len(texts))


SIGNED = "doc_id long, text_key long, n long, f1 long, f2 long, bands array<long>, sketch array<long>"


def _signed(k: int):
    names = [x.split()[0] for x in SIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = kept(("signatures", k), lambda: Signatures(k))
        rows = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))
        for batch in batches:
            for ids in slices(batch, batch.column(2)):
                n, keys, sketch, f = sign(as_bytes(ids.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), pa.array(n), pa.array(f[:, 0]), pa.array(f[:, 1]), rows(keys), rows(sketch)], names=names)
        give_back()

    return run


def word_set(text: str | None, k: int) -> set:
    """The exact shingle set of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(k)), strict=False))


def _verified(k: int, percent: int):
    def run(batches):
        forget()
        last, left = None, set()
        for batch in batches:
            for part in slices(batch, batch.column(2), batch.column(3)):
                a, ta, tb = (part.column(i).to_pylist() for i in (0, 2, 3))
                keep = []
                for i in range(len(a)):
                    if a[i] != last:
                        last, left = a[i], word_set(ta[i], k)
                    right = word_set(tb[i], k)
                    both = len(left & right)
                    keep.append(100 * both >= percent * (len(left) + len(right) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole texts reach the Jaccard similarity. texts: (node, text)."""
    held = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    held = held.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return held.select("a", "b", "ta", "tb").sortWithinPartitions("a").mapInArrow(_verified(k, percent), "a long, b long")


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of the link table (a, b); label is the smallest node reachable.

    Each round every node adopts its smallest neighbour, then links are redrawn between the adopted nodes.
    Joins are on tables with one row per node, so AQE can split a hub's links; the minimum combines map-side.
    """
    links = scratch.save(links.select("a", "b").filter("a != b").distinct(), f"{name}-links-0")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels, i = scratch.save(nodes.withColumn("label", F.col("node")), f"{name}-labels-0"), 0
    while not links.isEmpty():
        i += 1
        both = links.union(links.select("b", "a"))
        heads = both.groupBy("a").agg(F.least("a", F.min("b")).alias("head"))
        heads = scratch.save(heads.select(F.col("a").alias("node"), "head"), f"{name}-heads-{i}")
        labels = labels.join(heads.withColumnRenamed("node", "label"), "label", "left")
        labels = scratch.save(labels.select("node", F.coalesce("head", "label").alias("label")), f"{name}-labels-{i}")
        for end in ("a", "b"):
            links = links.join(heads.select(F.col("node").alias(end), "head"), end).drop(end).withColumnRenamed("head", end)
        links = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        links = scratch.save(links, f"{name}-links-{i}")
    return labels


def small_pairs(open_: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in an open bucket that neither sizes nor sketches rule out.

    A pair comes from the first bucket that it shares only.
    """
    rows = open_.join(heads.select("node", "n", "sketch", "bands"), "node")
    left, right = (rows.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "n", "sketch", "bands"))) for s in "ab")
    differ = sum(F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH // 64))
    near = (
        (left.key == right.key) & (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b"))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((differ <= SKETCH_APART) | (F.greatest("n_a", "n_b") > SKETCH_SHINGLES))
        & (F.array_intersect("bands_a", "bands_b")[0] == left.key)
    )
    return left.join(right, near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _block_links(k: int, percent: int):
    """Of each class on the left, the first link to one of the classes on the right: they are one component."""

    def run(left, right):
        held = [(n, word_set(t, k)) for n, t in zip(right["node"], right["text"], strict=True)]
        a, b = [], []
        for n, t in zip(left["node"], left["text"], strict=True):
            own = word_set(t, k)
            for m, other in held:
                if 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)):
                    both = len(own & other)
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        a.append(n)
                        b.append(m)
                        break
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


def against_big(scratch: Scratch, open_: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between a big component and classes of smaller ones that share an open bucket with it.

    All classes of the big one are looked at, in blocks; a class meets a block once, not its members one by one.
    """
    big = open_.filter(F.col("size") > BIG).select("key", F.col("label").alias("big"), F.col("size").alias("big_size")).distinct()
    smaller = (F.col("size") < F.col("big_size")) | ((F.col("size") == F.col("big_size")) & (F.col("label") < F.col("big")))
    others = open_.join(big, "key").filter((F.col("label") != F.col("big")) & smaller).select("node", "big", "big_size").distinct()
    others = scratch.save(others, "others")
    parts = others.groupBy("big").agg(
        F.ceil(F.first("big_size") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("node") / AGAINST).cast("int").alias("salts")
    )
    parts = scratch.save(parts, "big-parts")
    dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = others.join(parts, "big").select("node", "big", dealt(F.col("salts")).alias("salt"), upto("blocks").alias("block"))
    right = labels.withColumnRenamed("label", "big").join(parts, "big").select("node", "big", dealt(F.col("blocks")).alias("block"), upto("salts").alias("salt"))
    left = left.join(texts, "node").select("node", "text", "big", "block", "salt").toDF("node", "text", "x", "y", "z")
    right = right.join(texts, "node").select("node", "text", "big", "block", "salt")
    # a group is little to read and much to compare, so groups are dealt to tasks by their number
    groups = parts.agg(F.sum(F.col("blocks") * F.col("salts"))).first()[0] or 1
    n = min(int(groups), MOST_TASKS)
    left, right = left.repartition(n, "x", "y", "z"), right.repartition(n, "big", "block", "salt")
    return left.groupBy("x", "y", "z").cogroup(right.groupBy("big", "block", "salt")).applyInPandas(_block_links(k, percent), "a long, b long")


NO_ID = (1 << 63) - 1  #: stands for a null doc_id where rows are found again


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, group, text_key.

    Reads ``doc_id`` and ``text`` only. Null, empty and blank texts have an empty set and link with nothing: each
    is its own component, and group is null. group is one number for each component, whatever its doc_ids; text_key is
    a hash of the row's text, by which rows under one doc_id are told apart. Rows with equal texts share a component, and
    rows without doc_id link like others; a null doc_id is never the smallest unless a component has no other
    (component_id is then null and kept false). Texts of any length are taken whole. An empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, k, percent)


def _near_duplicates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = scratch.save(texts.select("doc_id", "text_key", "text").mapInArrow(_signed(k), SIGNED), "signed")

    row = [F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_key")]
    classes = signed.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(*row)).alias("row"))
    classes = scratch.save(classes.select("f1", "f2", "first_id", "row.*").withColumn("node", F.monotonically_increasing_id()), "classes")
    # the row that stands for a class
    heads = signed.select(*row, "n", "f1", "f2", "bands", "sketch").join(classes.drop("first_id"), ["f1", "f2", "id", "text_key"])
    heads = scratch.save(heads.select("node", "id", "text_key", "n", "bands", "sketch"), "heads")

    entries = heads.select("node", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).filter("pivot != most")
    shared = scratch.save(shared.select("key", "pivot"), "shared")
    members = scratch.save(entries.join(shared, "key"), "members")
    met = scratch.save(members.select("node").distinct(), "met")
    met_heads = heads.join(broadcast_if_small(met, BROADCAST_IDS), "node", "left_semi")
    met_heads = scratch.save(met_heads.dropDuplicates(["node"]), "met-heads")
    names = met_heads.select("node", "id", "text_key")
    whole = texts.select(*row, "text").join(broadcast_if_small(names, BROADCAST_IDS), ["id", "text_key"])
    whole = whole.select("node", "text")
    again = scratch.save(heads.groupBy("node").count().filter("count > 1").select("node"), "again")
    if not again.isEmpty():  # rows that stand for a class and are repeated
        few = broadcast_if_small(again, BROADCAST_IDS)
        whole = whole.join(few, "node", "left_anti").unionByName(whole.join(few, "node", "left_semi").dropDuplicates(["node"]))
    whole = scratch.save(whole, "texts")

    def labelled(labels: DataFrame) -> DataFrame:
        out = members.join(labels, "node", "left")
        return out.select("key", "node", F.coalesce("label", "node").alias("label"))

    tested = scratch.save(members.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs-1")
    links = scratch.save(confirm(tested, whole, k, percent), "links-1")
    labels = components(scratch, links, "c1")

    now = scratch.save(labelled(labels), "members-1")
    apart = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    open_ = scratch.save(now.join(scratch.save(apart, "apart-1"), "key"), "open-1")
    if not open_.isEmpty():
        pick = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node").alias("r"), "node", "label")).alias("p"))
        pick = scratch.save(pick.select("key", F.col("p.node").alias("pivot"), F.col("p.label").alias("pivot_label")), "pick")
        pairs = open_.join(pick, "key").filter("label != pivot_label")
        pairs = pairs.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        pairs = scratch.save(pairs.join(tested, ["a", "b"], "left_anti"), "pairs-2")
        links = links.union(scratch.save(confirm(pairs, whole, k, percent), "links-2"))
        labels = components(scratch, links, "c2")
        tested = tested.union(pairs)

        sizes = scratch.save(labels.groupBy("label").agg(F.count("node").alias("size")), "sizes")
        now = open_.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        now = scratch.save(now.join(sizes, "label", "left").fillna(1, ["size"]), "members-2")
        apart = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
        now = scratch.save(now.join(scratch.save(apart, "apart-2"), "key"), "open-2")
        pairs = small_pairs(now.filter(F.col("size") <= BIG), met_heads, percent)
        pairs = scratch.save(pairs.join(tested, ["a", "b"], "left_anti"), "pairs-3")
        links = links.union(scratch.save(against_big(scratch, now, labels, whole, k, percent), "links-big"))
        links = links.union(scratch.save(confirm(pairs, whole, k, percent), "links-3"))
        labels = components(scratch, links, "c3")

    linked = labels.join(classes.select("node", "first_id"), "node")
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(scratch.save(least, "least"), "label").select("node", "label", "component_id")
    ids = classes.join(scratch.save(linked, "linked"), "node", "left")
    ids = ids.select("f1", "f2", F.when(F.col("label").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("label", "node").alias("group"))
    ids = scratch.save(ids, "ids")
    out = signed.select("doc_id", "text_key", "n", *(F.when(F.col("n") > 0, F.col(f)).alias(f) for f in ("f1", "f2"))).join(ids, ["f1", "f2"], "left")
    own = F.when(F.col("group").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"),
        "group",
        "text_key",
    )
