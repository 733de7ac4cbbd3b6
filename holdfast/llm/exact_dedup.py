"""Exact deduplication by deterministic block naming.

Normalised texts are cut into blocks of a fixed size. Distinct blocks are sorted and numbered; a text is then
the sequence of its blocks' integers. Adjacent integers are paired, distinct pairs are sorted and numbered in
turn, and so on: after ceil(log2(blocks)) rounds each text has one integer, and two texts have the same one
exactly if they are equal. Only DataFrame functions are used.

Distributed form. Numbering: distinct values are hash-partitioned (after map-side partial distinct, so copies
leave a map task once), sorted within the partition and given partition-major consecutive integers. The text
itself is shuffled once; to bring names back, rows carry a 64-bit key of their block instead of the block.
Keys that two different blocks share are found in the name table, and their blocks get names by comparing the
blocks themselves, so no hash decides equality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch

BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of white space becomes one space."""
    # a single space stays as it is, so only other runs are matched
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+", " ")


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Consecutive integers within each partition in sort order; unique over all partitions, the same on every retry."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def exact_dedup(
    docs: DataFrame,
    block_chars: int = BLOCK_CHARS,
    block_key: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_blocks.

    Reads ``doc_id`` and ``text`` only; other columns are ignored, whatever their names. Null and empty texts are
    equal to each other and form one group. A null doc_id is never the smallest unless the whole group has none
    (keep_id is then null). Of repeated rows with the same doc_id and text exactly one is kept. An empty table
    gives an empty result. ``block_key`` only routes; it may collide.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    cut = F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    pieces = texts.select(
        "doc_id",
        F.sha2("norm", 256).alias("sha"),
        F.when(F.length("norm") <= block_chars, F.array("norm")).otherwise(cut).alias("blocks"),
    )

    blocks = pieces.select(F.explode("blocks").alias("block")).select(block_key(F.col("block")).alias("h"), "block")
    names = scratch.save(_numbered(blocks.distinct(), ["block", "h"]).select("h", "name"), "names-0")
    placed = pieces.select(
        "doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block")
    ).withColumn("h", block_key(F.col("block")))
    shared = names.groupBy("h").count().filter("count > 1").select("h")
    if shared.isEmpty():
        rows = placed.drop("block").join(names, "h")
    else:
        shared = scratch.save(shared, "shared-0")
        kth = names.join(shared, "h", "left_semi").select(
            "h", "name", F.row_number().over(Window.partitionBy("h").orderBy("name")).alias("k")
        )
        texts_of = blocks.join(shared, "h", "left_semi").distinct().withColumn(
            "k", F.row_number().over(Window.partitionBy("h").orderBy("block"))
        )
        by_block = scratch.save(texts_of.join(kth, ["h", "k"]).select("h", "block", "name"), "by-block-0")
        rows = (
            placed.join(shared, "h", "left_anti").drop("block").join(names, "h")
            .unionByName(placed.join(by_block, ["h", "block"]).drop("block"))
        )
    rows = scratch.save(rows.select("doc_id", "sha", "n", "pos", "name", F.lit(1).cast("long").alias("m")), "rows-0")

    longest = rows.agg(F.max("n")).first()[0] or 1
    done = [rows.filter("n = 1").select("doc_id", "sha", F.lit(0).alias("level"), "name", "m", F.col("n").alias("n_blocks"))]
    rows, level, left = rows.filter("n > 1").withColumn("n_blocks", F.col("n")), 0, longest
    while left > 1:
        level, left = level + 1, -(-left // 2)
        even = F.col("pos") % 2 == 0
        pairs = (
            rows.groupBy("doc_id", "sha", "n_blocks", "n", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"), F.sum(F.when(even, F.col("m"))).alias("m"))
        )
        pairs = scratch.save(pairs, f"pairs-{level}")
        names = scratch.save(_numbered(pairs.select("a", "b").distinct(), ["a", "b"]), f"names-{level}")
        rows = pairs.join(names, ["a", "b"]).select(
            "doc_id", "sha", "n_blocks", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name", "m"
        )
        rows = scratch.save(rows, f"rows-{level}")
        done.append(rows.filter("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name", "m", "n_blocks"))
        rows = rows.filter("n > 1")

    named = done[0]
    for part in done[1:]:
        named = named.unionByName(part)
    groups = named.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("m").alias("group_size"))
    groups = scratch.save(groups, "groups")
    out = named.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    # rows of level 0 are not gathered by doc_id, so repeated rows there are told apart by a rank within (doc_id, sha)
    single = F.col("level") == 0
    first = F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy("copy")) == 1
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.when(single, first).otherwise(F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "n_blocks",
    )
