"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent, normalised. The exponent is bisected to
reach a target entropy or a limit on how often a source repeats. The weights are then realised within a token
budget: a source's texts fall into a fixed number of blocks by hash; each epoch is a permutation of the blocks,
whole epochs take all of them, and the last one takes blocks in that order until the source's budget is used, cutting
only its last block. The block that is cut falls into smaller ones, of which again whole ones are taken in order, and
the last of these is cut text by text, in hash order.

Only block totals (BLOCKS rows a source and epoch) and the texts of one small block of a source (a BLOCKS * BLOCKS-th
of it) are ordered in one place; a hot source's rows stay spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, broadcast_if_small

BLOCKS = 1024
ROUNDS, INNER = 6, 15  #: each round looks at 15 inner points at once: four halvings
BROADCAST_BLOCKS = 500_000  #: rows of the block table (80 bytes each) that may be broadcast


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def exponent_for(shares: DataFrame, budget_ratio: float, entropy_gain: float | None, max_repeats: float | None) -> float:
    """The largest exponent in [0, 1] whose entropy closes the share entropy_gain of the gap between the corpus' own and
    the greatest possible one, raised if need be to the smallest one at which no source repeats more than max_repeats
    times. shares: column p, positive, of sum 1.

    Both measures fall with the exponent or its opposite, so either is bisected; a step is one aggregate over the
    sources, however many there are.
    """
    n = shares.count()
    if n < 2:
        return 1.0

    def measured(points: list[float]) -> list[tuple[float, float]]:
        sums = [f(F.pow("p", F.lit(a)) * w) for a in points for f, w in ((F.sum, F.lit(1.0)), (F.sum, F.lit(a) * F.ln("p")))]
        row = shares.agg(F.min("p"), *(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        out = []
        for i, a in enumerate(points):
            z, weighted = row[1 + 2 * i], row[2 + 2 * i]
            out.append((math.log(z) - weighted / z, budget_ratio * row[0] ** (a - 1) / z))
        return out

    def bisect(reached, take_low: bool) -> float:
        """reached holds up to some point (take_low) or from some point on; returns that point."""
        low, high = 0.0, 1.0
        ends = measured([low, high])
        if reached(*ends[1 if take_low else 0]):
            return high if take_low else low
        if not reached(*ends[0 if take_low else 1]):
            return low if take_low else high
        for _ in range(ROUNDS):
            points = [low + (high - low) * (i + 1) / (INNER + 1) for i in range(INNER)]
            held = [reached(*m) for m in measured(points)]
            side = [p for p, h in zip(points, held, strict=True) if h == take_low]
            low, high = (max(side, default=low), min([p for p in points if p not in side], default=high))
        return low if take_low else high

    exponent = 1.0
    if entropy_gain is not None:
        own = measured([1.0])[0][0]
        target = own + entropy_gain * (math.log(n) - own)
        exponent = bisect(lambda h, _: h >= target, True)
    if max_repeats is not None:
        within = bisect(lambda _, r: r <= max_repeats, False)
        exponent = within if entropy_gain is None else max(exponent, within)
    return exponent


def _ordered(blocks: DataFrame, within: list[str], epoch: Column, number: str, seed: int) -> DataFrame:
    """blocks with their place (from 0) in the epoch's permutation, and the tokens before them in it."""
    order = Window.partitionBy(*within).orderBy(F.xxhash64(F.lit(seed), *within, epoch, number), number)
    return blocks.withColumns({"place": F.row_number().over(order) - 1, "before": F.sum("tokens").over(order) - F.col("tokens")})


def mix(
    docs: DataFrame,
    budget: float = 1.0,
    entropy_gain: float | None = 0.5,
    max_repeats: float | None = 4.0,
    seed: int = 17,
) -> DataFrame:
    """row (a struct of the columns of docs), epoch (from 1), block (its place in the epoch's permutation, from 0),
    n_tokens, weight (the source's).

    A row for each time that a text is used. budget: tokens to use as a multiple of the corpus' (words of whole
    texts). Reads doc_id, text and source besides passing all columns through; no name clashes with them. A null
    source counts as the empty one. A text without words has no tokens and is used with its block; a source without
    any words is used once, at weight 0. Repeated rows are used each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    order = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), order.alias("order"))
    rows = rows.withColumn("b", F.pmod("order", F.lit(BLOCKS)).cast("int"))
    counted = lambda df: df.withColumn("n_tokens", n_words(F.col("row.text").cast("string")))
    blocks = scratch.save(counted(rows).groupBy("source", "b").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    totals = scratch.save(blocks.groupBy("source").agg(F.sum("tokens").alias("total")), "sources")
    corpus = totals.agg(F.sum("total")).first()[0] or 0
    shares = totals.filter("total > 0").withColumn("p", F.col("total") / F.lit(float(max(corpus, 1))))
    exponent = exponent_for(shares, budget, entropy_gain, max_repeats)
    norm = shares.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0] or 1.0
    weight = F.pow("p", F.lit(exponent)) / F.lit(norm)
    quota = F.round(weight * F.lit(budget * corpus)).cast("long")
    quotas = shares.select("source", weight.alias("weight"), quota.alias("quota"), "total")
    quotas = quotas.select("source", "weight", F.expr("quota div total").alias("whole"), F.expr("quota % total").alias("rest"))
    wordless = totals.filter("total = 0").select("source", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("whole"), F.lit(0).cast("long").alias("rest"))
    epochs = quotas.unionByName(wordless).withColumn("last", F.col("whole") + (F.col("rest") > 0).cast("long")).filter("last > 0")
    epochs = epochs.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "last")))
    plan = _ordered(blocks.join(epochs, "source"), ["source", "epoch"], F.lit(0), "b", seed)
    # tokens that the last epoch may still take from a block; whole epochs take all
    left = F.when(F.col("epoch") <= F.col("whole"), F.col("tokens")).otherwise(F.least(F.col("rest") - F.col("before"), "tokens"))
    plan = plan.select("source", "b", "epoch", F.col("place").alias("block"), "weight", left.alias("left"), (left < F.col("tokens")).alias("cut")).filter("left >= 0")
    plan = scratch.save(plan.filter("NOT cut OR left > 0"), "plan")

    out = ["row", "epoch", "block", "n_tokens", "weight"]
    whole = plan.filter("NOT cut").select("source", "b", "epoch", "block", "weight")
    used = counted(rows.join(broadcast_if_small(whole, BROADCAST_BLOCKS), ["source", "b"])).select(*out)
    cut = broadcast_if_small(plan.filter("cut").drop("cut"), BROADCAST_BLOCKS)  # one block a source
    held = counted(rows.join(cut, ["source", "b"])).withColumn("sub", F.pmod(F.shiftright("order", 20), F.lit(BLOCKS)).cast("int"))
    parts = scratch.save(held.groupBy("source", "epoch", "left", "sub").agg(F.sum("n_tokens").alias("tokens")), "parts")
    parts = _ordered(parts, ["source", "epoch"], F.lit(1), "sub", seed).withColumn("part_left", F.col("left") - F.col("before")).filter("part_left >= 0")
    parts = scratch.save(parts.select("source", "sub", "part_left", (F.col("part_left") < F.col("tokens")).alias("part_cut")), "small-parts")
    held = held.join(broadcast_if_small(parts, BROADCAST_BLOCKS), ["source", "sub"])
    within = Window.partitionBy("source", "sub").orderBy("order", "row.doc_id").rowsBetween(Window.unboundedPreceding, 0)
    few = held.filter("part_cut").withColumn("so_far", F.sum("n_tokens").over(within)).filter("so_far <= part_left")
    return used.unionByName(held.filter("NOT part_cut").select(*out)).unionByName(few.select(*out))
