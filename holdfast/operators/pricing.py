"""Price analytics of the requirements: daily rollup, outliers, confidence, conversion, valuation, movers, alerts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import broadcast_if_small
from . import operations as O

HOT = 1_000_000  #: rows of a group whose values are no longer held in one buffer
BROADCAST_GROUPS = 100_000  #: keys of such groups that may be broadcast
SPREAD = 3.0  #: observations beyond this many interquartile ranges are outliers


def deduplicated(observations: DataFrame) -> DataFrame:
    """One observation for each (source_id, external_id): the earliest, then the cheapest."""
    rest = [c for c in observations.columns if c not in ("source_id", "external_id")]
    best = observations.groupBy("source_id", "external_id").agg(F.min(F.struct("at", "price", *[c for c in rest if c not in ("at", "price")])).alias("o"))
    return best.select("source_id", "external_id", "o.*")


def _by_size(rows: DataFrame, by: list[str], small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """small over groups whose values fit into a buffer, large over the others, which are few: one has HOT rows."""
    hot = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT).select(*by)
    if hot.isEmpty():
        return small(rows)
    hot = broadcast_if_small(hot, BROADCAST_GROUPS)
    usual = small(rows.join(hot, by, "left_anti"))
    return usual.unionByName(large(rows.join(hot, by, "left_semi")))


def _summed(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("mean"), F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"), *more
    )


def _with_median(summed: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    middle = O.quantiles(rows, by, "price", [0.5]).select(*by, F.col("q")[0].alias("median"))
    return summed.join(middle, by, "left")


def daily(observations: DataFrame) -> DataFrame:
    """low, median, high, mean, observations and sources by (printing_id, day)."""
    by, columns = ["printing_id", "day"], ["printing_id", "day", "low", "median", "high", "mean", "n", "sources"]
    return _by_size(observations, by, lambda r: _summed(r, by, F.median("price").alias("median")).select(*columns), lambda r: _with_median(_summed(r, by), r, by).select(*columns))


def _quartiles(observations: DataFrame, by: list[str]) -> DataFrame:
    in_buffer = lambda r: r.groupBy(*by).agg(F.percentile("price", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    return _by_size(observations, by, in_buffer, lambda r: O.quantiles(r, by, "price", [0.25, 0.75]).withColumnRenamed("q", "_q"))


def _usual(spread: float) -> Column:
    room = spread * (F.col("_q")[1] - F.col("_q")[0])
    return F.col("price").between(F.col("_q")[0] - room, F.col("_q")[1] + room)


def within_spread(observations: DataFrame, by: list[str], spread: float = SPREAD) -> DataFrame:
    """Without observations beyond ``spread`` interquartile ranges of their group."""
    return observations.join(_quartiles(observations, by), by).filter(_usual(spread)).select(*observations.columns)


def rollup(observations: DataFrame, by: list[str], spread: float = SPREAD) -> DataFrame:
    """low, median, high, mean, n and sources of each group, with the confidence of its sold observations. Outliers beyond
    ``spread`` interquartile ranges count everywhere but in the median."""
    sold = F.col("kind") == "sold"
    more = [F.count_if(~F.col("_usual")).alias("outliers"), F.count_if(sold).alias("_sold"), F.count_distinct(F.when(sold, F.col("source_id"))).alias("_from")]
    columns = [*by, "low", "median", "high", "mean", "n", "sources", "outliers", "_sold", "_from"]
    marked = observations.join(_quartiles(observations, by), by).withColumn("_usual", _usual(spread))
    middle = F.median(F.when(F.col("_usual"), F.col("price"))).alias("median")
    rows = _by_size(marked, by, lambda r: _summed(r, by, middle, *more).select(*columns), lambda r: _with_median(_summed(r, by, *more), r.filter("_usual"), by).select(*columns))
    return rows.withColumn("confidence", confidence(F.col("_sold"), F.col("_from"))).drop("_sold", "_from")


def confidence(sold: Column, sources: Column) -> Column:
    return F.when((sold >= 5) & (sources >= 2), "high").when(sold >= 2, "medium").otherwise("low")


def rated(observations: DataFrame, by: list[str]) -> DataFrame:
    """Confidence of each group's sold observations; listings alone are low."""
    sold = F.col("kind") == "sold"
    rows = observations.groupBy(*by).agg(F.count_if(sold).alias("sold"), F.count_distinct(F.when(sold, F.col("source_id"))).alias("sources"))
    return rows.withColumn("confidence", confidence(F.col("sold"), F.col("sources")))


def converted(observations: DataFrame, rates: DataFrame, quote: str) -> DataFrame:
    """Prices in one currency at the rate of the observation's day; without a rate the price is NULL."""
    r = rates.filter(F.col("quote") == quote).select("day", F.col("base").alias("currency"), "rate")
    rows = observations.join(r, ["day", "currency"], "left")
    price = F.when(F.col("currency") == quote, F.col("price")).otherwise(F.col("price") * F.col("rate"))
    return rows.withColumn("price", price).withColumn("currency", F.lit(quote)).drop("rate")


def valued(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Value of each user's holdings at (printing_id, price); unpriced copies are counted, not valued at zero."""
    rows = holdings.join(prices.select("printing_id", "price"), "printing_id", "left")
    return rows.groupBy("user_id").agg(
        F.coalesce(F.sum(F.col("quantity") * F.col("price")), F.lit(0.0)).alias("value"), F.count_if(F.col("price").isNotNull()).alias("priced"),
        F.count_if(F.col("price").isNull()).alias("unpriced"),
    )


def profit(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """Gain over cost, of copies with both a cost and a price."""
    rows = holdings.filter("unit_cost IS NOT NULL").join(prices.select("printing_id", "price"), "printing_id")
    return rows.groupBy("user_id").agg(F.sum(F.col("quantity") * (F.col("price") - F.col("unit_cost"))).alias("gain"))


def movers(day_prices: DataFrame, first_day, last_day, min_n: int, k: int) -> DataFrame:
    """The k largest relative moves between two days' medians, of printings with enough observations on both."""
    at = lambda d, name: day_prices.filter((F.col("day") == F.lit(d).cast("date")) & (F.col("n") >= min_n)).select("printing_id", F.col("median").alias(name))
    rows = at(first_day, "was").join(at(last_day, "now"), "printing_id").withColumn("move", F.col("now") / F.col("was") - 1)
    return rows.orderBy(F.desc(F.abs("move")), "printing_id").limit(k)


def against_market(listings: DataFrame, day_prices: DataFrame, days: int = 30) -> DataFrame:
    """A listing's price against the median of daily medians of the days before it."""
    p = day_prices.select(F.col("printing_id").alias("_p"), F.col("day").alias("_d"), "median")
    near = (F.col("printing_id") == F.col("_p")) & (F.col("_d") < F.col("day")) & (F.col("_d") >= F.date_sub("day", days))
    rows = listings.join(p, near, "left").groupBy("listing_id").agg(F.first("price").alias("price"), F.median("median").alias("market"))
    return rows.withColumn("below", 1 - F.col("price") / F.col("market"))


def fired(times: Sequence, last, cooldown) -> list:
    """Of ascending times those that fire: the first, or the first a cooldown after ``last``, and then each first one a
    cooldown after the one before."""
    out, at = [], 0
    while True:
        if last is not None:
            at = bisect_left(times, last + cooldown, at)
        if at >= len(times):
            return out
        out.append(last := times[at])


def _walked(cooldown: int):
    """Rows (alert_id, at in microseconds) ordered by both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alert = last = None
        for batch in batches:
            ids, at = batch.column(0), batch.column(1).to_numpy()
            if not len(at):
                continue
            # runs of one alert; only the first can go on from the batch before
            new = np.flatnonzero(pc.not_equal(ids.slice(1), ids.slice(0, len(at) - 1)).fill_null(True).to_numpy(zero_copy_only=False)) + 1
            where, times = [], []
            for b, e in zip([0, *new.tolist()], [*new.tolist(), len(at)], strict=True):
                own = ids[b].as_py()
                found = fired(at[b:e], last if own == alert else None, cooldown)
                alert, last = own, found[-1] if found else last if own == alert else None
                where += [b] * len(found)
                times += [int(t) for t in found]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(where, pa.int64())), pa.array(times, pa.int64())], names=["alert_id", "at"])

    return run


def alerts(crossings: DataFrame, cooldown_hours: int) -> DataFrame:
    """Of crossings (alert_id, at, confidence), those that fire: never on low confidence, once in a cooldown.

    A cooldown starts at the last alert fired, so each alert's crossings are walked in order, as a sorted stream of
    which only the last time fired is kept. Crossings without a time or an alert don't fire.
    """
    rows = crossings.filter("confidence != 'low' AND alert_id IS NOT NULL AND at IS NOT NULL").select("alert_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    ordered = rows.repartition("alert_id").sortWithinPartitions("alert_id", "at")
    walked = ordered.mapInArrow(_walked(cooldown_hours * 3_600_000_000), ordered.schema)
    return walked.select("alert_id", F.timestamp_micros("at").alias("at"))


def order_status(events: DataFrame) -> DataFrame:
    """The latest event of each order is its status."""
    return events.groupBy("order_id").agg(F.max(F.struct("at", "event_id", "type")).alias("e")).select("order_id", F.col("e.type").alias("status"), F.col("e.at").alias("since"))


def overlisted(listings: DataFrame, holdings: DataFrame) -> DataFrame:
    """(user, printing) with more copies listed than held."""
    held = holdings.groupBy("user_id", "printing_id").agg(F.sum("quantity").alias("held"))
    asked = listings.groupBy("user_id", "printing_id").agg(F.sum("quantity").alias("listed"))
    return asked.join(held, ["user_id", "printing_id"], "left").fillna(0, ["held"]).filter("listed > held")


def reputation(ratings: DataFrame, orders: DataFrame) -> DataFrame:
    """Average of one rating (the first) for each completed order of a seller."""
    done = orders.filter("status = 'completed'").select("order_id", "seller_id")
    one = ratings.groupBy("order_id").agg(F.min(F.struct("at", "stars")).alias("r"))
    return done.join(one, "order_id").groupBy("seller_id").agg(F.avg("r.stars").alias("stars"), F.count("*").alias("rated"))


def ranked_windows(rows: DataFrame, by: str, order: Column, k: int) -> DataFrame:
    """The first k rows of each group in an order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_r") <= k).drop("_r")
