"""Streaming forms (an extension): windowed counts, watermarked deduplication, sessions, and state merged per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.scalars import forwarded
from ..operators import holdings


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and their value by window and type; with ``late`` a watermark bounds the state of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    counts = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


def sliding(events: DataFrame, width: str, slide: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    counts = rows.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "events")


def deduplicated(events: DataFrame, key: list[str], late: str) -> DataFrame:
    """One row for each key; a stream forgets keys once the watermark has passed them."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)


def merge_adds(adds: DataFrame, read_state: Callable[[], DataFrame], read_last: Callable[[], int], write_state: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Each micro-batch of adds folds into the state once. One writer: a batch holds each key once after its own merge.

    read_last gives the number of the last batch that the state holds (-1: none); write_state must keep state and
    number together, so that a batch that is replayed after a failure is known and left alone. Only keys that the batch
    touches are merged again; other rows pass as they are.
    """

    def fold(batch: DataFrame, number: int) -> None:
        if number <= read_last():
            return
        state = read_state()
        new = batch.select(*state.columns)
        key = ["user_id", "printing_id"]
        touched = new.select(*key).distinct()
        both = state.join(touched, key, "left_semi").select(*state.columns).unionByName(new)
        merged = holdings.merged(both).select(*(c if c != "seq" else F.col("first_seq").alias("seq") for c in state.columns))
        write_state(state.join(touched, key, "left_anti").select(*state.columns).unionByName(merged), number)

    return adds.writeStream.foreachBatch(fold)


def route_logs(logs: DataFrame, keep: Callable[[DataFrame], None], forward: Callable[[DataFrame], None], dropped: Callable[[int, Exception], None] | None = None) -> DataStreamWriter:
    """Every log row is kept, those that are severe or of security forwarded as well.

    With ``dropped`` a batch that can't be forwarded is given up: dropped gets the number of its rows and the error, and
    the stream goes on; what is kept is whole either way.
    """

    def split(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("forwarded", forwarded(F.col("level"), F.col("category"))).persist()
        try:
            keep(rows)
            try:
                forward(rows.filter("forwarded"))
            except Exception as e:
                if dropped is None:
                    raise
                dropped(rows.filter("forwarded").count(), e)
        finally:
            rows.unpersist()

    return logs.writeStream.foreachBatch(split)
