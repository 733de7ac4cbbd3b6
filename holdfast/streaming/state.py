"""Keyed state (an extension): price alerts with a cooldown in event time, and the notification outbox with retries.

State stands in Spark's state store under the query's checkpoint, so it survives lost executors and restarts. Queries
need ``spark.sql.streaming.stateStore.providerClass`` set to ROCKSDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.collection import MAX_ATTEMPTS
from ..operators.pricing import fired

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cooldown(StatefulProcessor):
    """Crossings of one alert wait until the watermark has passed them, so that they are judged in order of time however
    they arrive; what is later than the watermark is dropped before. Of equal times one is kept. Times are microseconds."""

    def __init__(self, cooldown_ms: int):
        self.cooldown = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros bigint")
        self.waiting = handle.getMapState("waiting", "micros bigint", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {int(at) for frame in rows for at in frame["micros"]}
        for at in known:
            self.waiting.updateValue((at,), (1,))
        for moment in {self._ms(at) for at in known}:
            self.handle.registerTimer(moment)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due = sorted(at for (at,) in self.waiting.keys() if self._ms(at) <= until)
        before = self.last.get()[0] if self.last.exists() else None
        out = fired(due, before, self.cooldown * 1000)
        for at in due:
            self.waiting.removeKey((at,))
        if out:
            before = out[-1]
            self.last.update((before,))
        if before is not None:
            free = self._ms(before) + self.cooldown
            if free > until:
                self.handle.registerTimer(free)  # then the cooldown is over
            elif self.last.exists():
                self.last.clear()
        if out:
            yield pd.DataFrame({"alert_id": [key[0]] * len(out), "micros": out})

    @staticmethod
    def _ms(micros: int) -> int:
        return -(-micros // 1000)  # upwards: a timer never fires before its row


def alerts(crossings: DataFrame, cooldown_hours: int, late: str) -> DataFrame:
    """Like pricing.alerts over a stream of crossings (alert_id, at, confidence): the same rows as over the whole table,
    as long as none is later than ``late``. An alert fires once the watermark has passed it."""
    rows = crossings.filter("confidence != 'low' AND alert_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late).select("alert_id", "at", F.unix_micros("at").alias("micros"))
    kind = dict(crossings.dtypes)["alert_id"]
    found = rows.groupBy("alert_id").transformWithStateInPandas(Cooldown(cooldown_hours * 3_600_000), f"alert_id {kind}, micros bigint", "append", "EventTime")
    return found.select("alert_id", F.timestamp_micros("micros").alias("at"))


class Outbox(StatefulProcessor):
    """Attempts at delivering one message. A replayed attempt (the same number) counts once. A failed one is due again
    after a pause that doubles; after MAX_ATTEMPTS failures the message is dead, and nothing is sent after a success.
    State is forgotten ``keep_ms`` after the last change."""

    def __init__(self, pause_ms: int, keep_ms: int):
        self.pause, self.keep = pause_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tried = handle.getMapState("tried", "attempt int", "ok boolean", ttlDurationMs=self.keep)
        self.state = handle.getValueState("state", "state string", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get()[0] if self.state.exists() else None
        if before in ("sent", "dead"):
            for _ in rows:
                pass
            return
        new = False
        for frame in rows:
            for attempt, ok in sorted(zip(frame["attempt"].tolist(), frame["ok"].tolist(), strict=True)):
                if not self.tried.containsKey((int(attempt),)):
                    self.tried.updateValue((int(attempt),), (bool(ok),))
                    new = True
        if before is not None and not new:
            return
        done = [ok for (ok,) in self.tried.values()]
        state = "sent" if any(done) else "dead" if len(done) >= MAX_ATTEMPTS else "pending"
        self.state.update((state,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state == "pending":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.pause * 2 ** (len(done) - 1))
        yield self._row(key, len(done), state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[0] == "pending":
            yield self._row(key, len(list(self.tried.keys())), "retry")

    @staticmethod
    def _row(key, tries: int, state: str) -> pd.DataFrame:
        return pd.DataFrame({"message_id": [key[0]], "tries": [tries], "state": [state]})


def outbox(attempts: DataFrame, pause_ms: int = 60_000, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """Of a stream of attempts (message_id, attempt, ok) the changes of messages: message_id, tries and state, which is
    pending, retry (due again), sent or dead. The last change of a message is its row in collection.outbox."""
    kind = dict(attempts.dtypes)["message_id"]
    rows = attempts.select("message_id", F.col("attempt").cast("int").alias("attempt"), "ok")
    return rows.groupBy("message_id").transformWithStateInPandas(Outbox(pause_ms, keep_ms), f"message_id {kind}, tries int, state string", "update", "ProcessingTime")
