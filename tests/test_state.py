"""Alerts and outbox as keyed state: streams give what batches do, with late and replayed rows."""

import datetime as dt
import random

import pandas as pd
import pytest

from holdfast.operators import collection as C
from holdfast.operators import pricing as P
from holdfast.streaming import state as T

START = dt.datetime(2026, 1, 1)


@pytest.fixture()
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, T.ROCKSDB)
    yield spark
    spark.conf.unset(name)


def run(stream, folder, checkpoint, mode):
    out = []
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).trigger(availableNow=True)
    query.option("checkpointLocation", str(folder / checkpoint)).start().awaitTermination(240)
    return out


def crossings(seed, alerts=3, n=120):
    r = random.Random(seed)
    return [(f"a{r.randrange(alerts)}", START + dt.timedelta(seconds=r.choice((r.randrange(10 * 86_400), 86_400 * r.randrange(10)))), r.choice(("high", "low", "medium"))) for _ in range(n)]


def plain(rows, hours):
    out = []
    for alert in {a for a, _, _ in rows}:
        last = None
        for at in sorted(t for a, t, c in rows if a == alert and c != "low"):
            if last is None or at >= last + dt.timedelta(hours=hours):
                out.append((alert, last := at))
    return sorted(out)


SCHEMA = "alert_id string, at timestamp, confidence string"


def test_alerts_in_batch_equal_a_plain_walk(spark):
    rows = crossings(1, 4, 500)
    df = spark.createDataFrame(rows + [(None, START, "high"), ("a1", None, "high")], SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    assert sorted(map(tuple, P.alerts(df, 30).collect())) == plain(rows, 30)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_stream_of_alerts_equals_the_batch_with_late_and_repeated_rows(store, tmp_path):
    rows = crossings(2)
    parts = [rows[:60], rows[60:] + rows[:20], [("end", START + dt.timedelta(days=90), "high")]]  # all within the delay, some twice
    for part in parts:
        store.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = store.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(T.alerts(stream, 24, "20 days"), tmp_path, "c", "append")
    assert sorted(got) == plain(rows, 24)
    # a restart goes on from the state: rows of the past are late, and nothing fires twice
    store.createDataFrame([("a0", START, "high"), ("end", START + dt.timedelta(days=200), "high")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run(T.alerts(stream, 24, "20 days"), tmp_path, "c", "append") == [("end", START + dt.timedelta(days=90))]


def test_the_outbox_stream_ends_where_the_batch_does(store, tmp_path):
    rows = [("sent", 1, False), ("sent", 2, True), ("dead", 1, False), *(("dead", i, False) for i in range(2, 6)), ("open", 1, False), ("open", 2, False), ("first", 1, True)]
    for part in (rows[:4], rows[3:9] + rows[:2], rows[9:] + rows[:1]):  # with replays
        store.createDataFrame(part, "message_id string, attempt int, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = store.readStream.schema("message_id string, attempt int, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # open timers would keep the query going
    got = [r for r in run(T.outbox(stream, pause_ms=3_600_000), tmp_path, "c", "update") if r[2] != "retry"]
    store.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    last = {m: (n, s) for m, n, s in got}
    attempts = store.createDataFrame(rows, "message_id string, attempt int, ok boolean")
    want = {r["message_id"]: (r["tries"], r["state"]) for r in C.outbox(attempts.select("message_id").distinct(), attempts).collect()}
    assert last == want == {"sent": (2, "sent"), "dead": (5, "dead"), "open": (2, "pending"), "first": (1, "sent")}
    assert len([r for r in got if r[0] == "sent"]) == 1 and len([r for r in got if r[2] == "dead"]) == 1


class Timers:
    def getCurrentProcessingTimeInMs(self):
        return 1000


class Kept(dict):
    """State variables and handle of one key, in memory."""

    exists, get, update = (lambda s: "v" in s), (lambda s: s.get_("v")), (lambda s, v: s.__setitem__("v", v))
    get_ = dict.get

    def getMapState(self, name, *_, **__):
        return self.setdefault(name, MapKept())

    def getValueState(self, name, *_, **__):
        return self.setdefault(name, Kept())

    def listTimers(self):
        return list(self.setdefault("timers", []))

    def registerTimer(self, at):
        self.setdefault("timers", []).append(at)

    def deleteTimer(self, at):
        self["timers"].remove(at)


class MapKept(dict):
    containsKey, updateValue = dict.__contains__, dict.__setitem__


def test_pauses_double_and_a_retry_is_announced():
    handle, box = Kept(), T.Outbox(100, 10_000)
    box.init(handle)
    frame = lambda n, ok: iter([pd.DataFrame({"attempt": [n], "ok": [ok]})])
    due = []
    for n in range(1, 6):
        list(box.handleInputRows(("m",), frame(n, False), Timers()))
        due.append(handle.listTimers())
        if n < 5:
            assert next(box.handleExpiredTimer(("m",), Timers(), None)).iloc[0].tolist() == ["m", n, "retry"]
    assert due == [[1100], [1200], [1400], [1800], []]
    assert list(box.handleExpiredTimer(("m",), Timers(), None)) == [] == list(box.handleInputRows(("m",), frame(6, True), Timers()))
