"""Snapshots of several tables that change in one transaction, and the runs that make them.

A snapshot is a folder with one folder for each version, which holds the tables. A transaction writes all tables to a
staging folder and commits with one rename to the next version, which fails if another writer has taken it. Readers see
whole versions only; what fails midway leaves the last one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import holdings as H
from ..operators import ingest as I
from ..operators import operations as O
from ..scratch import Scratch, delete


class SnapshotChanged(RuntimeError):
    pass


@dataclass
class Snapshot:
    spark: SparkSession
    path: str

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def version(self) -> int:
        """The last version; 0 if there is none."""
        store, root = self._fs()
        if not store.exists(root):
            return 0
        names = [s.getPath().getName() for s in store.listStatus(root)]
        return max((int(n.removeprefix("version-")) for n in names if n.startswith("version-")), default=0)

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table of a version, by default the last; None if there is no such table yet."""
        version = self.version() if version is None else version
        store, _ = self._fs()
        path = f"{self.path}/version-{version:09d}/{table}"
        return self.spark.read.parquet(path) if version and store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path)) else None

    def transaction(self) -> Transaction:
        return Transaction(self, self.version())


@dataclass
class Transaction:
    """Use it with ``with``: leaving it without commit drops what it wrote."""

    snapshot: Snapshot
    base: int
    staging: str = field(init=False)
    committed: bool = field(default=False, init=False)

    def __post_init__(self):
        self.staging = f"{self.snapshot.path}/.staging-{uuid.uuid4().hex}"

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if not self.committed:
            delete(self.snapshot.spark, self.staging)

    def read(self, table: str) -> DataFrame | None:
        """A table of the version that the transaction began with."""
        return self.snapshot.read(table, self.base)

    def write(self, table: str, rows: DataFrame, **counts: Column) -> dict:
        """Writes a table of the next version; counts are taken of its rows while they are written."""
        return write_counted(rows, f"{self.staging}/{table}", **counts)

    def commit(self) -> int:
        """The number of the new version. Raises SnapshotChanged if there is one since the transaction began."""
        jvm, conf = self.snapshot.spark._jvm, self.snapshot.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        number = self.base + 1
        source, target = path(self.staging), path(f"{self.snapshot.path}/version-{number:09d}")
        never_over = self.snapshot.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never_over[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            if self.snapshot.version() != self.base:
                raise SnapshotChanged(f"version {self.base} is not the last one any more")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf).rename(source, target, never_over)
        except Py4JJavaError as e:
            raise SnapshotChanged(f"version {number} is there already") from e
        self.committed = True
        return number


def write_counted(rows: DataFrame, path: str, **counts: Column) -> dict:
    """Writes rows and returns aggregates of them that the same job takes."""
    if not counts:
        rows.write.option("compression", "zstd").parquet(path)
        return {}
    seen = Observation()
    rows.observe(seen, *(c.alias(n) for n, c in counts.items())).write.option("compression", "zstd").parquet(path)
    return {n: v or 0 for n, v in seen.get.items()}


def sweep(logs: DataFrame, path: str, now: Column, short_days: int = 30, long_days: int = 365) -> dict:
    """Writes the logs that stay and returns how many rows stayed and how many went, in one reading."""
    seen, stays = Observation(), O.stays(now, short_days, long_days)
    logs.observe(seen, F.count_if(stays).alias("kept"), F.count_if(~stays).alias("removed")).filter(stays).write.mode("overwrite").parquet(path)
    return seen.get


RUN = "run_id string, source string, status string, started_at timestamp, finished_at timestamp, version int, cards_added long, cards_updated long, cards_unchanged long, printings_added long, rejected long, error_summary string"


def _log(spark: SparkSession, path: str, **row) -> dict:
    row = {c.split()[0]: None for c in RUN.split(", ")} | row
    spark.createDataFrame([tuple(row.values())], RUN).coalesce(1).write.mode("append").parquet(path)
    return row


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One row a run: its finish if it has one, else its start, which counts as running."""
    rows = spark.read.schema(RUN).parquet(path)
    return rows.groupBy("run_id").agg(F.max(F.struct(F.col("finished_at").isNotNull().alias("done"), *rows.columns)).alias("r")).select("r.*").drop("done")


def import_catalog(snapshot: Snapshot, raw: DataFrame, source: str, log: str) -> dict:
    """Imports raw rows into the snapshot's tables cards, printings and rejections; returns the run's record.

    The run is logged when it starts and when it ends, however it ends. Counters are taken while tables are written.
    Without a change nothing is committed and the version stays.
    """
    spark, run_id, started = snapshot.spark, uuid.uuid4().hex, datetime.now()
    own = {"run_id": run_id, "source": source, "started_at": started}
    _log(spark, log, **own, status="running")
    try:
        with snapshot.transaction() as change:
            scratch = Scratch(spark, "import")
            cards, rejected = I.normalised(raw)
            cards = scratch.save(cards, "cards")
            new_cards, new_printings = I.card_rows(cards), I.printing_rows(cards)
            old_cards, old_printings = (o if (o := change.read(t)) is not None else n.limit(0) for t, n in (("cards", new_cards), ("printings", new_printings)))
            is_ = lambda o: F.count_if(F.col("outcome") == o)
            outcomes = I.card_outcomes(cards, old_cards, old_printings)
            counts = change.write("outcomes", outcomes, cards_added=is_("added"), cards_updated=is_("updated"), cards_unchanged=is_("unchanged"), printings_added=F.sum("printings_added"))
            counts |= change.write("rejections", rejected, rejected=F.count(F.lit(1)))
            version = change.base
            if counts["cards_added"] or counts["cards_updated"]:
                change.write("cards", I.upserted(new_cards, old_cards, I.CARD_KEY))
                change.write("printings", I.upserted(new_printings, old_printings, I.PRINTING_KEY))
                version = change.commit()
    except Exception as e:
        _log(spark, log, **own, status="failed", finished_at=datetime.now(), error_summary=f"{type(e).__name__}: {e}"[:500])
        raise
    return _log(spark, log, **own, status="success", finished_at=datetime.now(), version=version, **counts)


def import_holdings(snapshot: Snapshot, adds: DataFrame) -> dict:
    """A collector's matched rows into the table holdings, all or none of them; returns the version and how many items
    the table has and how many copies were added.

    adds: the columns of holdings (item_id, user_id, printing_id, condition, is_graded, quantity, seq).
    """
    with snapshot.transaction() as change:
        state = change.read("holdings")
        columns = ["item_id", "user_id", "printing_id", "condition", "is_graded", "quantity", "seq"]
        adds = adds.select(*columns)
        both = adds if state is None else state.select(*columns).unionByName(adds)
        merged = H.merged(both).select(*(F.col("first_seq").alias("seq") if c == "seq" else F.col(c) for c in columns))
        before = 0 if state is None else state.agg(F.sum("quantity")).first()[0] or 0
        counts = change.write("holdings", merged, items=F.count(F.lit(1)), copies=F.sum("quantity"))
        return {"version": change.commit(), "items": counts["items"], "copies_added": counts["copies"] - before}
