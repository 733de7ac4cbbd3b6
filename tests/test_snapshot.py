"""Transactions over snapshots, run records and counts taken while writing."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators import ingest as I
from holdfast.sources import bucketed as B
from holdfast.sources import snapshot as N

from .test_ingest import raw


def test_a_run_is_logged_and_a_second_pass_changes_nothing(spark, tmp_path):
    held, log = N.Snapshot(spark, str(tmp_path / "s")), str(tmp_path / "runs")
    assert held.version() == 0 and held.read("cards") is None
    rows = raw(spark, {}, {"rarity": "rare"}, {"collector_number": "BS1-002"}, {"collector_number": "BS1-003", "rarity": "mythic"})
    first = N.import_catalog(held, rows, "csv", log)
    assert [first[c] for c in ("status", "version", "cards_added", "printings_added", "rejected")] == ["success", 1, 2, 3, 1]
    again = N.import_catalog(held, rows, "csv", log)
    assert [again[c] for c in ("version", "cards_added", "cards_unchanged", "rejected")] == [1, 0, 2, 1]
    renamed = N.import_catalog(held, raw(spark, {"name": "Atlas II"}), "csv", log)
    assert [renamed[c] for c in ("version", "cards_updated", "cards_added")] == [2, 1, 0]
    assert {r["name"] for r in held.read("cards").collect()} == {"Atlas II", "Atlas"} and held.read("printings").count() == 3
    assert {r["name"] for r in held.read("cards", 1).collect()} == {"Atlas"}
    assert sorted((r["status"], r["finished_at"] is not None) for r in N.runs(spark, log).collect()) == [("success", True)] * 3


def test_what_fails_midway_leaves_the_old_snapshot(spark, tmp_path):
    held, log = N.Snapshot(spark, str(tmp_path / "s")), str(tmp_path / "runs")
    N.import_catalog(held, raw(spark, {}), "csv", log)
    bad = raw(spark, {"name": "new"}).withColumn("name", F.expr("raise_error('unreadable')"))
    with pytest.raises(Exception, match="unreadable"):
        N.import_catalog(held, bad, "csv", log)
    with pytest.raises(ZeroDivisionError), held.transaction() as change:
        change.write("cards", held.read("cards").limit(0))
        raise ZeroDivisionError
    assert held.version() == 1 and held.read("cards").count() == 1
    assert [p.name for p in (tmp_path / "s").iterdir() if not p.name.endswith(".crc")] == ["version-000000001"]
    failed = N.runs(spark, log).filter("status = 'failed'").first()
    assert "unreadable" in failed["error_summary"] and failed["version"] is None


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    held = N.Snapshot(spark, str(tmp_path / "s"))
    row = spark.range(1)
    with held.transaction() as one, held.transaction() as two, held.transaction() as three:
        for t in (one, two, three):
            t.write("t", row)
        assert one.commit() == 1
        with pytest.raises(N.SnapshotChanged, match="not the last"):
            two.commit()
        held.version = lambda: 0  # as if the other came between the look and the rename
        with pytest.raises(N.SnapshotChanged, match="there already"):
            three.commit()
        del held.version
    assert held.read("t").count() == 1


def test_counts_are_taken_while_rows_are_written(spark, tmp_path):
    logs = spark.createDataFrame([("info", "2026-01-01"), ("info", "2026-01-30"), ("error", "2026-01-01"), ("error", "2024-01-01"), (None, None)], "level string, at string").withColumn("at", F.col("at").cast("timestamp"))
    read = spark.sparkContext.accumulator(0)
    counted = logs.rdd.map(lambda r: read.add(1) or tuple(r)).toDF(logs.schema)
    assert N.sweep(counted, str(tmp_path / "l"), F.lit("2026-02-05").cast("timestamp")) == {"kept": 3, "removed": 2}
    assert read.value == 5 and spark.read.parquet(str(tmp_path / "l")).count() == 3
    adds = spark.createDataFrame([("a", "u", "p", "mint", False, 2, 1), ("b", "u", "p", "mint", False, 3, 2)], "item_id string, user_id string, printing_id string, condition string, is_graded boolean, quantity int, seq int")
    held = N.Snapshot(spark, str(tmp_path / "h"))
    assert N.import_holdings(held, adds) == {"version": 1, "items": 1, "copies_added": 5}
    assert N.import_holdings(held, adds.withColumn("printing_id", F.lit("q"))) == {"version": 2, "items": 2, "copies_added": 5}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_bucketed_tables_leave_the_catalog_where_it_lies(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = spark.range(400)
        catalog = B.bucketed(ids.select(F.concat(F.lit("S"), F.col("id") % 3).alias("set_code"), F.col("id").cast("string").alias("collector_number"), F.col("id").alias("v")), "t", I.CARD_KEY)
        new = ids.filter("id % 10 = 0").select(F.concat(F.lit("S"), F.col("id") % 3).alias("set_code"), F.col("id").cast("string").alias("collector_number"), F.lit(-1).cast("long").alias("v"))
        plan = _plan(I.upserted(new, catalog, I.CARD_KEY))
        assert plan.count("Exchange hashpartitioning") == 1  # what is new is shuffled to the buckets
        after = B.upserted(new, catalog, "t")
        assert after.count() == 400 and after.filter("v = -1").count() == 40
        assert _plan(I.upserted(new, after, I.CARD_KEY)).count("Exchange hashpartitioning") == 1
        left, right = (B.bucketed(ids.select("id", F.lit(n).alias(n)), n, ["id"]) for n in ("a", "b"))
        assert "Exchange hashpartitioning" not in _plan(left.join(right, "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
