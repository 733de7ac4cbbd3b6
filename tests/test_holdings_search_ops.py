"""Search tiers, holdings, completion and operations on small fixtures with known results."""

import datetime as dt
import json

from pyspark.sql import functions as F

from holdfast.functions import scalars as S
from holdfast.functions import vocabulary as V
from holdfast.operators import holdings as H
from holdfast.operators import operations as O
from holdfast.operators import pricing as P
from holdfast.operators import search as R
from holdfast.sources import registry, sinks
from holdfast.streaming import streams as T

CARDS = [(1, "BS1", "BS1-001", "Atlas", "elestral", "earth"), (2, "BS1", "BS1-002", "Atlas Prime", "elestral", "fire"), (3, "BS1", "BS1-003", "Great Atlas", "spirit", "earth"), (4, "FE1", "FE1-001", "Teratlas", "elestral", "earth"), (5, "FE1", "FE1-002", "Other", "rune", None), (6, "FE1", "atlas-9", "Numbered", "rune", None)]


def catalog(spark):
    cards = spark.createDataFrame(CARDS, "card_id long, set_code string, collector_number string, name string, card_type string, element string")
    sets = spark.createDataFrame([("BS1", "Base", dt.date(2020, 1, 1), 3), ("FE1", "First", None, 0)], "set_code string, name string, released_on date, card_count int")
    rows = [("p1", 1, "rare", "normal", "first"), ("p2", 1, "common", "foil", "first"), ("p3", 2, "secret", "normal", "first"), ("p4", 3, "odd", "normal", "first")]
    return cards, sets, spark.createDataFrame(rows, "printing_id string, card_id long, rarity string, finish string, edition string")


def test_search_ranks_tiers_and_treats_wildcards_as_text(spark):
    cards, sets, printings = catalog(spark)
    q = R.Search(" ATLAS ")
    found = R.page(R.matches(cards, sets, q), q).collect()
    assert [(r["card_id"], r["match_kind"]) for r in found] == [(1, "exact_name"), (2, "name_prefix"), (3, "word_prefix"), (6, "collector_number"), (4, "infix")]
    for term in ("%%", "atl_s", "a", ""):
        assert R.matches(cards, sets, R.Search(term)).count() == 0
    assert {r["card_id"] for r in R.matches(cards, sets, R.Search("bs1")).collect()} == {1, 2, 3}
    both = R.matches(cards, sets, R.Search("atlas", elements=["earth"], set_codes=["BS1"]))
    assert {r["card_id"] for r in both.collect()} == {1, 3}
    assert [r["card_id"] for r in R.matches(cards, sets, R.Search("atlas", rarities=["secret", "rare"]), printings).orderBy("card_id").collect()] == [1, 2]
    pages = [[r["card_id"] for r in R.page(R.matches(cards, sets, p), p).collect()] for p in (R.Search("atlas", limit=2), R.Search("atlas", limit=2, offset=2))]
    assert pages == [[1, 2], [3, 6]]
    rows = {r["card_id"]: (r["printing_id"], r["printing_count"]) for r in R.hydrated(cards, printings).collect()}
    assert rows[1] == ("p2", 2) and rows[5] == (None, 0)


def test_an_index_finds_what_a_scan_does_and_reads_one_bucket(spark, tmp_path):
    cards, sets, printings = catalog(spark)
    index = R.GramIndex(spark, str(tmp_path / "grams")).write(cards.unionByName(spark.createDataFrame([(7, "FE1", None, None, "rune", None), (8, "FE1", "Z", "İé%_", "rune", None)], cards.schema)))
    for q in (R.Search(" ATLAS "), R.Search("at"), R.Search("%%"), R.Search("é%"), R.Search("bs1"), R.Search("fe1-00"), R.Search("s p"), R.Search("none"), R.Search("a"), R.Search(), R.Search("atlas", elements=["earth"], rarities=["rare"])):
        scan = R.matches(index._postings().drop("gram", "bucket").distinct(), sets, q, printings)
        found = R.matches(index.candidates(q), sets, q, printings)
        assert sorted((r["card_id"], r["tier"]) for r in found.collect()) == sorted((r["card_id"], r["tier"]) for r in scan.collect())
    plan = index.candidates(R.Search("atlas"))
    assert len({f.rsplit("/", 2)[1] for f in plan.inputFiles()}) > 1  # all buckets before pruning
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text and "EqualTo(gram," in text


def test_a_search_for_any_accent(spark):
    cards = spark.createDataFrame([(1, "S", "1", "Ätlas"), (2, "S", "2", "great ATLÁS"), (3, "S", "3", "other")], "card_id long, set_code string, collector_number string, name string")
    sets = spark.createDataFrame([("S", None)], "set_code string, released_on date")
    assert {(r["card_id"], r["match_kind"]) for r in R.matches(cards, sets, R.Search("atlàs", any_accent=True)).collect()} == {(1, "exact_name"), (2, "word_prefix")}
    assert R.matches(cards, sets, R.Search("atlàs")).count() == 0


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id string, user_id string, printing_id string, condition string, is_graded boolean, quantity int, seq int")


def test_adds_merge_but_graded_copies_never_do(spark):
    rows = [("a", "u", "p1", "mint", False, 2, 1), ("b", "u", "p1", "mint", False, 3, 2), ("c", "v", "p1", "mint", False, 1, 3), ("d", "u", "p1", "mint", True, 1, 4), ("e", "u", "p1", "mint", True, 1, 5)]
    got = {r["item_id"]: (r["quantity"], r["merge_condition"]) for r in H.merged(items(spark, rows)).collect()}
    assert got == {"a": (5, "mint"), "c": (1, "mint"), "d": (1, None), "e": (1, None)}
    flags = {r["item_id"]: r["merged"] for r in H.merged_flag(items(spark, rows)).collect()}
    assert flags == {"a": False, "b": True, "c": False, "d": False, "e": False}


def test_an_edit_that_collides_leaves_the_row_that_was_there(spark):
    state = items(spark, [("a-lp", "u", "p", "lightly_played", False, 3, 1), ("nm", "u", "p", "near_mint", False, 2, 2)]).drop("seq")
    patch = spark.createDataFrame([("a-lp", "near_mint", None, None)], "item_id string, condition string, is_graded boolean, quantity int")
    assert [(r["item_id"], r["quantity"]) for r in H.edited(state, patch).collect()] == [("nm", 5)]
    gone = spark.createDataFrame([("v", "nm")], "user_id string, item_id string")
    assert H.removed(state, gone).count() == 2


def test_several_patches_of_an_item_leave_one_row(spark):
    state = items(spark, [("a", "u", "p", "mint", False, 3, 1), ("b", "u", "q", "mint", True, 1, 2)]).drop("seq")
    patches = spark.createDataFrame([("a", "near_mint", None, 5, 1), ("a", None, None, 7, 2), ("a", "damaged", None, None, 3), ("b", None, None, 2, 2), ("b", None, None, 4, 1)], "item_id string, condition string, is_graded boolean, quantity int, seq int")
    assert sorted((r["item_id"], r["condition"], r["quantity"]) for r in H.edited(state, patches).collect()) == [("a", "damaged", 7), ("b", "mint", 2)]


def test_completion_counts_cards_not_printings_and_rebuild_has_zero_rows(spark):
    cards, sets, printings = catalog(spark)
    held = items(spark, [("a", "u", "p1", "mint", False, 2, 1), ("b", "u", "p2", "mint", False, 1, 2)])
    row = H.completion(held, printings, cards, sets).first()
    assert (row["owned"], row["quantity"], round(row["ratio"], 4)) == (1, 3, 0.3333)
    users = spark.createDataFrame([("u",), ("w",)], "user_id string")
    rebuilt = {(r["user_id"], r["set_code"]): (r["owned"], r["declared"], r["ratio"]) for r in H.rebuilt(users, held, printings, cards, sets).collect()}
    assert rebuilt[("w", "BS1")] == (0, 3, 0.0) and rebuilt[("u", "FE1")] == (0, 0, 0.0) and len(rebuilt) == 4
    old = H.completion(held, printings, cards, sets)
    after = H.recomputed(old, held.limit(0), held, printings, cards, sets).first()
    assert (after["owned"], after["quantity"]) == (0, 0)


def test_staleness_rollup_and_health(spark):
    now = dt.datetime(2026, 1, 31)
    ages = spark.createDataFrame([(h, now - dt.timedelta(hours=h)) for h in (1, 47, 49, 169)] + [(0, None)], "h int, at timestamp")
    _, state = S.staleness(F.col("at"), F.lit(now))
    assert [r[0] for r in ages.select("h", state.alias("s")).orderBy("h").select("s").collect()] == ["never_run", "fresh", "fresh", "ageing", "stale"]
    rows = spark.createDataFrame([("a", "F:9"), ("a", "F:10"), ("a", "F:2"), ("b", "F:1")], "reason_code string, source_ref string")
    assert [tuple(r) for r in O.rejection_rollup(rows).collect()] == [("a", 3, "F:10"), ("b", 1, "F:1")]
    runs = spark.createDataFrame([(1, "csv", "success", now - dt.timedelta(hours=9), now - dt.timedelta(hours=8)), (2, "csv", "failed", now, now)], "run_id long, source string, status string, started_at timestamp, finished_at timestamp")
    registry.register("csv", lambda: None)
    registry.register("idle", lambda: None)
    health = {r["source"]: r["state"] for r in O.source_health(registry.as_table(spark), runs, F.lit(now)).collect()}
    assert health == {"csv": "never_run", "idle": "never_run"}


def test_redaction_at_any_depth(spark):
    deep = {"a": 1}
    for _ in range(50):
        deep = {"x": deep}
    texts = [{"password": "x", "list": [{"api_key": 1}, "Bearer abc.def"]}, {"detail": [{"loc": ["body", "token"], "input": "s", "msg": "m"}]}, deep]
    rows = spark.createDataFrame([(json.dumps(t),) for t in texts] + [("no json",), (None,)], "t string").select(S.redact_json("t").alias("r")).collect()
    assert json.loads(rows[0]["r"]) == {"password": "[redacted]", "list": [{"api_key": "[redacted]"}, "Bearer [redacted]"]}
    assert json.loads(rows[1]["r"])["detail"][0] == {"loc": ["body", "token"], "input": "[redacted]", "msg": "m"}
    bottomless = spark.createDataFrame([("[" * 100_000 + "]" * 100_000,)], "t string").select(S.redact_json("t").alias("r")).first()["r"]
    assert bottomless.endswith("…[truncated]")
    assert "[max-depth]" in rows[2]["r"] and rows[3]["r"] == "no json" and rows[4]["r"] is None


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("c")).first()["c"]
    assert pick(V.slug(F.lit("Holo-Rare / X"))) == "holo_rare_x" and pick(V.rarity(F.lit(" Secret  Rare "))) == "secret"
    assert pick(V.strip(F.lit(" \t x \n"))) == "x"
    assert [pick(S.as_int(F.lit(x))) for x in ("+5", "5.7", "1_000", "99999999999", "")] == [5, None, None, None, None]
    assert pick(S.alt_text(F.lit("Atlas"), F.lit("Base"), F.lit("holo_rare"))) == "Atlas — Base holo rare"
    assert pick(S.offset_of(S.cursor_of(F.lit(25)))) == 25 and pick(S.offset_of(F.lit("!!"))) is None
    assert pick(S.percent_label(F.lit(1.7))) == "100%" and pick(S.csv_safe(F.lit("=1+1"))) == "'=1+1"
    assert len(pick(S.scrub_text(F.lit("x" * 3000)))) == 2048 + len("…[truncated]")


def test_alerts_and_sinks(spark, tmp_path):
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    rows = spark.createDataFrame([("a", at(0), "high"), ("a", at(5), "high"), ("a", at(24), "medium"), ("a", at(60), "low")], "alert_id string, at timestamp, confidence string")
    assert sorted(r["at"] for r in P.alerts(rows, 24).collect()) == [at(0), at(24)]
    assert sinks.save_snapshot(rows, rows.limit(0), str(tmp_path / "none")) is False and not (tmp_path / "none").exists()
    assert sinks.save_snapshot(rows, rows, str(tmp_path / "some")) is True
    sinks.export_csv(spark.createDataFrame([("=x", 1)], "a string, b int"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["a"] == "'=x"


def test_a_stream_of_adds_merges_like_the_batch(spark, tmp_path):
    rows = [("a", "u", "p1", "mint", False, 2, 1), ("b", "u", "p1", "mint", False, 3, 2), ("d", "u", "p1", "mint", True, 1, 4)]
    df = items(spark, rows)
    df.filter("seq = 1").write.parquet(str(tmp_path / "in"))
    df.filter("seq > 1").write.mode("append").parquet(str(tmp_path / "in"))
    held = {"state": df.limit(0), "last": -1}

    def write(new, number):
        held.update(state=spark.createDataFrame(new.collect(), df.schema), last=number)

    def run(checkpoint):
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = T.merge_adds(source, lambda: held["state"], lambda: held["last"], write).trigger(availableNow=True)
        query.option("checkpointLocation", str(tmp_path / checkpoint)).start().awaitTermination(120)
        return {(r["printing_id"], r["is_graded"], r["quantity"]) for r in held["state"].collect()}

    want = {("p1", False, 5), ("p1", True, 1)}
    assert run("c") == want
    assert run("replayed") == want  # batches that the state holds already are left alone


def test_windowed_stream_counts_equal_the_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i // 4, i), "click", 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    T.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, T.tumbling(df).collect()))


def test_logs_that_cannot_be_forwarded_are_counted_and_kept(spark, tmp_path):
    logs = spark.createDataFrame([("info", "http"), ("error", "http"), ("info", "security"), (None, None)], "level string, category string")
    logs.coalesce(1).write.parquet(str(tmp_path / "in"))
    kept, lost = [], []

    def forward(rows):
        raise ConnectionError("no sink")

    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in"))
    query = T.route_logs(stream, lambda rows: kept.extend(rows.collect()), forward, lambda n, e: lost.append((n, str(e)))).trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert lost == [(2, "no sink")] and sorted(r["forwarded"] for r in kept) == [False, False, True, True]


def test_scrub_text_finds_what_its_plain_looks_stand_for(spark):
    texts = ["BeArEr aB.c-_9 x", "bearer", "eyJ" + "h" * 20, "x eyJ" + "h" * 19, "BEARER\u0130 t", None, "", "bearer a eyJ" + "k" * 30 + " " + "z" * 3000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.scrub_text(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: None if t is None else S._scrubbed(t) for i, t in enumerate(texts)}


def test_costly_work_on_a_small_file_is_spread(spark):
    """A parquet file with one row group is one task's; what follows is every task's."""
    from holdfast.plans.queries import QUERIES

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert QUERIES["scalar_traps"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == n


def test_raw_rows_and_postings_are_made_in_all_tasks(spark):
    from holdfast.plans.domain import Domain
    from holdfast.plans.queries import _raw

    n, d = int(spark.conf.get("spark.sql.shuffle.partitions")), Domain(spark, "/root/testdata/sf0.001")
    assert _raw(d).rdd.getNumPartitions() >= 3 * n and R.GramIndex.rows(d.cards).rdd.getNumPartitions() == n


def test_edits_shuffle_the_state_once_by_item(spark):
    """What is by item is read from buckets; only the outcome of the collapse is dealt by item once more."""
    from holdfast.plans import QUERIES

    for name in ("holdings_edit_attributes", "holdings_edit_collapse"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(item_id") <= (name == "holdings_edit_collapse"), plan


def test_completion_is_dealt_once_by_user_and_set(spark):
    """Holdings are shuffled for the two joins and the counts only; distinct printings are made after they are dealt."""
    from holdfast.plans import QUERIES
    from holdfast.plans.domain import Domain

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    d = Domain(spark, "/root/testdata/sf0.001")
    made = plan(H.measured(d.adds, d.printings, d.cards))
    assert made.count("Exchange hashpartitioning(user_id") == 1 and "printing_id" not in "".join(x for x in made.split("\n") if "Exchange hashpartitioning(user_id" in x).split(", 4)")[0]
    one = plan(d.printings)
    assert one.index("HashAggregate") < one.index("Exchange") and "HashAggregate" not in one[one.index("Exchange") :]
    held = QUERIES["set_completion_bucketed"](spark, "/root/testdata/sf0.001")
    assert "item_id" not in plan(held) and not any("item_id" in spark.table(t.name).columns for t in spark.catalog.listTables() if t.name.startswith("held_") and spark.table(t.name).inputFiles()[0].split("/table/")[0] in "".join(held.inputFiles()))


def test_snapshots_are_packed_tightly(spark, tmp_path):
    from holdfast.sources import snapshot

    snapshot.write_counted(spark.range(10), f"{tmp_path}/t", n=F.count(F.lit(1)))
    assert all(".zstd." in f.name for f in (tmp_path / "t").glob("part-*"))
