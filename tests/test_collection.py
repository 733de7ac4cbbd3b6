"""A collector's CSV, rank statistics and the completion grid against plain versions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from holdfast.operators import collection as C
from holdfast.operators import holdings as H
from holdfast.operators import operations as O
from holdfast.operators import pricing as P
from holdfast.sources import collection_csv


@pytest.mark.parametrize(("mark", "encoding"), [(",", "utf-8"), (";", "utf-8-sig"), ("\t", "cp1252"), (",", "utf-16")])
def test_csv_is_read_matched_and_judged(spark, tmp_path, mark, encoding):
    rows = [
        ["Set_Code", "Collector_Number", "NAME", "Rarity", "Finish", "Language", "Edition", "Condition", "Quantity"],
        ["BS1", "001", "Flàme", "Holo", "Holofoil", "EN", "1st", "Near Mint", "2"], ["BS1", "002", f'"Two{mark} parts"', "", "", "", "", "", ""],
        ["BS1", "", "Flàm’e", "", "", "", "", "mint", "1"], ["BS1", "009", "nothing like it", "", "", "", "", "mint", "1"], ["BS1", "001", "Flàme", "Holo", "Holofoil", "EN", "1st", "nm?", "1"],
    ]
    (tmp_path / "c.csv").write_bytes("\n".join(mark.join(r) for r in rows).encode(encoding))
    read = collection_csv.read(spark, str(tmp_path / "c.csv"))
    printings = spark.createDataFrame([("p1", "BS1", "001", "Flàme", "holo_rare", "foil", "en", "first"), ("p2", "BS1", "002", "Two", "common", "normal", "en", "first")], "printing_id string, set_code string, collector_number string, name string, rarity string, finish string, language string, edition string")
    found = collection_csv.matched(read, printings)
    got = [(r["match"], r["rung"]) for r in found.orderBy("line").collect()]
    assert got == [("p1", 2), ("p2", 3), ("p1", 4), (None, None), ("p1", 2)]
    state = spark.createDataFrame([("u", "p1", "near_mint", False, 1)], "user_id string, printing_id string, condition string, is_graded boolean, quantity int")
    said = {r["outcome"]: (r["rows"], r["copies"]) for r in collection_csv.dry_run(found, state, "u").collect()}
    assert said == {"update": (1, 2), "add": (2, 2), "reject": (2, 2)}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_names_meet_at_every_length_and_only_they(spark):
    r = random.Random(5)

    def edited(name):
        letters = list(name)
        for _ in range(r.choice((0, 1, 2, 2, 3))):
            at = r.randrange(len(letters) + 1)
            letters[at : at + r.randint(0, 1)] = r.choice(("", "a", "b"))
        return "".join(letters)

    bases = ["".join(r.choice("abc") for _ in range(n)) for n in (1, 2, 5, 9, 20, 30, 31, 32, 33, 34, 35, 50, 200)]
    known = sorted({("S", edited(b)) for b in bases for _ in range(4)} | {("T", b) for b in bases[:3]})
    asked = sorted({("S", edited(b)) for b in bases for _ in range(8)} | {("S", ""), ("U", "abc")})
    df = lambda rows: spark.createDataFrame(rows, "set_code string, name string")
    got = sorted(map(tuple, collection_csv.near_names(df(asked), df(known)).collect()))
    assert got == sorted((s, a, b) for s, a in asked for t, b in known if s == t and _distance(a, b) <= 2) and len(got) > 100


def test_candidates_of_a_large_set_grow_in_proportion(spark):
    def candidates(n):
        names = spark.range(n).select(F.lit("S").alias("set_code"), F.md5(F.col("id").cast("string")).alias("name")).withColumn("name", F.substring("name", 1, 12))
        asked = names.filter(F.xxhash64("name") % 20 == 0).select("set_code", F.concat(F.substring("name", 1, 6), F.lit("x"), F.substring("name", 7, 6)).alias("name"))
        plan = collection_csv.near_names(asked, names)
        assert plan.count() == asked.count()
        return "CartesianProduct" in plan._jdf.queryExecution().executedPlan().toString() or "NestedLoop" in plan._jdf.queryExecution().executedPlan().toString()

    assert not candidates(5_000)


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_latency_ranks_equal_a_sort(spark, monkeypatch, most):
    monkeypatch.setattr(O, "RANGE", most)
    r = random.Random(3)
    rows = [("a", r.choice([1.0, 2.5, r.random() * 9])) for _ in range(501)] + [("b", 4.0)] * 90 + [("c", -1.0), ("d", 1.0), ("d", 2.0), ("e", None)]
    rows += [("f", float(i)) for i in range(3000)] + [("f", 1e300), ("f", -1e300)]
    got = {x["level"]: (x["n"], x["median"], x["p95"], x["max"]) for x in O.latency(spark.createDataFrame(rows, "level string, ms double"), ["level"], "ms").collect()}
    for level in "abcdf":
        v = sorted(m for lv, m in rows if lv == level and m is not None)
        assert got[level] == (len(v), pytest.approx(statistics.median(v)), v[max(int(len(v) * 0.95) - 1, 0)], v[-1])
    assert len(got) == 5


def test_an_outlier_leaves_no_wide_range(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE", 1000)
    seen = []
    save = O.Scratch.save
    monkeypatch.setattr(O.Scratch, "save", lambda self, df, name, **o: seen.append((name, save(self, df, name, **o))) or seen[-1][1])
    values = spark.range(100_000).select(F.lit("x").alias("g"), F.when(F.col("id") == 5, 1e12).otherwise(F.col("id").cast("double") / 7).alias("v"))
    assert O.quantiles(values, ["g"], "v", [0.5]).first()["q"][0] == pytest.approx(50000.5 / 7)
    last = [df for name, df in seen if name.startswith("wanted")][-1]
    assert last.agg(F.max("inside")).first()[0] <= 1000


def test_prices_of_groups_too_large_for_a_buffer(spark, monkeypatch):
    r = random.Random(8)
    rows = [(p, "2026-01-01", r.randrange(4), r.choice((1.0, 2.0, r.random() * 50, 900.0)), r.choice(("sold", "listed"))) for p in [1] * 400 + [2] * 7 + [3] for _ in range(1)]
    df = spark.createDataFrame(rows, "printing_id int, day string, source_id int, price double, kind string")
    usual = [P.daily(df), P.rollup(df, ["printing_id"]), P.within_spread(df, ["printing_id"], 0.5)]
    want = [sorted(map(tuple, x.collect())) for x in usual]
    monkeypatch.setattr(P, "HOT", 6)
    monkeypatch.setattr(O, "RANGE", 30)
    hot = [P.daily(df), P.rollup(df, ["printing_id"]), P.within_spread(df, ["printing_id"], 0.5)]
    for a, b, w in zip(hot, usual, want, strict=True):
        got = sorted(map(tuple, a.select(*b.columns).collect()))
        assert [tuple(pytest.approx(y) if isinstance(y, float) else y for y in x) for x in w] == got


def test_patches_are_refused_before_handles_are_dealt_and_profiles_stay_one_row(spark):
    profiles = spark.createDataFrame([(i, f"old_{i}", "USD") for i in range(1, 6)], "user_id long, handle string, currency string")
    patches = [(1, "wanted", "euros", 1), (2, "wanted", None, 1), (3, "first", "EUR", 1), (3, "second", None, 2), (4, None, "JPY", 1), (4, None, "GBP", 2), (5, "old_1", None, 1), (5, "x", "EUR", 2)]
    after, refused = O.patched_profiles(profiles, spark.createDataFrame(patches, "user_id long, handle string, currency string, seq int"))
    assert sorted(map(tuple, after.collect())) == [(1, "old_1", "USD"), (2, "wanted", "USD"), (3, "second", "EUR"), (4, "old_4", "GBP"), (5, "old_5", "USD")]
    assert sorted(r["user_id"] for r in refused.collect()) == [1, 5, 5]


def test_completion_grid_in_blocks_of_sets(spark, monkeypatch):
    monkeypatch.setattr(H, "SETS_A_BLOCK", 2)
    sets = spark.createDataFrame([(f"S{i}", i) for i in range(5)], "set_code string, card_count int")
    state = spark.createDataFrame([("u", "p0", 3)], "user_id string, printing_id string, quantity int")
    printings, cards = spark.createDataFrame([("p0", "c0")], "printing_id string, card_id string"), spark.createDataFrame([("c0", "S4")], "card_id string, set_code string")
    users = spark.createDataFrame([("u",), ("v",), ("v",)], "user_id string")
    got = {(r["user_id"], r["set_code"]): (r["owned"], r["quantity"], r["ratio"]) for r in H.rebuilt(users, state, printings, cards, sets).collect()}
    assert len(got) == 10 and got["u", "S4"] == (1, 3, 0.25) and got["v", "S4"] == (0, 0, 0.0) == got["u", "S0"]


def test_facets_and_private_columns(spark):
    rows = spark.createDataFrame([("i", "p", "mint", 2, "attic")], "item_id string, printing_id string, condition string, quantity int, storage_location string")
    with pytest.raises(LookupError, match="colour"):
        C.faceted(rows, {"colour": ["red"]})
    assert C.public(rows.withColumn("price_paid", F.lit(9))).columns == ["printing_id", "condition", "quantity"]
