"""Normalising, fingerprints, diff and coverage, on rows shaped like hand-kept files."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators import ingest as I
from holdfast.sources.csv_seed import CsvSeed, SeedNotFound, seed, write_seed

BASE = {"set_code": "BS1", "collector_number": "BS1-001", "name": "Atlas", "card_type": "elestral", "element": "earth", "rune_type": "", "attack": "10", "defence": "5", "spirit_cost": '{"earth": 2}', "rarity": "common", "finish": "normal", "language": "en", "edition": "unlimited"}


def raw(spark, *rows):
    full = [{**BASE, **r, "line": i + 2, "source_ref": f"BS1.csv:{i + 2}"} for i, r in enumerate(rows)]
    return spark.createDataFrame(full)


CASES = [
    ([{"rarity": "mythic"}], "unknown_rarity", "rarity", 2),
    ([{"finish": "glitter"}], "unknown_finish", "finish", 2),
    ([{"edition": "third"}], "unknown_edition", "edition", 2),
    ([{}, {"rarity": "mythic"}], "unknown_rarity", "rarity", 3),
    ([{}, {"rarity": "rare", "attack": "11", "name": "Other"}], "conflicting_card_fields", "name", 3),
    ([{}, {}], "duplicate_printing_key", "rarity", 3),
    ([{"collector_number": ""}], "missing_required_field", "collector_number", 2),
    ([{"name": " "}], "missing_required_field", "name", 2),
    ([{"element": ""}], "type_field_mismatch", "element", 2),
    ([{"element": "plasma"}], "type_field_mismatch", "element", 2),
    ([{"card_type": "rune", "rune_type": "invoke"}], "type_field_mismatch", "attack", 2),
    ([{"card_type": "rune", "attack": "", "defence": ""}], "type_field_mismatch", "rune_type", 2),
    ([{"card_type": "gadget"}], "missing_required_field", "card_type", 2),
    ([{"spirit_cost": "two"}], "invalid_spirit_cost", "spirit_cost", 2),
    ([{"spirit_cost": '{"plasma": 1}'}], "invalid_spirit_cost", "spirit_cost", 2),
    ([{"spirit_cost": '{"earth": -1}'}], "invalid_spirit_cost", "spirit_cost", 2),
    ([{"spirit_cost": '{"earth": true}'}], "invalid_spirit_cost", "spirit_cost", 2),
    ([{"attack": "lots"}], "type_field_mismatch", "attack", 2),
    ([{"name": "", "rarity": "mythic", "attack": "lots"}], "missing_required_field", "name", 2),
    ([{"edition": "x"}, {"rarity": "mythic"}], "unknown_edition", "edition", 2),
]


def test_every_rejection_by_precedence(spark):
    rows = [{**r, "set_code": f"C{i}"} for i, (case, *_) in enumerate(CASES) for r in case]
    lines = [line for case, *_ in CASES for line in range(2, 2 + len(case))]
    full = [{**BASE, **r, "line": n, "source_ref": f"f:{n}"} for r, n in zip(rows, lines, strict=True)]
    cards, rejections = I.normalised(spark.createDataFrame(full))
    got = {r["set_code"]: (r["reason_code"], r["field"], r["source_ref"]) for r in rejections.collect()}
    assert got == {f"C{i}": (reason, field, f"f:{line}") for i, (_, reason, field, line) in enumerate(CASES)}
    assert cards.count() == 0


def test_messages_name_both_values_and_records_are_those_of_the_row_at_fault(spark):
    rows = raw(spark, {}, {"rarity": "rare", "attack": "11"}, {"set_code": "X", "rarity": "mythic Bearer abc.def"}, {"collector_number": "", "name": "lost"}, {"set_code": "Y"}, {"set_code": "Y"})
    got = {r["source_ref"]: r for r in I.normalised(rows)[1].collect()}
    assert got["BS1.csv:3"]["message"] == '`attack` is "10" at BS1.csv:2 and "11" at BS1.csv:3.' and '"attack":"11"' in got["BS1.csv:3"]["raw_record"]
    assert got["BS1.csv:4"]["message"].startswith("Unrecognised rarity mythic") and "Bearer [redacted]" in got["BS1.csv:4"]["raw_record"]
    assert got["BS1.csv:5"]["message"] == "A value for `collector_number` must be given." and '"name":"lost"' in got["BS1.csv:5"]["raw_record"]
    assert (got["BS1.csv:7"]["reason_code"], got["BS1.csv:7"]["set_code"]) == ("duplicate_printing_key", "Y") and len(got) == 4


def test_the_plan_reads_its_input_once_in_five_joins_at_most(spark):
    rows = raw(spark, {}, {"rarity": "rare"})
    judged = I._judged(I._folded(rows))._jdf.queryExecution().optimizedPlan().toString()
    cards, rejections = (x._jdf.queryExecution().optimizedPlan().toString() for x in I.normalised(rows))
    assert judged.count("Join ") <= 4 and cards.count("Join ") == 1 == rejections.count("Join ")
    assert max(map(len, (judged, cards, rejections))) < 60_000


def test_a_good_card_with_two_printings_and_folded_spellings(spark):
    cards, rejections = I.normalised(raw(spark, {"rarity": "Holo Rare", "finish": "Holofoil", "edition": "1st"}, {"rarity": "rare"}, {"collector_number": ""}))
    card = cards.first()
    assert [(p["rarity"], p["finish"], p["edition"]) for p in card["printings"]] == [("holo_rare", "foil", "first"), ("rare", "normal", "unlimited")]
    assert (card["attack"], card["element"], card["spirit_cost"]) == (10, "earth", {"earth": 2})
    assert [r["field"] for r in rejections.collect()] == ["collector_number"]


def test_second_pass_changes_nothing_and_the_first_does(spark):
    cards, rejections = I.normalised(raw(spark, {}, {"rarity": "rare"}, {"collector_number": "BS1-002"}, {"collector_number": "BS1-003", "rarity": "mythic"}))
    empty_cards, empty_printings = I.card_rows(cards).limit(0), I.printing_rows(cards).limit(0)
    first = I.card_outcomes(cards, empty_cards, empty_printings)
    assert {r["outcome"] for r in first.collect()} == {"added"} and first.agg(F.sum("printings_added")).first()[0] == 3
    again = I.card_outcomes(cards, I.card_rows(cards), I.printing_rows(cards))
    assert {(r["outcome"], r["printings_added"]) for r in again.collect()} == {("unchanged", 0)}
    status = spark.createDataFrame([("BS1", False), ("XX", True)], "set_code string, failed boolean")
    report = I.run_report(first, rejections, status).first()
    assert (report["cards_added"], report["printings_added"], report["rejected"], report["status"]) == (2, 3, 1, "partial")


def test_a_new_printing_or_another_name_makes_a_card_updated(spark):
    old, _ = I.normalised(raw(spark, {}, {"collector_number": "BS1-002"}))
    new, _ = I.normalised(raw(spark, {"name": "Atlas II"}, {"collector_number": "BS1-002"}, {"collector_number": "BS1-002", "rarity": "rare"}))
    got = {r["collector_number"]: (r["outcome"], r["printings_added"]) for r in I.card_outcomes(new, I.card_rows(old), I.printing_rows(old)).collect()}
    assert got == {"BS1-001": ("updated", 0), "BS1-002": ("updated", 1)}


@pytest.mark.parametrize(
    ("numbers", "declared", "missing"),
    [
        (["BS1-001", "BS1-003"], 4, ["BS1-002", "BS1-004"]),
        (["BS1-001", "X-002"], 4, []),
        (["A"], 2, []),
        (["BS1-009"], 4, []),
        (["BS1-01", "BS1-002"], 4, []),
        (["BS1-001", "BS1-002"], 2, []),
    ],
)
def test_coverage_names_gaps_only_where_they_are_sure(spark, numbers, declared, missing):
    cards = spark.createDataFrame([("S", n) for n in numbers], "set_code string, collector_number string")
    sets = spark.createDataFrame([("S", declared), ("E", 3)], "set_code string, card_count int")
    rows = {r["set_code"]: r for r in I.coverage(cards, sets).collect()}
    assert rows["S"]["missing_numbers"] == missing and rows["S"]["missing_count"] == max(0, declared - len(numbers))
    assert (rows["E"]["imported"], rows["E"]["missing_count"], rows["E"]["complete"]) == (0, 3, False)


def test_files_keep_line_numbers_and_fill_defaults(spark, tmp_path):
    (tmp_path / "sets.csv").write_text("set_code,name,series,released_on,card_count\n# note\nFE01,Base,,2023-05-01,126\n,x,,,\nBS1,,Main,soon,many\n")
    (tmp_path / "FE01.csv").write_text('﻿# head\n\nset_code,collector_number,name,spirit_cost,rarity,finish\r\nFE01,BS1-001,"A, B","{""earth"":2}",rare\n  # no\nFE01,BS1-002,C,,common,foil\n', encoding="utf-8")
    source = CsvSeed(spark, str(tmp_path))
    sets = {r["set_code"]: r for r in source.sets().collect()}
    assert (sets["FE01"]["card_count"], str(sets["FE01"]["released_on"]), sets["BS1"]["name"], sets["BS1"]["card_count"], sets["BS1"]["released_on"]) == (126, "2023-05-01", "BS1", 0, None)
    assert [r[0] for r in source.available_sets().collect()] == ["BS1", "FE01"]
    assert source.set_meta("fe01").first()["set_code"] == "FE01"
    with pytest.raises(SeedNotFound):
        source.set_meta("ZZ")
    rows = sorted(source.fetch(["FE01"]).collect(), key=lambda r: r["line"])
    assert [(r["source_ref"], r["name"], r["spirit_cost"], r["finish"], r["language"], r["edition"]) for r in rows] == [
        ("FE01.csv:4", "A, B", '{"earth":2}', "normal", "en", "first"), ("FE01.csv:6", "C", "", "foil", "en", "first"),
    ]
    (tmp_path / "none.csv").write_text("# nothing\n")
    assert seed(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0 == source.fetch(["FE01", "ZZ"]).filter("set_code = 'ZZ'").count()


def test_choosing_a_set_opens_its_file_only(spark, tmp_path):
    (tmp_path / "A1.csv").write_text('"collector_number","na""me",extra\n1,x,y\n2\n', encoding="utf-8")
    (tmp_path / "B1.csv").write_bytes(b"collector_number,name\n1,\xff\xfe\n")  # no UTF-8: raises if read
    names = ["collector_number", 'na"me']
    chosen = seed(spark, str(tmp_path), names, ["A1", "none"])
    assert [(r["source_ref"], r["collector_number"], r['na"me']) for r in chosen.orderBy("line").collect()] == [("A1.csv:2", "1", "x"), ("A1.csv:3", "2", "")]
    assert chosen.rdd.getNumPartitions() == 1
    both = seed(spark, str(tmp_path), ["collector_number"], ["A1"])
    assert both.filter("line = 2").unionByName(both.filter("line = 3")).count() == 2
    assert seed(spark, str(tmp_path / "A1.csv"), ["*"]).columns == ["set_code", "file", "line", "source_ref", "collector_number", 'na"me', "extra"]
    with pytest.raises(Exception, match="decode"):
        seed(spark, str(tmp_path)).count()


def test_written_sets_come_back_and_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([("A", "2", 'q"1, 2'), ("A", "1", " # é"), ("B", "1", None)], "set_code string, collector_number string, name string")
    root = tmp_path / "seed"
    write_seed(rows, str(root))
    got = sorted((r["source_ref"], r["name"]) for r in seed(spark, f"file://{root}").collect())
    assert got == [("A.csv:2", " # é"), ("A.csv:3", 'q"1, 2'), ("B.csv:2", "")]
    with pytest.raises(Exception, match="name a file"):
        write_seed(spark.createDataFrame([("C", "1", ""), ("x/y", "1", "")], rows.schema).coalesce(1), str(root))
    assert sorted(p.name for p in root.glob("*.csv")) == ["A.csv", "B.csv"]
    write_seed(rows.filter("set_code = 'B'"), str(root), "overwrite")
    assert sorted(p.name for p in root.glob("*.csv")) == ["B.csv"]
