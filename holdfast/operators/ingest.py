"""Catalog ingest: raw rows to cards with printings or one rejection each, fingerprints, diff and upsert, run report.

Raw rows: set_code, file, line, source_ref and string columns. A card is emitted whole or rejected whole with the
first reason in a fixed precedence. Judging carries small numbers of problems; messages and records are made at the end,
of the rows at fault only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..scratch import Scratch

# The fields that all rows of a card must agree on, in the order of report, and the required ones.
CARD_FIELDS = ["name", "card_type", "element", "rune_type", "subtype", "attack", "defence", "spirit_cost", "rules_text", "flavour_text", "artist"]
REQUIRED = ["collector_number", "name", "card_type", "rarity"]
PRINTING_FIELDS = ["rarity", "finish", "language", "edition", "image_url", "is_tracked_for_price"]
RAW = list(dict.fromkeys(["collector_number", *CARD_FIELDS, *PRINTING_FIELDS]))
VERSION = "1"
CARD_KEY = ["set_code", "collector_number"]


def _first(cases: list[tuple[int, Column]]) -> Column:
    """The number of the first condition that holds; NULL if none does."""
    return F.coalesce(*(F.when(condition, n) for n, condition in cases))


# Reasons and fields of rejections, in the order in which they count. A message that ends in a space is
# followed by the value.
PROBLEMS = [
    *(("missing_required_field", c, f"A value for `{c}` must be given.") for c in REQUIRED),
    ("conflicting_card_fields", "", ""),
    ("missing_required_field", "card_type", "Unrecognised card_type "),
    ("type_field_mismatch", "element", "Unrecognised element "),
    ("type_field_mismatch", "rune_type", "Unrecognised rune_type "),
    ("type_field_mismatch", "attack", "`attack` must be an integer."),
    ("type_field_mismatch", "defence", "`defence` must be an integer."),
    ("type_field_mismatch", "element", "This type of card must have an element."),
    ("type_field_mismatch", "rune_type", "Only runes have a `rune_type`."),
    ("type_field_mismatch", "rune_type", "A rune must have a `rune_type`."),
    ("type_field_mismatch", "attack", "This type of card has no `attack` or `defence`."),
    ("invalid_spirit_cost", "spirit_cost", "Invalid cost "),
    ("unknown_rarity", "rarity", "Unrecognised rarity "),
    ("unknown_finish", "finish", "Unrecognised finish "),
    ("unknown_edition", "edition", "Unrecognised edition "),
    ("duplicate_printing_key", "rarity", "Two rows give the same printing."),
]
CONFLICT, RARITY, TWICE = (next(i for i, p in enumerate(PROBLEMS, 1) if p[0] == code) for code in ("conflicting_card_fields", "unknown_rarity", "duplicate_printing_key"))


def with_columns(raw: DataFrame) -> DataFrame:
    """Raw rows with every known column present and stripped; NULL counts as empty."""
    return raw.withColumns({c: V.strip(F.col(c).cast("string")) if c in raw.columns else F.lit("") for c in RAW})


def _folded(raw: DataFrame) -> DataFrame:
    """Raw rows with a number of their own, their folded printing, the number of a fault of their own, and two hashes of
    what a card's rows must agree on."""
    rows = with_columns(raw).withColumns(
        {
            "row": F.monotonically_increasing_id(), "_rarity": V.rarity(F.col("rarity")), "_finish": V.finish(F.col("finish")), "_edition": V.edition(F.col("edition")),
            "_language": F.lower(F.when(F.col("language") == "", "en").otherwise(F.col("language"))), "_tracked": S.is_tracked(F.col("is_tracked_for_price")),
            "_one": F.xxhash64(*CARD_FIELDS), "_two": F.xxhash64(F.lit(1), *reversed(CARD_FIELDS)),
        }
    )
    return rows.withColumn("fault", _first([(RARITY + i, F.col(f"_{c}").isNull()) for i, c in enumerate(("rarity", "finish", "edition"))]))


def _judged(rows: DataFrame) -> DataFrame:
    """One row a card: h (its first raw row), problem (a number, NULL for a good card), at (the row at fault), the
    conflict's field and values, and the card's own columns folded.

    What decides are minima and maxima, which combine map-side, so a card with very many rows is no single task's.
    """
    place = F.struct("line", "source_ref", "row")
    groups = rows.groupBy(*CARD_KEY).agg(
        F.min(F.struct("line", "source_ref", "row", *RAW)).alias("h"), F.min(F.when(F.col("fault").isNotNull(), F.struct(place.alias("place"), "fault"))).alias("bad"),
        ((F.min("_one") != F.max("_one")) | (F.min("_two") != F.max("_two"))).alias("apart"),
    )
    # rows are looked at one by one only where a card's rows disagree or give a printing twice
    h = lambda c: F.col(f"h.{c}")
    differs = F.coalesce(*(F.when(F.col(c) != h(c), F.struct(F.lit(c).alias("name"), h(c).alias("one"), F.col(c).alias("two"))) for c in CARD_FIELDS))
    other = rows.join(groups.filter("apart").select(*CARD_KEY, "h"), CARD_KEY).select(*CARD_KEY, place.alias("place"), differs.alias("differs")).filter("differs IS NOT NULL")
    other = other.groupBy(*CARD_KEY).agg(F.min(F.struct("place", "differs")).alias("other"))
    printing_key = [*CARD_KEY, "_rarity", "_finish", "_language", "_edition"]
    given = rows.groupBy(*printing_key).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    twice = rows.join(given, printing_key).filter(place > F.col("first")).groupBy(*CARD_KEY).agg(F.min(place).alias("twice"))
    groups = groups.drop("apart").join(other, CARD_KEY, "left").join(twice, CARD_KEY, "left")

    cost, cost_ok = S.spirit_cost(h("spirit_cost"))
    groups = groups.withColumns({"_type": V.card_type(h("card_type")), "_element": V.element(h("element")), "_rune": V.rune_type(h("rune_type")), "_attack": S.as_int(h("attack")), "_defence": S.as_int(h("defence")), "_cost": cost, "_cost_ok": cost_ok})
    kind, bearer = F.col("_type"), F.col("_type").isin("elestral", "spirit")
    conditions = [
        *(h(c) == "" for c in REQUIRED), F.col("other").isNotNull(), kind.isNull(),
        *((h(c) != "") & F.col(f).isNull() for c, f in (("element", "_element"), ("rune_type", "_rune"), ("attack", "_attack"), ("defence", "_defence"))),
        bearer & F.col("_element").isNull(), bearer & F.col("_rune").isNotNull(), (kind == "rune") & F.col("_rune").isNull(),
        kind.isin("spirit", "rune") & (F.col("_attack").isNotNull() | F.col("_defence").isNotNull()), ~F.col("_cost_ok"),
    ]
    # rows in file order: the earliest row's fault counts, a value that is unknown before a printing given twice
    earlier = F.col("bad").isNotNull() & (F.col("twice").isNull() | (F.col("bad.place") <= F.col("twice")))
    fault = F.when(earlier, F.col("bad.fault")).when(F.col("twice").isNotNull(), TWICE)
    groups = groups.withColumn("problem", F.coalesce(_first(list(enumerate(conditions, 1))), fault))
    late = F.when(F.col("problem") == CONFLICT, F.col("other.place.row")).when(F.col("problem") == TWICE, F.col("twice.row")).when(F.col("problem") >= RARITY, F.col("bad.place.row"))
    return groups.withColumn("at", F.coalesce(late, h("row"))).select(*CARD_KEY, "h", "problem", "at", "other.differs", "_type", "_element", "_rune", "_attack", "_defence", "_cost")


def _rejections(judged: DataFrame, rows: DataFrame) -> DataFrame:
    """Messages and records, made of the rows at fault only."""
    of = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in PROBLEMS)), F.col("problem"))
    unnumbered = rows.filter("collector_number = ''").select(F.lit(1).alias("problem"), F.lit(None).cast("string").alias("first_ref"), F.lit(None).cast(judged.schema["differs"].dataType).alias("differs"), F.struct(*CARD_KEY, "source_ref", *RAW[1:]).alias("f"))
    found = judged.filter("problem IS NOT NULL").select("problem", F.col("h.source_ref").alias("first_ref"), "differs", F.col("at").alias("row"))
    found = found.join(rows.select("row", F.struct(*CARD_KEY, "source_ref", *RAW[1:]).alias("f")), "row").drop("row").unionByName(unnumbered)
    field = F.when(F.col("problem") == CONFLICT, F.col("differs.name")).otherwise(of(1))
    value = F.coalesce(*(F.when(F.col("field") == c, F.col(f"f.{c}")) for c in RAW), F.lit(""))
    conflict = F.format_string('`%s` is "%s" at %s and "%s" at %s.', "differs.name", "differs.one", "first_ref", "differs.two", "f.source_ref")
    message = F.when(F.col("problem") == CONFLICT, conflict).when(of(2).endswith(" "), F.concat(of(2), value)).otherwise(of(2))
    record = S.scrub_text(F.to_json(F.struct(*(F.col(f"f.{c}").alias(c) for c in RAW))))
    return found.withColumn("field", field).select("f.set_code", "f.collector_number", of(0).alias("reason_code"), "field", "f.source_ref", message.alias("message"), record.alias("raw_record"))


def normalised(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, rejections). cards have nested printings; rejections have set_code, collector_number, reason_code, field,
    source_ref, message and raw_record (the row at fault as JSON).

    The folded rows and the judged cards are written to the shared folder, so that raw is read once.
    """
    scratch = Scratch(raw.sparkSession, "normalise")
    rows = scratch.save(_folded(raw), "rows")
    numbered = rows.filter("collector_number != ''")
    judged = scratch.save(_judged(numbered), "judged")
    h = lambda c: F.col(f"h.{c}")
    text = lambda c: F.nullif(h(c), F.lit("")).alias(c)
    good = judged.filter("problem IS NULL").select(
        *CARD_KEY,
        F.struct(
            h("name").alias("name"), F.col("_type").alias("card_type"), F.col("_element").alias("element"), F.col("_rune").alias("rune_type"), text("subtype"), F.col("_attack").alias("attack"),
            F.col("_defence").alias("defence"), F.col("_cost").alias("spirit_cost"), text("rules_text"), text("flavour_text"), text("artist"),
        ).alias("card"),
    )
    printing = F.struct(
        "line", "source_ref", F.col("_rarity").alias("rarity"), F.col("_finish").alias("finish"), F.col("_language").alias("language"), F.col("_edition").alias("edition"),
        F.nullif(F.col("image_url"), F.lit("")).alias("image_url"), F.col("_tracked").alias("is_tracked_for_price"),
    )
    # a good card has each printing once
    cards = numbered.select(*CARD_KEY, printing.alias("p")).join(good, CARD_KEY).groupBy(*CARD_KEY).agg(F.first("card").alias("card"), F.array_sort(F.collect_list("p")).alias("printings"))
    cards = cards.select(*CARD_KEY, "card.*", F.transform("printings", lambda p: p.dropFields("line", "source_ref")).alias("printings"))
    return cards, _rejections(judged, rows)


PRINTING_KEY = [*CARD_KEY, "rarity", "finish", "language", "edition"]


def card_rows(cards: DataFrame) -> DataFrame:
    """Cards without printings, with their fingerprint."""
    value = lambda c: F.array_sort(F.map_entries(c)) if c == "spirit_cost" else F.col(c)
    return cards.drop("printings").withColumn("fingerprint", S.fingerprint(VERSION, *map(F.col, CARD_KEY), *map(value, CARD_FIELDS)))


def printing_rows(cards: DataFrame) -> DataFrame:
    rows = cards.select(*CARD_KEY, F.explode("printings").alias("p")).select(*CARD_KEY, "p.*")
    return rows.withColumn("fingerprint", S.fingerprint(VERSION, *map(F.col, PRINTING_FIELDS)))


def diff(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """key columns and outcome of every incoming row: added, updated or unchanged by fingerprint."""
    old = existing.select(*key, F.col("fingerprint").alias("_old"))
    rows = incoming.select(*key, F.col("fingerprint").alias("_new")).join(old, key, "left")
    outcome = F.when(F.col("_old").isNull(), "added").when(F.col("_old") != F.col("_new"), "updated").otherwise("unchanged")
    return rows.select(*key, outcome.alias("outcome"))


def upserted(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """The next snapshot: incoming rows replace those with their key; what the source no longer has is kept."""
    return existing.join(incoming.select(*key), key, "left_anti").unionByName(incoming)


def card_outcomes(cards: DataFrame, old_cards: DataFrame, old_printings: DataFrame) -> DataFrame:
    """Outcome of each card and its number of new printings; a new printing on a known card makes it updated."""
    own = diff(card_rows(cards), old_cards, CARD_KEY)
    parts = diff(printing_rows(cards), old_printings, PRINTING_KEY).groupBy(*CARD_KEY)
    parts = parts.agg(F.count_if(F.col("outcome") == "added").alias("printings_added"), F.count_if(F.col("outcome") != "unchanged").alias("changed"))
    rows = own.join(parts, CARD_KEY, "left").fillna(0, ["printings_added", "changed"])
    outcome = F.when((F.col("outcome") == "unchanged") & (F.col("changed") > 0), "updated").otherwise(F.col("outcome"))
    return rows.select(*CARD_KEY, outcome.alias("outcome"), "printings_added")


def changed_sets(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Set rows that a write must touch; NULLs compare as values."""
    values = ["name", "card_count", "series", "released_on", "logo_asset_url"]
    old = existing.select("set_code", *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_known"))
    rows = incoming.join(old, "set_code", "left")
    same = reduce(lambda a, v: a & F.col(v).eqNullSafe(F.col(f"_{v}")), values, F.col("_known").isNotNull())
    return rows.filter(~same).select(*incoming.columns)


def run_report(outcomes: DataFrame, rejections: DataFrame, sets_status: DataFrame) -> DataFrame:
    """One row: counters and status. sets_status: set_code, failed. Rejections never change the status."""
    counted = lambda o: F.count_if(F.col("outcome") == o)
    cards = outcomes.agg(counted("added").alias("cards_added"), counted("updated").alias("cards_updated"), counted("unchanged").alias("cards_unchanged"), F.coalesce(F.sum("printings_added"), F.lit(0)).alias("printings_added"))
    rejected = rejections.agg(F.count("*").alias("rejected"))
    failed = F.count_if("failed")
    status = F.when(failed == 0, "success").when(failed < F.count("*"), "partial").otherwise("failed")
    sets = sets_status.agg(F.count("*").alias("sets_seen"), status.alias("status"))
    return cards.join(F.broadcast(rejected)).join(F.broadcast(sets))  # three one-row tables


def coverage(cards: DataFrame, sets: DataFrame) -> DataFrame:
    """Imported against declared numbers of each set, and the missing numbers where the numbering is unambiguous.

    Missing numbers are named if all numbers share one prefix and one digit width and none is above the declared size;
    otherwise the list is empty. Bounded by the declared size of a set.
    """
    prefix, digits = (F.regexp_extract("collector_number", r"^(.*?)([0-9]+)$", i) for i in (1, 2))
    numbers = cards.select("set_code", "collector_number", prefix.alias("prefix"), digits.alias("digits")).distinct()
    seen = numbers.groupBy("set_code").agg(
        F.count("*").alias("imported"), F.count_if(F.col("digits") == "").alias("bare"),
        F.min("prefix").alias("prefix"), F.max("prefix").alias("_p"), F.min(F.length("digits")).alias("width"), F.max(F.length("digits")).alias("_w"),
        F.max(F.col("digits").try_cast("int")).alias("top"), F.collect_set(F.col("digits").try_cast("int")).alias("numbers"),
    )
    rows = sets.select("set_code", F.col("card_count").alias("expected")).join(seen, "set_code", "left").fillna(0, ["imported"])
    clear = (F.col("imported") > 0) & (F.col("expected") > 0) & (F.col("bare") == 0) & (F.col("prefix") == F.col("_p")) & (F.col("width") == F.col("_w")) & (F.col("top") <= F.col("expected"))
    gaps = F.array_sort(F.array_except(F.sequence(F.lit(1), F.greatest("expected", F.lit(1))), "numbers"))
    text = lambda n: F.concat("prefix", F.lpad(n.cast("string"), F.greatest(F.col("width"), F.length(n.cast("string"))), F.lit("0")))
    missing = F.when(F.coalesce(clear, F.lit(False)), F.transform(gaps, text)).otherwise(F.expr("cast(array() as array<string>)"))
    return rows.select(
        "set_code", "expected", "imported", F.greatest(F.lit(0), F.col("expected") - F.col("imported")).alias("missing_count"),
        (F.col("imported") >= F.col("expected")).alias("complete"), missing.alias("missing_numbers"),
    )
