"""Closed vocabularies and their folding. Unknown values become NULL, which callers reject; nothing is guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members, aliases and ranks must equal the sources' vocabulary.
CARD_TYPES = ["elestral", "spirit", "rune"]
ELEMENTS = ["fire", "water", "wind", "earth", "thunder", "frost", "solar", "lunar"]
RUNE_TYPES = ["invoke", "counter", "artifact", "stadium", "divine"]
RARITIES = ["common", "uncommon", "rare", "holo_rare", "full_art", "alt_art", "prismatic", "secret", "promo"]  # commonest first
FINISHES = ["normal", "foil", "reverse_foil", "prismatic"]
EDITIONS = ["unlimited", "first"]
CONDITIONS = ["mint", "near_mint", "lightly_played", "moderately_played", "heavily_played", "damaged"]
RUN_STATUSES = ["running", "success", "partial", "failed"]
LEVELS = ["debug", "info", "warning", "error", "critical"]
REASONS = ["unknown_rarity", "unknown_finish", "unknown_edition", "conflicting_card_fields", "missing_required_field", "invalid_spirit_cost", "type_field_mismatch", "duplicate_printing_key", "unknown_set"]
FEATURES = ["inventory.item_added", "inventory.bulk_imported", "collection.valued", "catalog.searched", "price.alert_fired", "listing.created"]
CARD_TYPE_ALIASES = {"elestrals": "elestral", "spirits": "spirit", "runes": "rune"}
RARITY_ALIASES = {"holo": "holo_rare", "holofoil_rare": "holo_rare", "fullart": "full_art", "full_art_rare": "full_art", "alternate_art": "alt_art", "altart": "alt_art", "secret_rare": "secret", "promotional": "promo", "stellar": "prismatic"}
FINISH_ALIASES = {"holo": "foil", "holofoil": "foil", "foilcanvas": "foil", "reverse": "reverse_foil", "reverse_holo": "reverse_foil", "non_foil": "normal", "nonfoil": "normal", "standard": "normal"}
EDITION_ALIASES = {"1st": "first", "1st_edition": "first", "first_edition": "first", "unlimited_edition": "unlimited"}

RARITY_LABELS = {r: r.replace("_", " ").title() for r in RARITIES}
CONDITION_LABELS = {c: c.replace("_", " ").title() for c in CONDITIONS}


def mapped(key: Column, table: dict) -> Column:
    """table[key], or NULL."""
    if not table:
        return F.lit(None).cast("string")
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def label(c: Column, labels: dict[str, str]) -> Column:
    """The label of a member; other values pass through."""
    return F.coalesce(mapped(c, labels), c)


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any script; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def slug(c: Column) -> Column:
    """Lower case; hyphens, slashes and white space become single underscores."""
    words = F.split(F.regexp_replace(F.lower(F.translate(c, "-/", "  ")), r"(?U)\s+", " "), " ")
    return F.nullif(F.array_join(F.filter(words, lambda w: w != ""), "_"), F.lit(""))


def fold(c: Column, members: list[str], aliases: dict[str, str] | None = None) -> Column:
    s = slug(c)
    known = F.coalesce(mapped(s, aliases), s) if aliases else s
    return F.when(known.isin(members), known)


def rarity(c: Column) -> Column:
    return fold(c, RARITIES, RARITY_ALIASES)


def finish(c: Column) -> Column:
    return fold(c, FINISHES, FINISH_ALIASES)


def edition(c: Column) -> Column:
    return fold(c, EDITIONS, EDITION_ALIASES)


def card_type(c: Column) -> Column:
    return fold(c, CARD_TYPES, CARD_TYPE_ALIASES)


def element(c: Column) -> Column:
    return fold(c, ELEMENTS)


def rune_type(c: Column) -> Column:
    return fold(c, RUNE_TYPES)


def rank(c: Column, order: list[str] = RARITIES) -> Column:
    """Place in the order; unknown and NULL come last."""
    return F.coalesce(mapped(c, {v: i for i, v in enumerate(order)}), F.lit(len(order)))


def default_edition(set_code: Column) -> Column:
    return F.when(F.upper(set_code).startswith("FE"), "first").otherwise("unlimited")
