"""A collection's screens and changes: facets, views, bulk edits, undo, wishlist, snapshots and the notification outbox."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from . import holdings as H

#: Facets of a collection and the column that each one looks at.
FACETS = {"set": "set_code", "element": "element", "rarity": "rarity", "condition": "condition", "finish": "finish", "language": "language", "graded": "is_graded", "for_trade": "is_for_trade"}
SORTS = {"name": ["name", "item_id"], "set": ["set_code", "name", "item_id"], "quantity": ["-quantity", "item_id"], "recency": ["-updated_at", "item_id"]}
MAX_ATTEMPTS = 5


def detailed(items: DataFrame, printings: DataFrame, cards: DataFrame) -> DataFrame:
    """Items with the columns of their printing and card that facets and sorts need."""
    p = printings.select("printing_id", "card_id", *(c for c in ("rarity", "finish", "language", "edition") if c in printings.columns))
    return items.join(p, "printing_id").join(cards.select("card_id", "set_code", "name", "element"), "card_id")


def faceted(rows: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """Values OR within a facet, facets AND across; a facet without values doesn't filter."""
    for name, values in chosen.items():
        if name not in FACETS:
            raise LookupError(f"no facet {name!r}; there are {', '.join(FACETS)}")
        if values:
            rows = rows.filter(F.col(FACETS[name]).isin(list(values)))
    return rows


def from_view(rows: DataFrame, view: str) -> DataFrame:
    """A saved view, JSON of {"filters": {facet: values}, "sort": name}, applied to detailed rows."""
    saved = json.loads(view)
    return ordered(faceted(rows, saved.get("filters") or {}), saved.get("sort") or "name")


def ordered(rows: DataFrame, sort: str) -> DataFrame:
    """A total order; a leading minus is descending."""
    return rows.orderBy(*(F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in SORTS[sort]))


def counts_by_facet(rows: DataFrame, names: list[str]) -> DataFrame:
    """facet, value and number of items for several facets in one pass and one shuffle."""
    pairs = [F.struct(F.lit(n).alias("facet"), F.col(FACETS[n]).cast("string").alias("value")) for n in names]
    return rows.select(F.explode(F.array(*pairs)).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("items"))


def public(rows: DataFrame) -> DataFrame:
    """What others may see of a collection: named columns only, so a new private column stays private."""
    return rows.select("printing_id", "condition", "quantity")


def view(items: DataFrame) -> DataFrame:
    """The row of an item as its owner sees it; the grade is a floating-point number."""
    kept = [c for c in ("item_id", "printing_id", "condition", "quantity", "is_graded", "grader", *H.ATTRIBUTES) if c in items.columns and c != "grade"]
    return items.select(*dict.fromkeys(kept), F.col("grade").cast("double").alias("grade"))


def profile_view(claims: DataFrame, profiles: DataFrame, enriched: DataFrame) -> DataFrame:
    """Profile rows of the users in claims (user_id, email, name), which have no profile perhaps; what the enrichment
    (user_id, email, name) doesn't know falls back to the claims."""
    e = enriched.select("user_id", F.col("email").alias("_email"), F.col("name").alias("_name"))
    rows = claims.join(profiles.select("user_id", "handle", "currency"), "user_id", "left").join(e, "user_id", "left")
    return rows.select("user_id", "handle", F.coalesce("currency", F.lit("USD")).alias("currency"), F.coalesce("_email", "email").alias("email"), F.coalesce("_name", "name").alias("name"))


def is_operator(scope: Column, subject: Column, wanted: str, allowed: list[str]) -> Column:
    """Whether a space-separated scope list has the wanted one, or the subject is on the list of those allowed."""
    return F.coalesce(F.array_contains(F.split(scope, " +"), wanted), F.lit(False)) | F.coalesce(subject.isin(allowed), F.lit(False))


def tracked(printings: DataFrame, toggles: DataFrame) -> DataFrame:
    """printings with is_tracked_for_price as toggles (printing_id, is_tracked) say; of several the last by seq."""
    last = toggles.groupBy("printing_id").agg(F.max(F.struct("seq", "is_tracked")).alias("_t"))
    rows = printings.join(last, "printing_id", "left")
    return rows.withColumn("is_tracked_for_price", F.coalesce("_t.is_tracked", "is_tracked_for_price")).drop("_t")


def bulk_edited(state: DataFrame, chosen: Column, condition: str | None = None, quantity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(state after, refused rows): every row that the filter names is edited; those that would break a rule are named
    and the rest is applied."""
    patch = {"condition": F.lit(condition), "quantity": F.lit(quantity)}
    new = {c: F.coalesce(v.cast(state.schema[c].dataType), F.col(c)) for c, v in patch.items()}
    hit = state.filter(F.coalesce(chosen, F.lit(False))).withColumns({f"_{c}": v for c, v in new.items()})
    ok = F.coalesce(F.col("_condition").isin(V.CONDITIONS) & F.col("_quantity").between(1, H.MAX_QUANTITY), F.lit(False))
    patches = hit.filter(ok).select("item_id", F.col("_condition").alias("condition"), F.lit(None).cast("boolean").alias("is_graded"), F.col("_quantity").alias("quantity")).distinct()
    return H.edited(state, patches), hit.filter(~ok).select("item_id")


def undone(state: DataFrame, adds: DataFrame) -> DataFrame:
    """The state without some earlier adds: their quantities are taken off, and rows that reach zero go."""
    gone = H.keyed(adds).filter("merge_condition IS NOT NULL").groupBy(*H.KEY).agg(F.sum("quantity").alias("_less"))
    rows = H.keyed(state)
    folded = rows.filter("merge_condition IS NOT NULL").join(gone, H.KEY, "left")
    folded = folded.withColumn("quantity", (F.col("quantity") - F.coalesce("_less", F.lit(0))).cast("long")).filter("quantity > 0")
    graded = rows.filter("merge_condition IS NULL").join(adds.filter("is_graded").select("item_id"), "item_id", "left_anti")
    return folded.select(*state.columns).unionByName(graded.select(*state.columns))


def wishlist(wishes: DataFrame) -> DataFrame:
    """One wish for each user and printing: the first one's id, the last one's wanted price."""
    agg = wishes.groupBy("user_id", "printing_id").agg(F.min(F.struct("seq", "wish_id")).alias("a"), F.max(F.struct("seq", "max_price")).alias("b"))
    return agg.select("user_id", "printing_id", F.col("a.wish_id").alias("wish_id"), F.col("b.max_price").alias("max_price"))


def opened(sealed: DataFrame, changes: DataFrame) -> DataFrame:
    """Sealed products with is_open; a product once open stays open, whatever later changes say."""
    ever = changes.groupBy("product_id").agg(F.max(F.col("is_open").cast("int")).alias("_o"))
    rows = sealed.join(ever, "product_id", "left")
    return rows.withColumn("is_open", F.col("is_open") | (F.coalesce("_o", F.lit(0)) == 1)).drop("_o")


def outbox(messages: DataFrame, attempts: DataFrame) -> DataFrame:
    """message_id, tries and state: sent after a success, dead after MAX_ATTEMPTS failures, else pending."""
    tried = attempts.groupBy("message_id").agg(F.count("*").alias("tries"), F.max(F.col("ok").cast("int")).alias("_ok"))
    rows = messages.select("message_id").join(tried, "message_id", "left").fillna(0, ["tries", "_ok"])
    state = F.when(F.col("_ok") == 1, "sent").when(F.col("tries") >= MAX_ATTEMPTS, "dead").otherwise("pending")
    return rows.select("message_id", "tries", state.alias("state"))


def snapshot(items: DataFrame, prices: DataFrame, day: Column) -> DataFrame:
    """One row for each user: items, copies, value and cost in cents, and how many items have no price or no cost."""
    rows = items.join(prices.select("printing_id", "price_cents"), "printing_id", "left")
    priced, costed = F.col("price_cents").isNotNull(), F.col("acquired_unit_price_cents").isNotNull()
    both = priced & costed
    cents = lambda c, ok: F.coalesce(F.sum(F.when(ok, F.col("quantity") * c)), F.lit(0)).cast("long")
    return rows.groupBy("user_id").agg(
        F.count("*").alias("items"), F.sum("quantity").cast("long").alias("copies"), cents(F.col("price_cents"), priced).alias("value_cents"),
        cents(F.col("acquired_unit_price_cents"), costed).alias("cost_cents"), cents(F.col("price_cents") - F.col("acquired_unit_price_cents"), both).alias("gain_cents"),
        F.count_if(~priced).alias("unpriced"), F.count_if(~costed).alias("uncosted"),
    ).withColumn("day", day)


def alt_texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("alt_text", S.alt_text(F.col("name"), F.col("set_code"), F.col("rarity")))
