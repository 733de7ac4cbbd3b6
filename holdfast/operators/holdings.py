"""Holdings as pure functions of state and changes, and completion measured from them.

Ungraded copies of one (user, printing, condition) fold into one row; graded copies never merge. NULL merge keys are
kept apart by splitting before grouping, since a group by would put them together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..scratch import spread

KEY = ["user_id", "printing_id", "merge_condition"]
MAX_QUANTITY = 10_000
SETS_A_BLOCK = 1000
#: What else a row of holdings has; those that a state has are carried through merges and edits.
ATTRIBUTES = ["grader", "grade", "acquired_on", "acquired_unit_price_cents", "acquired_currency", "storage_location", "notes", "is_for_trade", "created_at", "updated_at"]


def keyed(items: DataFrame) -> DataFrame:
    return items.withColumn("merge_condition", S.merge_key(F.col("condition"), F.col("is_graded")))


def split_valid(items: DataFrame, conditions: list[str] = V.CONDITIONS) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): known condition and 1 to MAX_QUANTITY copies an add; the cap is not on merged totals."""
    ok = F.coalesce(F.col("condition").isin(conditions) & F.col("quantity").between(1, MAX_QUANTITY), F.lit(False))
    return items.filter(ok), items.filter(~ok)


def _carried(df: DataFrame) -> list[str]:
    return [c for c in ATTRIBUTES if c in df.columns]


def merged(items: DataFrame) -> DataFrame:
    """item_id, user_id, printing_id, condition, is_graded, merge_condition, quantity, first_seq, last_seq, and those of
    ATTRIBUTES that items has.

    The first row in ``seq`` order survives with its id and attributes; quantities add up, and updated_at is the latest.
    One shuffle, combined map-side.
    """
    rows, held = keyed(items), _carried(items)
    latest = [F.max("updated_at").alias("updated_at")] if "updated_at" in held else []
    folded = rows.filter("merge_condition IS NOT NULL").groupBy(*KEY).agg(
        F.min(F.struct("seq", "item_id", *held)).alias("first"), F.max("seq").alias("last_seq"), F.sum("quantity").cast("long").alias("quantity"), *latest
    )
    own = [F.col("updated_at") if c == "updated_at" else F.col(f"first.{c}").alias(c) for c in held]
    folded = folded.select(F.col("first.item_id").alias("item_id"), *KEY[:2], F.col("merge_condition").alias("condition"), F.lit(False).alias("is_graded"), "merge_condition", "quantity", F.col("first.seq").alias("first_seq"), "last_seq", *own)
    graded = rows.filter("merge_condition IS NULL").select("item_id", *KEY[:2], "condition", "is_graded", "merge_condition", F.col("quantity").cast("long").alias("quantity"), F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"), *held)
    return folded.unionByName(graded)


def merged_flag(items: DataFrame) -> DataFrame:
    """Whether each add folded into a row that was there before it."""
    w = Window.partitionBy(*KEY).orderBy("seq", "item_id")
    rows = keyed(items)
    first = F.row_number().over(w) == 1
    ungraded = rows.filter("merge_condition IS NOT NULL").withColumn("merged", ~first)
    return ungraded.unionByName(rows.filter("merge_condition IS NULL").withColumn("merged", F.lit(False)))


def edited(state: DataFrame, patches: DataFrame) -> DataFrame:
    """state: item_id, user_id, printing_id, condition, is_graded, quantity and ATTRIBUTES; patches: item_id and new values
    of any of these but the owner and the printing. NULL keeps, so a value can't be cleared. Of several patches of one
    item those count in order of ``seq``, if there is such a column: of each value the last that is given (of equal places
    the largest), so an item stays one row.

    An edited row whose new key another row holds is absorbed by that row, which keeps its own attributes; of several
    edited rows that meet with no row there before, the smallest id stays.
    """
    held = _carried(state)
    fields = [c for c in ("condition", "is_graded", "quantity", *held) if c in patches.columns]
    seq = (F.col("seq") if "seq" in patches.columns else F.lit(0)).alias("seq")
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(seq, c)))[c].alias(f"_{c}")
    new = patches.groupBy("item_id").agg(*map(last, fields))
    touched = F.lit(False)
    for c in fields:
        touched = touched | F.col(f"_{c}").isNotNull()
    rows = state.join(new, "item_id", "left").withColumn("_edited", touched).withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    rows = keyed(rows.drop(*(f"_{c}" for c in fields)))
    latest = [F.max("updated_at").alias("updated_at")] if "updated_at" in held else []
    folded = rows.filter("merge_condition IS NOT NULL").groupBy(*KEY).agg(
        F.min(F.struct("_edited", "item_id", *held)).alias("stays"), F.sum("quantity").cast("long").alias("quantity"), *latest
    )
    own = [F.col("updated_at") if c == "updated_at" else F.col(f"stays.{c}").alias(c) for c in held]
    folded = folded.select(F.col("stays.item_id").alias("item_id"), "user_id", "printing_id", F.col("merge_condition").alias("condition"), F.lit(False).alias("is_graded"), "quantity", *own)
    graded = rows.filter("merge_condition IS NULL").select("item_id", "user_id", "printing_id", "condition", "is_graded", F.col("quantity").cast("long").alias("quantity"), *held)
    return folded.unionByName(graded)


def removed(state: DataFrame, gone: DataFrame) -> DataFrame:
    """state without the rows named by (user_id, item_id) in gone."""
    return state.join(gone.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def twins(state: DataFrame) -> DataFrame:
    """Keys that more than one ungraded row holds: an integrity fault of a state."""
    return keyed(state).filter("merge_condition IS NOT NULL").groupBy(*KEY).agg(F.count("*").alias("rows")).filter("rows > 1")


def owned_by(state: DataFrame, user_id, printing_id=None) -> DataFrame:
    mine = state.filter(F.col("user_id") == user_id)
    return mine if printing_id is None else mine.filter(F.col("printing_id") == printing_id)


def totals(state: DataFrame) -> DataFrame:
    return state.groupBy("user_id").agg(F.count("*").alias("items"), F.coalesce(F.sum("quantity"), F.lit(0)).cast("long").alias("quantity"))


def delete_owner(tables: dict[str, DataFrame], user_id) -> dict[str, DataFrame]:
    return {name: df.filter(~F.col("user_id").eqNullSafe(F.lit(user_id))) for name, df in tables.items()}


# --- completion ---------------------------------------------------------------------------------


def measured(state: DataFrame, printings: DataFrame, cards: DataFrame) -> DataFrame:
    """Distinct cards and copies owned by (user_id, set_code).

    Holdings go to the catalog as they are: adding them up by printing first would shuffle them once more, and few users
    have several rows of one printing. What is placed is dealt by user and set, for both counts at once.
    """
    held = state.select("user_id", "printing_id", "quantity")
    placed = held.join(printings.select("printing_id", "card_id"), "printing_id").join(cards.select("card_id", "set_code"), "card_id")
    by_card = spread(placed, "user_id", "set_code").groupBy("user_id", "set_code", "card_id").agg(F.sum("quantity").alias("quantity"))
    return by_card.groupBy("user_id", "set_code").agg(F.count("*").alias("owned"), F.sum("quantity").cast("long").alias("quantity"))


def completion(state: DataFrame, printings: DataFrame, cards: DataFrame, sets: DataFrame) -> DataFrame:
    rows = measured(state, printings, cards).join(sets.select("set_code", F.col("card_count").alias("declared")), "set_code")
    return rows.withColumn("ratio", S.ratio(F.col("owned"), F.col("declared")))


def rebuilt(users: DataFrame, state: DataFrame, printings: DataFrame, cards: DataFrame, sets: DataFrame) -> DataFrame:
    """Every user against every set, zeros included.

    The product of users and the registered sets is the result asked for. Sets come in blocks of SETS_A_BLOCK, which
    users are joined with by number, so that no task and no broadcast holds the whole list if it is long.
    """
    blocks = max(1, -(-sets.count() // SETS_A_BLOCK))
    listed = sets.select(F.pmod(F.xxhash64("set_code"), F.lit(blocks)).alias("block"), F.struct("set_code", F.col("card_count").alias("declared")).alias("s"))
    listed = listed.groupBy("block").agg(F.collect_list("s").alias("listed"))
    asked = users.select("user_id").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    grid = asked.join(listed, "block").select("user_id", F.explode("listed").alias("s")).select("user_id", "s.*")
    rows = grid.join(measured(state, printings, cards), ["user_id", "set_code"], "left").fillna(0, ["owned", "quantity"])
    return rows.withColumn("ratio", S.ratio(F.col("owned"), F.col("declared")))


def touched_sets(changed: DataFrame, printings: DataFrame, cards: DataFrame) -> DataFrame:
    """(user_id, set_code) whose completion a batch of changes can alter."""
    ids = changed.select("user_id", "printing_id")
    return ids.join(printings.select("printing_id", "card_id"), "printing_id").join(cards.select("card_id", "set_code"), "card_id").select("user_id", "set_code").distinct()


def recomputed(old: DataFrame, state: DataFrame, changed: DataFrame, printings: DataFrame, cards: DataFrame, sets: DataFrame) -> DataFrame:
    """The completion table after a batch: touched rows anew (0 after a last removal), the others as they were."""
    touched = touched_sets(changed, printings, cards)
    held = measured(state, printings, cards).join(touched, ["user_id", "set_code"], "left_semi")
    fresh = touched.join(held, ["user_id", "set_code"], "left").fillna(0, ["owned", "quantity"]).join(sets.select("set_code", F.col("card_count").alias("declared")), "set_code")
    fresh = fresh.withColumn("ratio", S.ratio(F.col("owned"), F.col("declared")))
    return old.join(touched, ["user_id", "set_code"], "left_anti").unionByName(fresh.select(*old.columns))


def missing_cards(state: DataFrame, printings: DataFrame, cards: DataFrame, user_id, set_code: str) -> DataFrame:
    """Cards of a set of which the user owns no printing."""
    owned = owned_by(state, user_id).join(printings.select("printing_id", "card_id"), "printing_id").select("card_id")
    return cards.filter(F.col("set_code") == set_code).join(owned, "card_id", "left_anti")
