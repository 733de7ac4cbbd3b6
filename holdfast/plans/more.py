"""Further queries: holdings with all their columns, collection screens, import runs, profiles, prices and CSV matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..operators import collection as C
from ..operators import holdings as H
from ..operators import ingest as I
from ..operators import operations as O
from ..operators import pricing as P
from ..operators import search as R
from ..scratch import Scratch, spread
from ..sources import bucketed, collection_csv, sinks, snapshot
from ..streaming import streams as T
from .domain import LOGS_NOW, RANKED, Domain
from .queries import _FAULT, _MEASURED, _RATIO, _catalog, _raw, _search_sql, _time, query

# --- holdings with all columns ------------------------------------------------------------------


def _full(d: Domain) -> DataFrame:
    day, q = F.substring("seq", 1, 10), F.col("quantity")
    return d.adds.withColumns(
        {
            "grader": F.when(F.col("is_graded"), "PSA"), "grade": F.when(F.col("is_graded"), q % 10 + 0.5).cast("decimal(3,1)"), "acquired_on": F.to_date(day),
            "acquired_unit_price_cents": F.when(q % 4 != 0, q.cast("long") * 100), "storage_location": F.concat(F.lit("box-"), (q % 5).cast("string")),
            "notes": F.when(q % 3 == 0, F.col("item_id")), "is_for_trade": q % 2 == 0, "created_at": day, "updated_at": day,
        }
    )


_ATTRS = """CASE WHEN is_graded THEN 'PSA' END AS grader, CASE WHEN is_graded THEN q % 10 + 0.5 END::DOUBLE AS grade, created_at AS acquired_on, CASE WHEN q % 4 <> 0 THEN q * 100 END::BIGINT AS acquired_unit_price_cents,
    'box-' || q % 5 AS storage_location, CASE WHEN q % 3 = 0 THEN item_id END AS notes, q % 2 = 0 AS is_for_trade, created_at, updated_at"""
_FULL = f"""SELECT item_id, user_id, printing_id, condition, is_graded, quantity, {_ATTRS} FROM (
    SELECT min_by(item_id, seq) AS item_id, user_id, printing_id, condition, false AS is_graded, sum(quantity)::BIGINT AS quantity, min_by(quantity, seq) AS q, min(day) AS created_at, max(day) AS updated_at FROM adds WHERE NOT is_graded GROUP BY user_id, printing_id, condition
    UNION ALL SELECT item_id, user_id, printing_id, condition, true, quantity::BIGINT, quantity, day, day FROM adds WHERE is_graded)"""
_SHOWN = ["item_id", "user_id", "printing_id", "condition", "is_graded", "quantity", *H.ATTRIBUTES]


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({"grade": F.col("grade").cast("double"), "acquired_on": F.col("acquired_on").cast("string")})


@query(f"SELECT {', '.join(c for c in _SHOWN if c != 'acquired_currency')} FROM ({_FULL})")
def holdings_merge_full(d: Domain) -> DataFrame:
    """Merging keeps the first row's attributes and the latest update."""
    return _shown(H.merged(_full(d)).select(*(c for c in _SHOWN if c != "acquired_currency")))


@query(f"""SELECT item_id, quantity, CASE WHEN quantity % 2 = 0 THEN 'attic' ELSE storage_location END AS storage_location, CASE WHEN quantity % 2 = 0 THEN false ELSE is_for_trade END AS is_for_trade,
    CASE WHEN quantity % 2 = 0 AND is_graded THEN 9.5 ELSE grade END::DOUBLE AS grade, notes FROM (SELECT DISTINCT * FROM ({_FULL}))""")
def holdings_edit_attributes(d: Domain) -> DataFrame:
    """Values of a patch replace, NULLs keep what is there."""
    state = bucketed.bucketed(H.merged(_full(d)).drop("merge_condition", "first_seq", "last_seq"), "state", ["item_id"]).distinct()
    even = state.filter("quantity % 2 = 0")
    grade = F.when(F.col("is_graded"), 9.5).cast("decimal(3,1)")
    patches = even.select("item_id", F.lit("attic").alias("storage_location"), F.lit(False).alias("is_for_trade"), grade.alias("grade"), F.lit(None).cast("string").alias("notes")).distinct()
    return _shown(H.edited(state, patches)).select("item_id", "quantity", "storage_location", "is_for_trade", "grade", "notes")


@query("SELECT item_id, quantity, grade, grader FROM (SELECT item_id, quantity, CASE WHEN is_graded THEN quantity % 10 + 0.5 END::DOUBLE AS grade, CASE WHEN is_graded THEN 'PSA' END AS grader, seq FROM adds WHERE user_id = 7 ORDER BY seq DESC, item_id LIMIT 20)")
def holdings_view(d: Domain) -> DataFrame:
    return C.view(H.owned_by(_full(d), 7).orderBy(F.desc("seq"), "item_id").limit(20)).select("item_id", "quantity", "grade", "grader")


@query("SELECT item_id, quantity FROM adds WHERE user_id = 7 AND printing_id = (SELECT min(printing_id) FROM adds WHERE user_id = 7)")
def holdings_of_printing(d: Domain) -> DataFrame:
    mine = H.owned_by(d.adds, 7)
    first = mine.agg(F.min("printing_id")).first()[0]
    return H.owned_by(d.adds, 7, first).select("item_id", "quantity")


@query("SELECT 'adds' AS name, count(*) AS rows FROM adds WHERE user_id <> 7 UNION ALL SELECT 'profiles', count(*) FROM customer WHERE c_custkey <> 7")
def owner_deletion(d: Domain) -> DataFrame:
    left = H.delete_owner({"adds": d.adds, "profiles": d.table("customer").withColumnRenamed("c_custkey", "user_id")}, 7)
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in left.items()]
    return counts[0].unionByName(counts[1])


@query(f"SELECT user_id, set_code, owned, quantity, card_count AS declared, {_RATIO.replace('declared', 'card_count')} FROM ({_MEASURED}) JOIN sets USING (set_code)")
def completion_recomputed(d: Domain) -> DataFrame:
    """The completion before the last adds, brought up to date for the sets that they touch."""
    was, last = d.adds.filter("quantity < 40"), d.adds.filter("quantity >= 40")
    old = H.completion(was, d.printings, d.cards, d.sets)
    return H.recomputed(old, d.adds, last, d.printings, d.cards, d.sets).withColumn("ratio", F.round("ratio", 6))


@query(f"SELECT set_code, owned, card_count AS declared FROM ({_MEASURED}) JOIN sets USING (set_code) WHERE user_id = 7")
def completion_list(d: Domain) -> DataFrame:
    mine = H.completion(H.owned_by(d.adds, 7), d.printings, d.cards, d.sets)
    return mine.orderBy("set_code").select("set_code", "owned", "declared")


# --- the collection's screens and changes -------------------------------------------------------

_DETAILED = "SELECT item_id, user_id, printing_id, condition, quantity, is_graded, set_code, name, element, rarity, finish, edition, day AS updated_at, quantity % 2 = 0 AS is_for_trade FROM adds JOIN printings USING (printing_id) JOIN cards USING (card_id)"


def _details(d: Domain) -> DataFrame:
    return C.detailed(_full(d), d.printings, d.cards)


@query(f"SELECT item_id, set_code, quantity FROM ({_DETAILED}) WHERE set_code IN ('Brand#1', 'Brand#2') AND rarity IN ('A', 'R') AND finish = 'foil' AND NOT is_graded AND is_for_trade")
def collection_facets(d: Domain) -> DataFrame:
    chosen = {"set": ["Brand#1", "Brand#2"], "rarity": ["A", "R"], "finish": ["foil"], "graded": [False], "for_trade": [True], "element": []}
    return C.faceted(_details(d), chosen).select("item_id", "set_code", "quantity")


@query(f"SELECT item_id, updated_at FROM ({_DETAILED}) WHERE user_id = 7 AND condition = 'N' ORDER BY updated_at DESC, item_id LIMIT 10")
def collection_saved_view(d: Domain) -> DataFrame:
    mine = _details(d).filter("user_id = 7")
    return C.from_view(mine, '{"filters": {"condition": ["N"]}, "sort": "recency", "density": "compact"}').limit(10).select("item_id", "updated_at")


@query(f"SELECT facet, value, count(*) AS items FROM (SELECT unnest(['rarity', 'finish', 'set']) AS facet, unnest([rarity, finish, set_code]) AS value FROM ({_DETAILED})) GROUP BY ALL")
def collection_facet_counts(d: Domain) -> DataFrame:
    return C.counts_by_facet(_details(d), ["rarity", "finish", "set"])


@query("SELECT printing_id, condition, quantity FROM adds WHERE user_id = 7")
def collection_public(d: Domain) -> DataFrame:
    return C.public(H.owned_by(_full(d), 7))


@query("SELECT item_id, condition, quantity FROM (SELECT item_id, CASE WHEN quantity = 50 AND is_graded THEN 'mint' ELSE condition END AS condition, quantity, is_graded FROM adds) WHERE is_graded")
def collection_bulk_edit(d: Domain) -> DataFrame:
    state = d.adds.select("item_id", "user_id", "printing_id", "condition", "is_graded", "quantity")
    out, _ = C.bulk_edited(state, F.col("is_graded") & (F.col("quantity") == 50), condition="mint")
    return out.filter("is_graded").select("item_id", "condition", "quantity")


@query("SELECT item_id FROM adds WHERE quantity = 50")
def collection_bulk_refused(d: Domain) -> DataFrame:
    """An unknown condition refuses every chosen row, by name."""
    state = d.adds.select("item_id", "user_id", "printing_id", "condition", "is_graded", "quantity")
    return C.bulk_edited(state, F.col("quantity") == 50, condition="chewed")[1]


@query("""SELECT user_id, printing_id, condition, sum(quantity)::BIGINT - coalesce(sum(quantity) FILTER (quantity >= 45), 0)::BIGINT AS quantity FROM adds WHERE NOT is_graded
    GROUP BY ALL HAVING sum(quantity) > coalesce(sum(quantity) FILTER (quantity >= 45), 0)""")
def collection_undo(d: Domain) -> DataFrame:
    state = H.merged(d.adds).select("item_id", "user_id", "printing_id", "condition", "is_graded", "quantity")
    return C.undone(state, d.adds.filter("quantity >= 45")).filter("NOT is_graded").select("user_id", "printing_id", "condition", "quantity")


@query("SELECT user_id, printing_id, min_by(item_id, seq) AS wish_id, max_by(quantity, seq || item_id)::BIGINT AS max_price FROM adds GROUP BY user_id, printing_id")
def collection_wishlist(d: Domain) -> DataFrame:
    return C.wishlist(d.adds.select("user_id", "printing_id", "seq", F.col("item_id").alias("wish_id"), F.col("quantity").cast("long").alias("max_price")))


@query("SELECT p_partkey AS product_id, p_partkey % 7 = 0 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS is_open FROM part")
def sealed_open(d: Domain) -> DataFrame:
    products = d.table("part").select(F.col("p_partkey").alias("product_id"), (F.col("p_partkey") % 7 == 0).alias("is_open"))
    changes = d.table("lineitem").select(F.col("l_partkey").alias("product_id"), (F.col("l_quantity") > 49).alias("is_open"))
    return C.opened(products, changes)


@query("""SELECT o_orderkey AS message_id, coalesce(tries, 0) AS tries, CASE WHEN ok THEN 'sent' WHEN tries >= 5 THEN 'dead' ELSE 'pending' END AS state FROM orders
    LEFT JOIN (SELECT l_orderkey, count(*) AS tries, bool_or(l_quantity > 45) AS ok FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def notification_outbox(d: Domain) -> DataFrame:
    messages = d.table("orders").select(F.col("o_orderkey").alias("message_id"))
    return C.outbox(messages, d.table("lineitem").select(F.col("l_orderkey").alias("message_id"), (F.col("l_quantity") > 45).alias("ok")))


@query("""SELECT user_id, count(*) AS items, sum(quantity)::BIGINT AS copies, coalesce(sum(quantity * price), 0)::BIGINT AS value_cents, coalesce(sum(quantity * cost), 0)::BIGINT AS cost_cents,
    coalesce(sum(quantity * (price - cost)), 0)::BIGINT AS gain_cents, count(*) - count(price) AS unpriced, count(*) - count(cost) AS uncosted, '2024-01-31' AS day
    FROM (SELECT user_id, quantity, CASE WHEN quantity % 4 <> 0 THEN quantity * 100 END AS cost, price FROM adds a LEFT JOIN (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS price FROM part WHERE p_partkey % 5 <> 0) ON p_partkey = split_part(a.printing_id, '-', 1)::BIGINT) GROUP BY user_id""")
def portfolio_snapshot(d: Domain) -> DataFrame:
    prices = d.table("part").filter("p_partkey % 5 != 0").select(F.col("p_partkey").alias("printing_id"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price_cents"))
    items = _full(d).withColumn("printing_id", F.substring_index("printing_id", "-", 1).cast("long"))
    return C.snapshot(items, prices, F.lit("2024-01-31"))


@query("SELECT user_id, sum(quantity * (price - cost))::BIGINT AS gain FROM (SELECT user_id, quantity, quantity * 100 AS cost, (split_part(printing_id, '-', 1)::BIGINT % 900 + 100) * 10 AS price FROM adds WHERE quantity % 4 <> 0) GROUP BY user_id")
def profit(d: Domain) -> DataFrame:
    held = _full(d).select("user_id", "printing_id", F.col("quantity").cast("long").alias("quantity"), F.col("acquired_unit_price_cents").alias("unit_cost"))
    card = F.substring_index("printing_id", "-", 1).cast("long")
    prices = held.select("printing_id").distinct().select("printing_id", ((card % 900 + 100) * 10).alias("price"))
    return P.profit(held, prices).withColumn("gain", F.col("gain").cast("long"))


# --- profiles and operators ---------------------------------------------------------------------


def _profiles(d: Domain) -> DataFrame:
    c = d.table("customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("handle"), F.lit("USD").alias("currency"))


def _patches(d: Domain) -> DataFrame:
    c = d.table("customer").filter("c_custkey % 10 = 0")
    asked = F.when(F.col("c_custkey") % 30 == 0, F.lit("No Spaces!")).when(F.col("c_custkey") % 40 == 0, F.lit("user_1")).otherwise(F.concat(F.lit(" New_"), (F.col("c_custkey") % 500).cast("string")))
    return c.select(F.col("c_custkey").alias("user_id"), asked.alias("handle"), F.when(F.col("c_custkey") % 20 == 0, "eur").alias("currency"))


_WON = "SELECT *, user_id % 10 = 0 AND user_id % 30 <> 0 AND user_id % 40 <> 0 AND user_id = min(user_id) FILTER (user_id % 10 = 0 AND user_id % 30 <> 0 AND user_id % 40 <> 0) OVER (PARTITION BY user_id % 500) AS won FROM (SELECT c_custkey AS user_id FROM customer)"


@query(f"SELECT user_id, CASE WHEN won THEN 'new_' || user_id % 500 ELSE 'user_' || user_id END AS handle, CASE WHEN won AND user_id % 20 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM ({_WON})")
def profiles_patched(d: Domain) -> DataFrame:
    return O.patched_profiles(_profiles(d), _patches(d))[0]


@query(f"SELECT user_id FROM ({_WON}) WHERE user_id % 10 = 0 AND NOT won")
def profiles_refused(d: Domain) -> DataFrame:
    return O.patched_profiles(_profiles(d), _patches(d))[1]


@query("""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 <> 0 THEN 'user_' || c_custkey END AS handle, 'USD' AS currency, CASE WHEN c_custkey % 2 = 0 THEN 'rich@' ELSE 'claim@' END || c_custkey AS email,
    CASE WHEN c_custkey % 4 = 0 THEN 'Rich' ELSE c_name END AS name FROM customer""")
def profile_view(d: Domain) -> DataFrame:
    c = d.table("customer").withColumnRenamed("c_custkey", "user_id")
    claims = c.select("user_id", F.concat(F.lit("claim@"), F.col("user_id").cast("string")).alias("email"), F.col("c_name").alias("name"))
    rich = c.filter("user_id % 2 = 0").select("user_id", F.concat(F.lit("rich@"), F.col("user_id").cast("string")).alias("email"), F.when(F.col("user_id") % 4 == 0, "Rich").alias("name"))
    return C.profile_view(claims, _profiles(d).filter("user_id % 3 != 0"), rich)


@query("SELECT c_custkey AS user_id, c_nationkey % 3 = 0 OR c_custkey IN (7, 8) AS operator FROM customer")
def operator_gate(d: Domain) -> DataFrame:
    scope = F.when(F.col("c_nationkey") % 3 == 0, "read admin write").when(F.col("c_nationkey") % 3 == 1, "administrator read")
    return d.table("customer").select(F.col("c_custkey").alias("user_id"), C.is_operator(scope, F.col("c_custkey").cast("string"), "admin", ["7", "8"]).alias("operator"))


# --- the catalog --------------------------------------------------------------------------------


@query("SELECT p_partkey AS printing_id, CASE WHEN l IS NULL THEN true ELSE l END AS is_tracked_for_price FROM part LEFT JOIN (SELECT l_partkey, max_by(l_quantity > 25, strftime(l_shipdate, '%Y%m%d') || lpad(l_orderkey::VARCHAR, 9, '0') || l_linenumber || l_quantity) AS l FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def price_tracking(d: Domain) -> DataFrame:
    printings = d.table("part").select(F.col("p_partkey").alias("printing_id"), F.lit(True).alias("is_tracked_for_price"))
    seq = F.concat(F.date_format("l_shipdate", "yyyyMMdd"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string"))
    toggles = d.table("lineitem").select(F.col("l_partkey").alias("printing_id"), seq.alias("seq"), (F.col("l_quantity") > 25).alias("is_tracked"))
    return C.tracked(printings, toggles)


_NESTED_RANK = "CASE rarity WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END"


@query(f"""SELECT card_id, collector_number, place, printing_id, name || ' — ' || set_code || ' ' || rarity AS alt_text FROM (SELECT * FROM cards WHERE set_code = 'Brand#7' ORDER BY collector_number, card_id LIMIT 10 OFFSET 10)
    JOIN (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY {_NESTED_RANK}, finish, edition, printing_id) AS place FROM printings) USING (card_id)""")
def set_checklist_nested(d: Domain) -> DataFrame:
    page = R.checklist(d.cards, "Brand#7", 10, 10)
    held = d.printings.join(page.select("card_id"), "card_id", "left_semi")
    rows = R.card_detail(page, d.sets, held, RANKED).select("card_id", "collector_number", F.posexplode("printings").alias("i", "p"))
    return rows.select("card_id", "collector_number", (F.col("i") + 1).alias("place"), "p.printing_id", "p.alt_text")


def _with_printings(d: Domain) -> DataFrame:
    p = F.struct(F.lit("rare").alias("rarity"), F.lit("foil").alias("finish"), F.lit("en").alias("language"), F.lit("first").alias("edition"), F.lit(None).cast("string").alias("image_url"), F.lit(True).alias("is_tracked_for_price"))
    return _catalog(d.cards).withColumn("printings", F.array(p))


def _old_catalog(d: Domain) -> tuple[DataFrame, DataFrame]:
    old = d.cards.filter("card_id % 11 != 0").withColumn("attack", F.when(F.col("card_id") % 7 == 0, F.col("attack") + 1).otherwise(F.col("attack")))
    number = F.substring("collector_number", 2, 8).cast("long")
    return I.card_rows(_catalog(old)), I.printing_rows(_with_printings(d)).filter((number % 11 != 0) & (number % 5 != 0))


_OUTCOME = "CASE WHEN card_id % 11 = 0 THEN 'added' WHEN card_id % 7 = 0 OR card_id % 5 = 0 THEN 'updated' ELSE 'unchanged' END"
_ADDED = "(card_id % 11 = 0 OR card_id % 5 = 0)::BIGINT"


@query(f"SELECT set_code, collector_number, {_OUTCOME} AS outcome, {_ADDED} AS printings_added FROM cards")
def catalog_card_outcomes(d: Domain) -> DataFrame:
    """A known card with a new printing counts as updated."""
    return I.card_outcomes(_with_printings(d), *_old_catalog(d))


@query("SELECT set_code, collector_number, CASE WHEN card_id % 11 = 0 OR card_id % 5 = 0 THEN 'added' ELSE 'unchanged' END AS outcome FROM cards")
def catalog_printing_diff(d: Domain) -> DataFrame:
    return I.diff(I.printing_rows(_with_printings(d)), _old_catalog(d)[1], I.PRINTING_KEY).select("set_code", "collector_number", "outcome")


@query(f"""SELECT count(*) FILTER (o = 'added') AS cards_added, count(*) FILTER (o = 'updated') AS cards_updated, count(*) FILTER (o = 'unchanged') AS cards_unchanged, sum(a)::BIGINT AS printings_added,
    (SELECT count(*) FROM events) AS rejected, (SELECT count(*) FROM sets) AS sets_seen, 'partial' AS status FROM (SELECT {_OUTCOME} AS o, {_ADDED} AS a FROM cards)""")
def import_run_report(d: Domain) -> DataFrame:
    """Some sets failed, so the run is partial; rejections don't matter to that."""
    status = d.sets.select("set_code", F.col("set_code").endswith("3").alias("failed"))
    return I.run_report(I.card_outcomes(_with_printings(d), *_old_catalog(d)), d.rejections, status)


@query("SELECT p_type, CASE p_type WHEN 'PROMO' THEN 'Promo' ELSE p_type END AS label FROM part GROUP BY p_type")
def vocabulary_labels(d: Domain) -> DataFrame:
    kinds = d.table("part").select("p_type").distinct()
    return kinds.select("p_type", V.label(F.when(F.col("p_type") == "PROMO", "promo").otherwise(F.col("p_type")), V.RARITY_LABELS).alias("label"))


@query("SELECT event_type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, count(*) AS rows FROM events GROUP BY ALL")
def log_level_default(d: Domain) -> DataFrame:
    return d.table("events").groupBy("event_type", S.known_level(F.col("event_type")).alias("level")).agg(F.count("*").alias("rows"))


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"note\":null}' AS json FROM nation")
def read_model_json(d: Domain) -> DataFrame:
    return sinks.as_json(d.table("nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("note")))


# --- prices -------------------------------------------------------------------------------------


@query("""SELECT printing_id, min(price) AS low, round(median(price) FILTER (usual), 6) AS median, max(price) AS high, round(avg(price), 6) AS mean, count(*) AS n, count(DISTINCT source_id) AS sources, count(*) FILTER (NOT usual) AS outliers,
    CASE WHEN count(*) FILTER (kind = 'sold') >= 5 AND count(DISTINCT source_id) FILTER (kind = 'sold') >= 2 THEN 'high' WHEN count(*) FILTER (kind = 'sold') >= 2 THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT o.*, price BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1) AS usual FROM (SELECT printing_id, source_id, kind, CASE WHEN source_id % 40 = 0 THEN price * 1000 ELSE price END AS price FROM observations) o
    JOIN (SELECT printing_id, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM (SELECT printing_id, CASE WHEN source_id % 40 = 0 THEN price * 1000 ELSE price END AS p FROM observations) GROUP BY printing_id) USING (printing_id)) GROUP BY printing_id""")
def price_rollup(d: Domain) -> DataFrame:
    """Every fortieth source's prices are a thousand times too high: outliers that only the median leaves out."""
    seen = d.observations.withColumn("price", F.when(F.col("source_id") % 40 == 0, F.col("price") * 1000).otherwise(F.col("price")))
    return P.rollup(seen, ["printing_id"]).withColumns({c: F.round(c, 6) for c in ("median", "mean")})


@query("SELECT printing_id, source_id, min(price) FILTER (day = first_day) AS price, first_day::VARCHAR AS first_at FROM (SELECT *, min(observations.day) OVER (PARTITION BY printing_id, source_id) AS first_day FROM observations) GROUP BY printing_id, source_id, first_day")
def observation_first(d: Domain) -> DataFrame:
    """Of observations with one source and external id the earliest stays, of several on that day the cheapest."""
    rows = d.observations.select("source_id", F.col("printing_id").alias("external_id"), F.col("day").alias("at"), "price")
    return P.deduplicated(rows).select(F.col("external_id").alias("printing_id"), "source_id", "price", F.col("at").cast("string").alias("first_at"))


@query("""SELECT user_id, printing_id, listed, coalesce(held, 0) AS held FROM (SELECT user_id, printing_id, sum(quantity)::BIGINT AS listed FROM adds WHERE quantity % 3 <> 0 GROUP BY ALL)
    LEFT JOIN (SELECT user_id, printing_id, sum(quantity)::BIGINT AS held FROM adds WHERE quantity % 2 = 0 GROUP BY ALL) USING (user_id, printing_id) WHERE listed > coalesce(held, 0)""")
def listings_over_held(d: Domain) -> DataFrame:
    return P.overlisted(d.adds.filter("quantity % 3 != 0"), d.adds.filter("quantity % 2 = 0")).select("user_id", "printing_id", "listed", F.col("held").cast("long").alias("held"))


@query("""SELECT o_custkey AS seller_id, round(avg(stars), 6) AS stars, count(*) AS rated FROM orders JOIN (SELECT l_orderkey, min_by(l_linenumber % 5 + 1, strftime(l_shipdate, '%Y%m%d') || (l_linenumber % 5)) AS stars FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'F' GROUP BY 1""")
def seller_reputation(d: Domain) -> DataFrame:
    orders = d.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("seller_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"))
    ratings = d.table("lineitem").select(F.col("l_orderkey").alias("order_id"), F.date_format("l_shipdate", "yyyyMMdd").alias("at"), (F.col("l_linenumber") % 5 + 1).alias("stars"))
    return P.reputation(ratings, orders).withColumn("stars", F.round("stars", 6))


@query("""SELECT listing_id, price, round(market, 6) AS market, round(1 - price / market, 6) AS below FROM (SELECT p_partkey AS listing_id, p_retailprice AS price, (SELECT median(m) FROM (SELECT median(price) AS m FROM observations o
    WHERE o.printing_id = p_partkey AND o.day < DATE '1998-06-01' AND o.day >= DATE '1998-06-01' - 300 GROUP BY o.day)) AS market FROM part WHERE p_partkey % 50 = 0)""")
def listings_against_market(d: Domain) -> DataFrame:
    listed = d.table("part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("listing_id"), F.col("p_partkey").alias("printing_id"), F.col("p_retailprice").alias("price"), F.lit("1998-06-01").cast("date").alias("day"))
    return P.against_market(listed, P.daily(d.observations), 300).select("listing_id", "price", F.round("market", 6).alias("market"), F.round("below", 6).alias("below"))


@query("SELECT user_id, item_id FROM adds QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC, item_id DESC) <= 10")
def dashboard_last_changes(d: Domain) -> DataFrame:
    return P.ranked_windows(d.adds, "user_id", F.struct("seq", "item_id").desc(), 10).select("user_id", "item_id")


@query("""WITH RECURSIVE crossing AS (SELECT DISTINCT user_id AS alert_id, ts AS t FROM events WHERE value >= 20),
    fire AS (SELECT alert_id, min(t) AS t FROM crossing GROUP BY alert_id
             UNION ALL SELECT f.alert_id, (SELECT min(c.t) FROM crossing c WHERE c.alert_id = f.alert_id AND c.t >= f.t + INTERVAL 24 HOUR) FROM fire f WHERE f.t IS NOT NULL)
    SELECT alert_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS fired_at FROM fire WHERE t IS NOT NULL""")
def price_alerts(d: Domain) -> DataFrame:
    crossings = d.table("events").select(F.col("user_id").alias("alert_id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("value") < 20, "low").otherwise("high").alias("confidence"))
    return P.alerts(crossings, 24).select("alert_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("fired_at"))


# --- forms with rows of queries that find none --------------------------------------------------

_WIDE = [f"Brand#{i}" for i in range(1, 13)]
_WIDE_SQL = f"cards.set_code IN ({', '.join(repr(c) for c in _WIDE)}) AND card_type IN ('PROMO', 'SMALL', 'LARGE') AND element IN ('red', 'blue')"


@query(f"SELECT card_id, set_code, collector_number, name, tier FROM ({_search_sql('b0000', where=_WIDE_SQL)})")
def search_filtered_numbers(d: Domain) -> DataFrame:
    q = R.Search("B0000", set_codes=_WIDE, card_types=["PROMO", "SMALL", "LARGE"], elements=["red", "blue"])
    return R.matches(d.cards, d.sets, q).select("card_id", "set_code", "collector_number", "name", "tier")


@query("SELECT user_id, left(printing_id, 1) AS printing_id, condition AS merge_condition, count(*) AS rows FROM adds WHERE NOT is_graded GROUP BY ALL HAVING count(*) > 1")
def holdings_twins_coarse(d: Domain) -> DataFrame:
    return H.twins(d.adds.withColumn("printing_id", F.substring("printing_id", 1, 1)))


@query("""SELECT set_code, count(*) AS rows, sum(p_size)::BIGINT AS copies, count(*) FILTER (p_partkey % 3 = 0) AS quoted, max(CASE WHEN p_partkey % 3 = 0 THEN 'é "' || p_name || '"; new' ELSE p_name END) AS last_name
    FROM (SELECT *, p_brand AS set_code FROM part) GROUP BY set_code""")
def csv_read_back(d: Domain) -> DataFrame:
    """A CSV export, in several files, read as a collector's own file with nothing said about it."""
    path = f"{Scratch(d.spark, 'export').base}/csv"
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('é "'), "p_name", F.lit('"; new'))).otherwise(F.col("p_name"))
    sinks.export_csv(d.table("part").select(F.col("p_brand").alias("Set_Code"), F.col("p_partkey").alias("collector_number"), name.alias("NAME"), F.col("p_size").alias("quantity")), path)
    rows = collection_csv.read(d.spark, path)
    return rows.groupBy("set_code").agg(F.count("*").alias("rows"), F.sum(F.col("quantity").cast("long")).alias("copies"), F.count_if(F.col("name").contains("; new")).alias("quoted"), F.max("name").alias("last_name"))


# --- scalar rules on awkward values -------------------------------------------------------------

_INTS = ["+5", "5.7", "1_000", " 7 ", "99999999999", "-12", "x", ""]
_DATES = ["2024-1-1", "2024-01-31", "20240101", "2024-02-30", "2024", "2024-12-05", "", "31.12.2024"]
_FLAGS = [" No ", "0", "FALSE", "yes", "", "none", "false", "1"]
_CODES = ["FE01", "fe2", "Fe", "BS1", "xFE", "", "F", "feb"]


def _picked(values: list, cast: str | None = None) -> str:
    literal = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    case = "CASE " + " ".join(f"WHEN k = {i} THEN {literal(v)}" for i, v in enumerate(values)) + " END"
    return f"({case})::{cast}" if cast else case


@query(f"""SELECT n, {_picked([5, None, None, 7, None, -12, None, None], "INT")} AS whole, {_picked([None, "2024-01-31", None, None, None, "2024-12-05", None, None])} AS day, {_picked([False, False, False, True, True, True, False, True])} AS tracked,
    {_picked(["first", "first", "first", "unlimited", "unlimited", "unlimited", "unlimited", "first"])} AS edition, p_name AS stripped, CASE WHEN n % 3 = 0 THEN NULL ELSE p_name END AS filled, CASE WHEN n % 2 = 0 THEN 'Bearer [redacted] ' || p_name ELSE 'x [redacted] ' || p_name END AS scrubbed, 2048 + length('…[truncated]') AS cut
    FROM (SELECT p_partkey AS n, p_partkey % 8 AS k, p_name FROM part)""")
def scalar_traps(d: Domain) -> DataFrame:
    part = spread(d.table("part").select("p_partkey", "p_name"), "p_partkey").withColumn("k", (F.col("p_partkey") % 8).cast("int") + 1)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k"))
    token = F.when(F.col("p_partkey") % 2 == 0, "bearer aB.c-_9").otherwise("x eyJ" + "h" * 20)
    return part.select(
        F.col("p_partkey").alias("n"), S.as_int(of(_INTS)).alias("whole"), S.as_date(of(_DATES)).cast("string").alias("day"), S.is_tracked(of(_FLAGS)).alias("tracked"), V.default_edition(of(_CODES)).alias("edition"),
        V.strip(F.concat(F.lit("\u00a0\t\u2003"), "p_name", F.lit("\n \u3000"))).alias("stripped"), V.blank_to_null(F.when(F.col("p_partkey") % 3 == 0, "\u00a0 \t").otherwise(F.col("p_name"))).alias("filled"),
        S.scrub_text(F.concat_ws(" ", token, "p_name")).alias("scrubbed"), F.length(S.scrub_text(F.repeat(F.col("p_name"), 700))).alias("cut"),
    )


@query("""SELECT run_id, status, coalesce(rejected, 0)::BIGINT AS rejected, reasons FROM runs LEFT JOIN
    (SELECT import_id, sum(n) AS rejected, string_agg(reason_code || '=' || n || '@' || ref, ',' ORDER BY n DESC, reason_code) AS reasons FROM (SELECT import_id, reason_code, count(*) AS n, min(source_ref) AS ref FROM rejections GROUP BY ALL) GROUP BY import_id) ON import_id = run_id""")
def run_details(d: Domain) -> DataFrame:
    text = F.transform("reasons", lambda r: F.concat(r["reason_code"], F.lit("="), r["count"].cast("string"), F.lit("@"), r["example_source_ref"]))
    return O.run_detail(d.runs, d.rejections).select("run_id", "status", "rejected", F.array_join(text, ",").alias("reasons"))


# --- bucketed tables ----------------------------------------------------------------------------


@query("SELECT count(*) AS rows, sum(attack)::BIGINT AS attack, count(DISTINCT collector_number) AS numbers FROM (SELECT CASE WHEN card_id % 3 = 0 THEN attack + 1 ELSE attack END AS attack, collector_number FROM cards WHERE card_id % 7 <> 0 OR card_id % 3 = 0)")
def catalog_upsert_bucketed(d: Domain) -> DataFrame:
    """Two upserts of a table in buckets by card."""
    old = bucketed.bucketed(I.card_rows(_catalog(d.cards.filter("card_id % 7 != 0"))), "cards", I.CARD_KEY)
    changed = d.cards.filter("card_id % 3 = 0").withColumn("attack", F.col("attack") + 1)
    for part in (0, 1):
        old = bucketed.upserted(I.card_rows(_catalog(changed.filter(F.col("card_id") % 2 == part))), old, "cards")
    return old.agg(F.count("*").alias("rows"), F.sum("attack").cast("long").alias("attack"), F.count_distinct("collector_number").alias("numbers"))


@query(f"SELECT user_id, set_code, owned, quantity, card_count AS declared, {_RATIO.replace('declared', 'card_count')} FROM ({_MEASURED}) JOIN sets USING (set_code)")
def set_completion_bucketed(d: Domain) -> DataFrame:
    """Completion over tables in buckets: holdings and printings by printing, cards by card."""
    held = bucketed.bucketed(d.adds.select("user_id", "printing_id", "quantity"), "held", ["printing_id"])
    printings, cards = bucketed.bucketed(d.printings.select("printing_id", "card_id"), "printings", ["printing_id"]), bucketed.bucketed(d.cards.select("card_id", "set_code"), "cards", ["card_id"])
    return H.completion(held, printings, cards, d.sets).withColumn("ratio", F.round("ratio", 6))


# --- transactions -------------------------------------------------------------------------------

_KEPT = f"NOT ((level IN ('debug', 'info') AND \"at\" < TIMESTAMP '{LOGS_NOW}' - INTERVAL 10 DAY) OR (level NOT IN ('debug', 'info') AND \"at\" < TIMESTAMP '{LOGS_NOW}' - INTERVAL 20 DAY))"


@query(f"SELECT count(*) FILTER ({_KEPT}) AS kept, count(*) FILTER (NOT {_KEPT}) AS removed, count(*) FILTER ({_KEPT}) AS rows_left FROM logs")
def log_sweep(d: Domain) -> DataFrame:
    path = f"{Scratch(d.spark, 'sweep').base}/logs"
    counts = snapshot.sweep(d.logs, path, F.lit(LOGS_NOW).cast("timestamp"), 10, 20)
    return d.spark.read.parquet(path).agg(F.lit(counts["kept"]).cast("long").alias("kept"), F.lit(counts["removed"]).cast("long").alias("removed"), F.count("*").alias("rows_left"))


@query(f"""WITH f AS (SELECT n, n % 3 <> 0 AS early, {_FAULT} AS f, 1 + (n % 2 = 0)::INT AS p FROM (SELECT p_partkey AS n FROM part)),
    c AS (SELECT count(*) FILTER (f IS NULL AND early) AS good, count(*) FILTER (f IS NULL AND NOT early) AS rest, sum(p) FILTER (f IS NULL AND early) AS p1, sum(p) FILTER (f IS NULL AND NOT early) AS p2, count(*) FILTER (f IS NOT NULL AND early) AS bad, count(*) FILTER (f IS NOT NULL) AS all_bad FROM f)
    SELECT 1 AS run, 1 AS version, good AS cards_added, 0::BIGINT AS cards_updated, 0::BIGINT AS cards_unchanged, p1::BIGINT AS printings_added, bad AS rejected, good AS cards FROM c UNION ALL
    SELECT 2, 2, rest, 0, good, p2::BIGINT, all_bad, good + rest FROM c UNION ALL SELECT 3, 2, 0, 0, good + rest, 0, all_bad, good + rest FROM c""")
def import_transactions(d: Domain) -> DataFrame:
    """Three imports, of which the last brings nothing new."""
    root = Scratch(d.spark, "catalog").base
    catalog, raw = snapshot.Snapshot(d.spark, f"{root}/snapshot"), _raw(d)
    rows = []
    for n, part in enumerate((raw.filter(F.col("collector_number").cast("long") % 3 != 0), raw, raw), 1):
        r = snapshot.import_catalog(catalog, part, "csv_seed", f"{root}/runs")
        rows.append((n, r["version"], *(r[c] for c in ("cards_added", "cards_updated", "cards_unchanged", "printings_added", "rejected")), catalog.read("cards").count()))
    return d.spark.createDataFrame(rows, "run int, version int, cards_added long, cards_updated long, cards_unchanged long, printings_added long, rejected long, cards long")


@query("""SELECT 2 AS version, count(DISTINCT item) AS items, sum(quantity) FILTER (late)::BIGINT AS copies_added FROM
    (SELECT quantity, user_id % 2 = 0 AS late, CASE WHEN is_graded THEN item_id || seq || quantity ELSE user_id || '/' || printing_id || '/' || condition END AS item FROM adds)""")
def holdings_committed(d: Domain) -> DataFrame:
    """Two collectors' files, each imported in one transaction."""
    held = snapshot.Snapshot(d.spark, Scratch(d.spark, "holdings").base)
    for late in (1, 0):
        done = snapshot.import_holdings(held, d.adds.filter(F.col("user_id") % 2 == late))
    return d.spark.createDataFrame([(done["version"], done["items"], done["copies_added"])], "version int, items long, copies_added long")


# --- a collector's CSV --------------------------------------------------------------------------

def _printings_of_parts(d: Domain) -> DataFrame:
    c = d.cards
    return c.select(F.concat(F.lit("p"), F.col("card_id").cast("string")).alias("printing_id"), "set_code", "collector_number", "name", F.lit("rare").alias("rarity"), F.lit("foil").alias("finish"), F.lit("en").alias("language"), F.lit("first").alias("edition"))


def _import_rows(d: Domain) -> DataFrame:
    n, none = F.col("card_id"), F.lit(None).cast("string")
    return d.cards.select(
        n.alias("line"), F.when(n % 5 == 0, F.concat(F.lit("p"), n.cast("string"))).when(n % 5 == 4, F.lit("p-unknown")).alias("printing_id"), "set_code",
        F.when(n % 5 < 4, F.col("collector_number")).otherwise("B?").alias("collector_number"), F.when(n % 5 == 4, F.lit("no such name at all")).otherwise(F.col("name")).alias("name"),
        F.when(n % 5 == 1, "Rare").when(n % 5 == 2, none).when(n % 5 == 3, "common").otherwise(none).alias("rarity"), F.when(n % 5 == 1, "Holofoil").alias("finish"),
        F.when(n % 5 == 1, "EN").alias("language"), F.when(n % 5 == 1, "1st Edition").alias("edition"), F.when(n % 7 == 0, "Near Mint").when(n % 7 == 1, "chewed").alias("condition"),
        F.when(n % 11 == 0, "0").when(n % 11 == 1, "two").otherwise((n % 9 + 1).cast("string")).alias("quantity"),
    )


@query("""SELECT p_partkey AS line, CASE WHEN p_partkey % 5 < 3 THEN 'p' || p_partkey WHEN p_partkey % 5 = 3 AND one THEN 'p' || p_partkey END AS match, CASE WHEN p_partkey % 5 < 3 THEN p_partkey % 5 + 1 WHEN p_partkey % 5 = 3 AND one THEN 4 END AS rung
    FROM (SELECT *, (SELECT count(*) FROM part q WHERE q.p_brand = p.p_brand AND levenshtein(lower(q.p_name), lower(p.p_name)) <= 2) = 1 AS one FROM part p)""")
def csv_match_ladder(d: Domain) -> DataFrame:
    return collection_csv.matched(_import_rows(d), _printings_of_parts(d)).select("line", "match", "rung")


@query("""SELECT outcome, count(*) AS rows, sum(copies)::BIGINT AS copies FROM (SELECT CASE WHEN n % 5 > 2 OR n % 7 = 1 OR n % 11 < 2 THEN 'reject' WHEN n % 2 = 0 THEN 'update' ELSE 'add' END AS outcome,
    CASE WHEN n % 11 < 2 THEN 0 ELSE n % 9 + 1 END AS copies FROM (SELECT p_partkey AS n FROM part)) GROUP BY outcome""")
def csv_import_dry_run(d: Domain) -> DataFrame:
    """Rows without a match, of unknown condition or without a good quantity are rejected; half of the rest is owned."""
    matches = collection_csv.matched(_import_rows(d).withColumn("name", F.concat(F.lit("x"), F.col("name"), F.lit("xx"))), _printings_of_parts(d))
    held = d.cards.filter("card_id % 2 = 0").select(F.concat(F.lit("p"), F.col("card_id").cast("string")).alias("printing_id"), F.lit("near_mint").alias("condition"), F.lit(False).alias("is_graded"), F.lit(1).alias("user_id"), F.lit(1).alias("quantity"))
    return collection_csv.dry_run(matches, held, 1)


# --- streaming forms ----------------------------------------------------------------------------


@query("""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 30 MINUTE, date_trunc('hour', ts) - INTERVAL 30 MINUTE]) AS w, ts FROM events)
    WHERE ts >= w AND ts < w + INTERVAL 1 HOUR GROUP BY ALL""")
def events_sliding(d: Domain) -> DataFrame:
    rows = T.sliding(d.table("events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "30 minutes")
    return rows.select(_time("window_start"), "event_type", "events")
