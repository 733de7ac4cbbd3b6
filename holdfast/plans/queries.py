"""The registry: each query over the domain's views, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..operators import holdings as H
from ..operators import ingest as I
from ..operators import operations as O
from ..operators import pricing as P
from ..operators import search as R
from ..scratch import Scratch, spread
from ..sources import bucketed
from ..sources.csv_seed import CsvSeed, write_seed
from ..streaming import streams as T
from .domain import CONDITIONS, LOGS_NOW, RANKED, RUNS_NOW, Domain, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Domain under its name; sql may name the domain's views."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def _time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


_T = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"

# --- completion ---------------------------------------------------------------------------------

_MEASURED = """SELECT user_id, set_code, count(DISTINCT card_id) AS owned, sum(quantity)::BIGINT AS quantity
    FROM adds JOIN printings USING (printing_id) JOIN cards USING (card_id) GROUP BY ALL"""
_RATIO = "CASE WHEN declared <> 0 THEN round(owned::DOUBLE / declared, 6) ELSE 0.0 END AS ratio"


@query(f"SELECT user_id, set_code, owned, quantity, card_count AS declared, {_RATIO.replace('declared', 'card_count')} FROM ({_MEASURED}) JOIN sets USING (set_code)")
def set_completion(d: Domain) -> DataFrame:
    return H.completion(d.adds, d.printings, d.cards, d.sets).withColumn("ratio", F.round("ratio", 6))


@query(f"""SELECT c_custkey AS user_id, set_code, card_count AS declared, coalesce(owned, 0) AS owned, coalesce(quantity, 0) AS quantity,
    {_RATIO.replace('declared', 'card_count').replace('owned::', 'coalesce(owned, 0)::')} FROM customer CROSS JOIN sets LEFT JOIN ({_MEASURED}) m ON m.user_id = c_custkey AND m.set_code = sets.set_code""".replace(" set_code, card_count AS", " sets.set_code, card_count AS"))  # fmt: skip
def completion_rebuild_all(d: Domain) -> DataFrame:
    users = d.table("customer").select(F.col("c_custkey").alias("user_id"))
    return H.rebuilt(users, d.adds, d.printings, d.cards, d.sets).withColumn("ratio", F.round("ratio", 6))


@query("SELECT DISTINCT user_id, set_code FROM adds JOIN printings USING (printing_id) JOIN cards USING (card_id) WHERE quantity >= 49")
def touched_sets(d: Domain) -> DataFrame:
    return H.touched_sets(d.adds.filter("quantity >= 49"), d.printings, d.cards)


@query("""SELECT percent, count(*) AS rows FROM (SELECT CASE WHEN card_count <> 0 THEN CAST(round(100.0 * least(owned::DOUBLE / card_count, 1.0)) AS INT)::VARCHAR || '%' END AS percent
    FROM (SELECT user_id, set_code, count(DISTINCT card_id) AS owned FROM adds JOIN printings USING (printing_id) JOIN cards USING (card_id) GROUP BY ALL) JOIN sets USING (set_code)) GROUP BY ALL""")
def completion_labels(d: Domain) -> DataFrame:
    return H.completion(d.adds, d.printings, d.cards, d.sets).groupBy(S.percent_label(F.col("ratio")).alias("percent")).agg(F.count("*").alias("rows"))


@query("SELECT card_id, collector_number FROM cards WHERE set_code = 'Brand#7' AND card_id NOT IN (SELECT card_id FROM adds JOIN printings USING (printing_id) WHERE user_id = 7)")
def missing_cards(d: Domain) -> DataFrame:
    return H.missing_cards(d.adds, d.printings, d.cards, 7, "Brand#7").select("card_id", "collector_number")


# --- search and browsing ------------------------------------------------------------------------


def _search_sql(term: str, where: str = "true", tail: str = "") -> str:
    t = f"lower(name) = '{term}'", f"starts_with(lower(name), '{term}')", f"contains(lower(name), ' {term}')", f"starts_with(lower(collector_number), '{term}')", f"lower(set_code) = '{term}'", f"contains(lower(name), '{term}')"
    cases = " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(t, 1))
    return f"""SELECT * FROM (SELECT cards.card_id, cards.set_code, collector_number, cards.name, CASE {cases.replace('lower(name)', 'lower(cards.name)').replace('lower(set_code)', 'lower(cards.set_code)')} END AS tier, released_on
        FROM cards JOIN sets ON sets.set_code = cards.set_code WHERE {where}) WHERE tier IS NOT NULL {tail}"""


_ORDER = "ORDER BY tier, coalesce(released_on, DATE '1900-01-01') DESC, collector_number, card_id"
_FOUND = ["card_id", "set_code", "collector_number", "name", "tier"]


def _page(d: Domain, q: R.Search) -> DataFrame:
    return R.page(R.matches(d.cards, d.sets, q, d.printings), q).select(*_FOUND)


@query(f"SELECT card_id, set_code, collector_number, name, tier FROM ({_search_sql('red', tail=_ORDER + ' LIMIT 25')})")
def search_ranked(d: Domain) -> DataFrame:
    return _page(d, R.Search("Red"))


@query(f"SELECT card_id, set_code, collector_number, name, tier FROM ({_search_sql('bolt', tail=_ORDER + ' LIMIT 25 OFFSET 25')})")
def search_page2(d: Domain) -> DataFrame:
    return _page(d, R.Search(" bolt ", offset=25))


@query(f"SELECT count(*) AS total FROM ({_search_sql('red')})")
def search_total(d: Domain) -> DataFrame:
    return R.total(R.matches(d.cards, d.sets, R.Search("red")))


@query(f"SELECT tier, match_kind, count(*) AS cards FROM (SELECT *, CASE tier WHEN 1 THEN 'exact_name' WHEN 2 THEN 'name_prefix' WHEN 3 THEN 'word_prefix' WHEN 4 THEN 'collector_number' WHEN 5 THEN 'set_code' ELSE 'infix' END AS match_kind FROM ({_search_sql('b')})) GROUP BY ALL LIMIT 0")
def search_short_term(d: Domain) -> DataFrame:
    return R.matches(d.cards, d.sets, R.Search("b")).groupBy("tier", "match_kind").agg(F.count("*").alias("cards"))


@query(f"SELECT card_id, set_code, collector_number, name, tier FROM ({_search_sql('brand#7')})")
def search_set_code(d: Domain) -> DataFrame:
    return R.matches(d.cards, d.sets, R.Search("Brand#7")).select(*_FOUND)


@query(f"SELECT card_id, set_code, collector_number, name, tier FROM ({_search_sql('%%')})")
def search_wildcards(d: Domain) -> DataFrame:
    return R.matches(d.cards, d.sets, R.Search("%%")).select(*_FOUND)


_TERMS = ["red", "bolt", "ol", "brand#7", "b000000", "ed b", "zz", "red bolt", "x"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS term, card_id, set_code, collector_number, name, tier FROM ({_search_sql(t) if len(t) > 1 else _search_sql(t, where='false')})" for t in _TERMS))
def search_indexed(d: Domain) -> DataFrame:
    """Searches of postings, as the scans find them."""
    index = R.GramIndex(d.spark, Scratch(d.spark, "grams").base).write(d.cards)
    found = [R.matches(index.candidates(q), d.sets, q).select(F.lit(q.term).alias("term"), *_FOUND) for q in map(R.Search, _TERMS)]
    return reduce(DataFrame.unionByName, found)


_ACCENTS = "SELECT card_id, set_code, name, CASE WHEN n = 'red' THEN 1 WHEN starts_with(n, 'red') THEN 2 WHEN contains(n, ' red') THEN 3 ELSE 6 END AS tier FROM (SELECT *, strip_accents(lower(name)) AS n FROM (SELECT card_id, set_code, CASE WHEN card_id % 2 = 0 THEN translate(name, 'eou', 'éÖü') ELSE upper(name) END AS name FROM cards)) WHERE contains(n, 'red')"


@query(_ACCENTS)
def search_any_accent(d: Domain) -> DataFrame:
    cards = d.cards.withColumn("name", F.when(F.col("card_id") % 2 == 0, F.translate("name", "eou", "éÖü")).otherwise(F.upper("name")))
    return R.matches(cards, d.sets, R.Search("Rêd", any_accent=True)).select("card_id", "set_code", "name", "tier")


_FILTERS = {"set_codes": ["Brand#1", "Brand#2", "Brand#3"], "card_types": ["PROMO", "SMALL"], "elements": ["red", "blue"]}


@query(f"SELECT card_id, set_code, collector_number, name, tier FROM ({_search_sql('bolt', where='''cards.set_code IN ('Brand#1', 'Brand#2', 'Brand#3') AND card_type IN ('PROMO', 'SMALL') AND element IN ('red', 'blue')''')})")
def search_filtered(d: Domain) -> DataFrame:
    return R.matches(d.cards, d.sets, R.Search("bolt", **_FILTERS)).select(*_FOUND)


@query(f"SELECT card_id, set_code, collector_number, name, tier FROM ({_search_sql('gear', where='''cards.card_id IN (SELECT card_id FROM printings WHERE rarity = 'R')''')})")
def search_any_printing(d: Domain) -> DataFrame:
    return R.matches(d.cards, d.sets, R.Search("gear", rarities=["R"]), d.printings).select(*_FOUND)


_RANK = "CASE rarity WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END"
_PRIMARY = f"SELECT card_id, printing_id, rarity, count(*) OVER (PARTITION BY card_id) AS printing_count FROM printings QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY {_RANK}, finish, edition, printing_id) = 1"


@query(f"SELECT p.card_id, name, tier, printing_id, rarity, coalesce(printing_count, 0) AS printing_count FROM ({_search_sql('red', tail=_ORDER + ' LIMIT 25')}) p LEFT JOIN ({_PRIMARY}) q ON p.card_id = q.card_id")
def search_hydrated(d: Domain) -> DataFrame:
    return R.hydrated(_page(d, R.Search("red")), d.printings, RANKED).select("card_id", "name", "tier", "printing_id", "rarity", "printing_count")


@query(_PRIMARY)
def primary_printing(d: Domain) -> DataFrame:
    return R.primary_printings(d.printings, RANKED)


@query("SELECT set_code, count(DISTINCT card_id) AS cards, count(*) AS printings FROM printings JOIN cards USING (card_id) GROUP BY ALL")
def printing_counts(d: Domain) -> DataFrame:
    per_card = d.printings.groupBy("card_id").agg(F.count("*").alias("n"))
    return per_card.join(d.cards, "card_id").groupBy("set_code").agg(F.count("*").alias("cards"), F.sum("n").alias("printings"))


@query(f"SELECT card_id, printing_id, row_number() OVER (PARTITION BY card_id ORDER BY {_RANK}, finish, edition, printing_id) AS place FROM printings")
def printings_ordered(d: Domain) -> DataFrame:
    return R.display_order(d.printings, RANKED).select("card_id", "printing_id", "place")


@query("SELECT card_id, printing_id, row_number() OVER (PARTITION BY card_id ORDER BY rarity, finish, edition, printing_id) AS place FROM printings")
def printings_alphabetical(d: Domain) -> DataFrame:
    return R.alphabetical_order(d.printings).select("card_id", "printing_id", "place")


@query("SELECT set_code, card_count, released_on::VARCHAR AS released_on, count(card_id) AS imported FROM sets LEFT JOIN cards USING (set_code) GROUP BY ALL")
def set_gallery(d: Domain) -> DataFrame:
    rows = R.gallery_order(R.gallery(d.sets, d.cards))
    return rows.select("set_code", "card_count", F.col("released_on").cast("string").alias("released_on"), "imported")


@query("SELECT set_code, imported FROM (SELECT set_code, series, count(card_id) AS imported FROM sets LEFT JOIN cards USING (set_code) GROUP BY ALL) WHERE series = 'S2'")
def set_gallery_series(d: Domain) -> DataFrame:
    return R.gallery(d.sets, d.cards, "S2").select("set_code", "imported")


@query("SELECT set_code, card_count AS expected, count(card_id) AS imported, card_count - count(card_id) AS missing_count FROM sets LEFT JOIN cards USING (set_code) GROUP BY set_code, card_count HAVING card_count > 0 AND count(card_id) < card_count")
def set_shortfall(d: Domain) -> DataFrame:
    return R.shortfall(d.sets, d.cards)


@query("SELECT card_id, collector_number, name FROM cards WHERE set_code = 'Brand#7' ORDER BY collector_number, card_id LIMIT 10 OFFSET 10")
def set_checklist(d: Domain) -> DataFrame:
    return R.checklist(d.cards, "Brand#7", 10, 10).select("card_id", "collector_number", "name")


@query(f"SELECT card_id, place, printing_id, cards.name || ' — ' || set_code || ' ' || rarity AS alt_text FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY {_RANK}, finish, edition, printing_id) AS place FROM printings) JOIN cards USING (card_id)")
def card_detail_nested(d: Domain) -> DataFrame:
    rows = R.card_detail(d.cards, d.sets, d.printings, RANKED).select("card_id", F.posexplode("printings").alias("i", "p"))
    return rows.select("card_id", (F.col("i") + 1).alias("place"), "p.printing_id", "p.alt_text")


@query("SELECT card_id, set_code, name FROM cards WHERE set_code = 'Brand#3' AND collector_number = (SELECT max(collector_number) FROM cards WHERE set_code = 'Brand#3')")
def card_by_number(d: Domain) -> DataFrame:
    mine = d.cards.filter("set_code = 'Brand#3'")
    return mine.agg(F.max_by(F.struct("card_id", "set_code", "name"), "collector_number").alias("c")).select("c.*")


# --- holdings -----------------------------------------------------------------------------------

_MERGED = """SELECT min_by(item_id, seq) AS item_id, user_id, printing_id, condition, false AS is_graded, sum(quantity)::BIGINT AS quantity, max(seq) AS last_seq FROM adds WHERE NOT is_graded GROUP BY user_id, printing_id, condition
    UNION ALL SELECT item_id, user_id, printing_id, condition, true, quantity::BIGINT, seq FROM adds WHERE is_graded"""


@query(_MERGED)
def holdings_merge(d: Domain) -> DataFrame:
    return H.merged(d.adds).select("item_id", "user_id", "printing_id", "condition", "is_graded", "quantity", "last_seq")


@query("""SELECT item_id, seq, CASE WHEN is_graded THEN false ELSE row_number() OVER (PARTITION BY user_id, printing_id, condition, is_graded ORDER BY seq, item_id) > 1 END AS merged FROM adds""")
def holdings_merged_flag(d: Domain) -> DataFrame:
    return H.merged_flag(d.adds).select("item_id", "seq", "merged")


_STATE = f"SELECT DISTINCT item_id, user_id, printing_id, condition, is_graded, quantity FROM ({_MERGED})"
_EDITED = f"""SELECT item_id, user_id, printing_id, CASE WHEN quantity % 2 = 0 AND NOT is_graded THEN 'N' ELSE condition END AS condition, is_graded, quantity, quantity % 2 = 0 AND NOT is_graded AS edited
    FROM (SELECT s.* REPLACE (regexp_replace(printing_id, '-[A-Z]$', '') AS printing_id) FROM ({_STATE}) s)"""


@query(f"""WITH e AS ({_EDITED}) SELECT user_id, printing_id, condition, false AS is_graded, sum(quantity)::BIGINT AS quantity, min(edited::INT * 1) = 1 AS none_before,
    min(CASE WHEN edited THEN '1' ELSE '0' END || item_id) AS survivor FROM e WHERE NOT is_graded GROUP BY user_id, printing_id, condition""")
def holdings_edit_collapse(d: Domain) -> DataFrame:
    """Half of the ungraded rows move to condition N; rows that meet there fold into the one that was there before."""
    state = H.merged(d.adds).select("item_id", "user_id", F.regexp_replace("printing_id", "-[A-Z]$", "").alias("printing_id"), "condition", "is_graded", "quantity")
    state = bucketed.bucketed(state, "state", ["item_id"]).distinct()
    patches = state.filter("NOT is_graded AND quantity % 2 = 0").select("item_id", F.lit("N").alias("condition"), F.lit(None).cast("boolean").alias("is_graded"), F.lit(None).cast("long").alias("quantity"))
    out = H.edited(state, patches).filter("NOT is_graded")
    known = out.join(patches.select("item_id", F.lit(True).alias("edited")), "item_id", "left").withColumn("edited", F.coalesce("edited", F.lit(False)))
    return known.select("user_id", "printing_id", "condition", "is_graded", "quantity", F.col("edited").alias("none_before"), F.concat(F.when(F.col("edited"), "1").otherwise("0"), "item_id").alias("survivor"))


@query("SELECT item_id, user_id, quantity FROM adds WHERE NOT (quantity = 1 AND condition = 'R')")
def holdings_remove(d: Domain) -> DataFrame:
    gone = d.adds.filter("quantity = 1 AND condition = 'R'").select("user_id", "item_id")
    return H.removed(d.adds, gone).select("item_id", "user_id", "quantity")


@query("SELECT item_id, printing_id, quantity FROM adds WHERE user_id = 7 ORDER BY seq DESC, item_id LIMIT 20")
def holdings_page(d: Domain) -> DataFrame:
    return H.owned_by(d.adds, 7).orderBy(F.desc("seq"), "item_id").limit(20).select("item_id", "printing_id", "quantity")


@query("SELECT user_id, count(*) AS items, sum(quantity)::BIGINT AS quantity FROM adds GROUP BY user_id")
def holdings_totals(d: Domain) -> DataFrame:
    return H.totals(d.adds)


@query("SELECT quantity BETWEEN 1 AND 10000 AND condition IN ('N', 'A') AS valid, count(*) AS rows FROM adds GROUP BY ALL")
def holdings_validate(d: Domain) -> DataFrame:
    ok, bad = H.split_valid(d.adds, ["N", "A"])
    return ok.select(F.lit(True).alias("valid")).union(bad.select(F.lit(False).alias("valid"))).groupBy("valid").agg(F.count("*").alias("rows"))


@query("SELECT user_id, printing_id, condition AS merge_condition, count(*) AS rows FROM adds WHERE NOT is_graded GROUP BY ALL HAVING count(*) > 1")
def holdings_twins(d: Domain) -> DataFrame:
    return H.twins(d.adds)


@query("SELECT count(DISTINCT user_id) AS users, sum(quantity)::BIGINT AS copies, count(DISTINCT printing_id) AS printings FROM adds")
def dashboard_totals(d: Domain) -> DataFrame:
    return d.adds.agg(F.count_distinct("user_id").alias("users"), F.sum("quantity").cast("long").alias("copies"), F.count_distinct("printing_id").alias("printings"))


@query(f"SELECT user_id, set_code, ratio FROM (SELECT user_id, set_code, {_RATIO.replace('declared', 'card_count')} FROM ({_MEASURED}) JOIN sets USING (set_code)) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ratio DESC, set_code) <= 3")
def dashboard_closest_sets(d: Domain) -> DataFrame:
    rows = H.completion(d.adds, d.printings, d.cards, d.sets).withColumn("ratio", F.round("ratio", 6))
    w = Window.partitionBy("user_id").orderBy(F.desc("ratio"), "set_code")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").select("user_id", "set_code", "ratio")


_AT = '"at"'  # a keyword in the oracle's SQL

# --- operations ---------------------------------------------------------------------------------

_LATEST = "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) = 1"


@query(f"SELECT source, run_id, status, {_T.format('started_at')} FROM runs QUALIFY rank() OVER (PARTITION BY source ORDER BY runs.started_at DESC) = 1")
def latest_run_ties(d: Domain) -> DataFrame:
    return O.latest_with_ties(d.runs).select("source", "run_id", "status", _time("started_at"))


@query(f"SELECT source, run_id, status FROM ({_LATEST})")
def latest_run_one(d: Domain) -> DataFrame:
    return O.latest(d.runs).select("source", "run_id", "status")


@query("SELECT run_id, source, status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1")
def newest_run(d: Domain) -> DataFrame:
    return O.newest(d.runs).select("run_id", "source", "status")


@query(f"SELECT run_id, status, {_T.format('started_at')} FROM (SELECT * FROM runs WHERE status = 'success' AND (started_at < TIMESTAMP '2000-06-01' OR (started_at = TIMESTAMP '2000-06-01' AND run_id < 5000)) ORDER BY started_at DESC, run_id DESC LIMIT 51)")
def runs_keyset_page(d: Domain) -> DataFrame:
    rows = O.listed(d.runs, status="success")
    return R.keyset_page(rows, "started_at", "run_id", ("2000-06-01 00:00:00", 5000), 51).select("run_id", "status", _time("started_at"))


@query("SELECT source, status, count(*) AS runs FROM runs WHERE started_at < TIMESTAMP '2000-01-01' GROUP BY ALL")
def run_counts(d: Domain) -> DataFrame:
    rows = O.listed(d.runs, before=F.lit("2000-01-01").cast("timestamp"))
    return rows.groupBy("source", "status").agg(F.count("*").alias("runs"))


_AGE = f"CASE WHEN success_at IS NOT NULL THEN greatest(0.0, epoch_us(TIMESTAMP '{RUNS_NOW}' - success_at) / 3.6e9) END"
_STATE_SQL = f"CASE WHEN success_at IS NULL THEN 'never_run' WHEN {_AGE} >= 168 THEN 'stale' WHEN {_AGE} >= 48 THEN 'ageing' ELSE 'fresh' END AS state"


@query(f"""SELECT source, run_id, status AS last_status, round({_AGE}, 2) AS age_hours, {_STATE_SQL} FROM (SELECT r.source, run_id, status, CASE WHEN status = 'success' THEN finished_at END AS success_at
    FROM (SELECT DISTINCT source FROM runs UNION ALL SELECT 'never') r LEFT JOIN ({_LATEST}) l ON r.source = l.source)""")
def source_health(d: Domain) -> DataFrame:
    registry = d.runs.select("source").distinct().union(d.spark.createDataFrame([("never",)], "source string"))
    return O.source_health(registry, d.runs, F.lit(RUNS_NOW).cast("timestamp")).drop("started_at")


@query(f"SELECT source, round({_AGE}, 2) AS age_hours, {_STATE_SQL} FROM (SELECT source, max(finished_at) AS success_at FROM runs WHERE status = 'success' GROUP BY source)")
def staleness(d: Domain) -> DataFrame:
    age, state = S.staleness(F.col("last_success_at"), F.lit(RUNS_NOW).cast("timestamp"))
    return O.last_success(d.runs).select("source", age.alias("age_hours"), state.alias("state"))


@query("SELECT reason_code, count(*) AS count, min(source_ref) AS example_source_ref FROM rejections GROUP BY reason_code")
def rejection_rollup(d: Domain) -> DataFrame:
    return O.rejection_rollup(d.rejections)


@query("SELECT id, reason_code, source_ref FROM rejections WHERE import_id = 8 ORDER BY created_at, id LIMIT 101")
def rejections_page(d: Domain) -> DataFrame:
    return d.rejections.filter("import_id = 8").orderBy("created_at", "id").limit(101).select("id", "reason_code", "source_ref")


@query(f"SELECT log_id, level FROM logs WHERE NOT ((level IN ('debug', 'info') AND {_AT} < TIMESTAMP '{LOGS_NOW}' - INTERVAL 10 DAY) OR (level NOT IN ('debug', 'info') AND {_AT} < TIMESTAMP '{LOGS_NOW}' - INTERVAL 20 DAY))")
def log_retention(d: Domain) -> DataFrame:
    return O.kept_logs(d.logs, F.lit(LOGS_NOW).cast("timestamp"), 10, 20).select("log_id", "level")


@query("SELECT forwarded, level, category, count(*) AS rows FROM (SELECT *, level IN ('error', 'critical') OR category = 'security' AS forwarded FROM logs) GROUP BY ALL")
def log_routing(d: Domain) -> DataFrame:
    return O.routed(d.logs).groupBy("forwarded", "level", "category").agg(F.count("*").alias("rows"))


@query("""SELECT status_code, CASE WHEN status_code IN (401, 403) THEN 'warning' WHEN status_code >= 500 THEN 'error' ELSE 'info' END AS level,
    CASE WHEN status_code IN (401, 403) THEN 'security' ELSE 'http' END AS category, count(*) AS requests FROM logs GROUP BY ALL""")
def request_severity(d: Domain) -> DataFrame:
    level, category = S.request_severity(F.col("status_code"))
    return d.logs.groupBy("status_code", level.alias("level"), category.alias("category")).agg(F.count("*").alias("requests"))


@query(f"SELECT log_id, level FROM logs WHERE level = 'error' ORDER BY {_AT} DESC, log_id DESC LIMIT 50")
def recent_logs(d: Domain) -> DataFrame:
    return O.recent(d.logs, 50, "error").select("log_id", "level")


@query("SELECT level, count(*) AS n, round(median(duration), 6) AS median, max(duration) AS max, max(duration) FILTER (r = greatest(CAST(floor(c * 0.95) AS INT), 1)) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY duration) AS r, count(*) OVER (PARTITION BY level) AS c FROM logs) GROUP BY level")
def latency_stats(d: Domain) -> DataFrame:
    return O.latency(d.logs, ["level"], "duration").withColumn("median", F.round("median", 6))


@query("SELECT log_id, split_part(path, '?', 1) AS path FROM logs")
def strip_query(d: Domain) -> DataFrame:
    return d.logs.select("log_id", S.strip_query(F.col("path")).alias("path"))


@query("SELECT feature, sum(quantity)::BIGINT AS quantity FROM (SELECT CASE event_type WHEN 'click' THEN 'catalog.searched' WHEN 'purchase' THEN 'listing.created' ELSE event_type END AS feature, CAST(floor(value) AS BIGINT) - 10 AS quantity FROM events) WHERE feature IN ('catalog.searched', 'listing.created') AND quantity > 0 GROUP BY feature")
def usage_metering(d: Domain) -> DataFrame:
    kind = F.col("event_type")
    usage = d.table("events").select(F.when(kind == "click", "catalog.searched").when(kind == "purchase", "listing.created").otherwise(kind).alias("feature"), (F.floor("value") - 10).alias("quantity"))
    return O.metered(usage).groupBy("feature").agg(F.sum("quantity").cast("long").alias("quantity"))


@query("SELECT handle, count(*) AS holders FROM (SELECT lower(c_mktsegment) || '_' || c_nationkey AS handle FROM customer) GROUP BY handle HAVING count(*) > 1")
def taken_handles(d: Domain) -> DataFrame:
    profiles = d.table("customer").select(F.concat_ws("_", F.lower("c_mktsegment"), "c_nationkey").alias("handle"))
    return O.taken_handles(profiles)


@query("SELECT log_id, rtrim(translate(to_base64(encode(log_id::VARCHAR)), '+/', '-_'), '') AS cursor, log_id AS back FROM logs")
def cursor_codec(d: Domain) -> DataFrame:
    rows = d.logs.select("log_id", S.cursor_of(F.col("log_id")).alias("cursor"))
    return rows.withColumn("back", S.offset_of(F.col("cursor")))


@query("SELECT log_id, CASE WHEN log_id % 3 = 0 THEN '[redacted]' ELSE props END AS value FROM logs")
def redact_flat(d: Domain) -> DataFrame:
    key = F.when(F.col("log_id") % 3 == 0, "user_password").otherwise("note")
    rows = d.logs.select("log_id", F.create_map(key, "props").alias("context"))
    return rows.select("log_id", F.map_values(S.redact_flat(F.col("context")))[0].alias("value"))


@query("SELECT log_id, '{\"auth\":\"[redacted]\",\"deep\":[{\"k\":' || json_extract_string(props, '$.k') || '}]}' AS context FROM logs")
def redact_deep(d: Domain) -> DataFrame:
    nested = F.concat(F.lit('{"auth": "x", "deep": ['), "props", F.lit("]}"))
    return d.logs.select("log_id", S.redact_json(nested).alias("context"))


# --- ingest -------------------------------------------------------------------------------------

_NUMBERED = "SELECT set_code, 'B-' || lpad((card_id % 40 + 1)::VARCHAR, 3, '0') AS collector_number FROM cards"


def _numbered(d: Domain) -> DataFrame:
    number = F.lpad((F.col("card_id") % 40 + 1).cast("string"), 3, "0")
    return d.cards.select("set_code", F.concat(F.lit("B-"), number).alias("collector_number"))


@query(f"""SELECT set_code, card_count AS expected, imported, greatest(0, card_count - imported) AS missing_count, imported >= card_count AS complete
    FROM sets JOIN (SELECT set_code, count(DISTINCT collector_number) AS imported FROM ({_NUMBERED}) GROUP BY set_code) USING (set_code)""")
def coverage_report(d: Domain) -> DataFrame:
    return I.coverage(_numbered(d), d.sets).drop("missing_numbers")


@query(f"""SELECT set_code, 'B-' || lpad(n::VARCHAR, 3, '0') AS missing FROM sets, (SELECT unnest(generate_series(1, 2000)) AS n) WHERE n <= card_count AND card_count >= (SELECT max(card_id % 40 + 1) FROM cards c WHERE c.set_code = sets.set_code)
    AND NOT EXISTS (SELECT 1 FROM ({_NUMBERED}) x WHERE x.set_code = sets.set_code AND x.collector_number = 'B-' || lpad(n::VARCHAR, 3, '0'))""")
def coverage_gaps(d: Domain) -> DataFrame:
    return I.coverage(_numbered(d), d.sets).select("set_code", F.explode("missing_numbers").alias("missing"))


def _catalog(cards: DataFrame) -> DataFrame:
    blank = F.lit(None).cast("string")
    return cards.select(
        "set_code", "collector_number", "name", "card_type", "element", blank.alias("rune_type"), blank.alias("subtype"), "attack", F.lit(None).cast("int").alias("defence"),
        F.lit(None).cast("map<string,bigint>").alias("spirit_cost"), blank.alias("rules_text"), blank.alias("flavour_text"), blank.alias("artist"),
    )


@query("SELECT set_code, collector_number, CASE WHEN card_id % 11 = 0 THEN 'added' WHEN card_id % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM cards")
def catalog_diff(d: Domain) -> DataFrame:
    """Every eleventh card is new, of the others every seventh has another attack."""
    old = d.cards.filter("card_id % 11 != 0").withColumn("attack", F.when(F.col("card_id") % 7 == 0, F.col("attack") + 1).otherwise(F.col("attack")))
    return I.diff(I.card_rows(_catalog(d.cards)), I.card_rows(_catalog(old)), I.CARD_KEY)


@query("SELECT set_code, collector_number, 'x' AS outcome FROM cards LIMIT 0")
def catalog_diff_noop(d: Domain) -> DataFrame:
    """The second pass over the same catalog has no changes."""
    rows = I.card_rows(_catalog(d.cards))
    return I.diff(rows, I.card_rows(_catalog(d.cards)), I.CARD_KEY).filter("outcome != 'unchanged'")


@query("SELECT count(*) AS rows, sum(attack)::BIGINT AS attack FROM cards")
def catalog_upsert(d: Domain) -> DataFrame:
    old = I.card_rows(_catalog(d.cards.filter("card_id % 11 != 0").withColumn("attack", F.lit(0))))
    new = I.card_rows(_catalog(d.cards.filter("card_id % 2 = 0 OR card_id % 11 = 0")))
    kept = I.upserted(new, old, I.CARD_KEY)
    # the odd half is still the old snapshot's; the next import brings it up to date
    last = I.upserted(I.card_rows(_catalog(d.cards.filter("card_id % 2 != 0"))), kept, I.CARD_KEY)
    return last.agg(F.count("*").alias("rows"), F.sum("attack").cast("long").alias("attack"))


@query("SELECT set_code FROM sets WHERE series = 'S1' OR released_on IS NULL")
def set_upsert_changes(d: Domain) -> DataFrame:
    new = d.sets.withColumn("logo_asset_url", F.lit(None).cast("string"))
    old = new.withColumn("name", F.when(F.col("series") == "S1", "old").otherwise(F.col("name"))).withColumn("released_on", F.coalesce("released_on", F.lit("1999-01-01").cast("date")))
    return I.changed_sets(new, old).select("set_code")


def _raw(d: Domain, apart: bool = False) -> DataFrame:
    """Raw rows with faults by the part's number: one row a printing, two printings a card at most. apart: some second
    rows have another attack than the first."""
    part = spread(d.table("part").select("p_partkey", "p_brand", "p_name", "p_size"), "p_partkey")
    n = F.col("p_partkey")
    base = part.select(
        F.col("p_brand").alias("set_code"), F.lpad(n.cast("string"), 8, "0").alias("collector_number"), F.when(n % 13 == 0, "").otherwise(F.col("p_name")).alias("name"),
        F.when(n % 17 == 0, "Gadget").otherwise("Elestrals").alias("card_type"), F.when(n % 19 == 0, "plasma").otherwise(" Fire ").alias("element"),
        F.when(n % 23 == 0, "lots").otherwise(F.col("p_size").cast("string")).alias("attack"),
        F.when(n % 29 == 0, '{"fire": -1}').when(n % 31 == 0, '{"Fire": 2}').otherwise("").alias("spirit_cost"), n.alias("n"),
    )
    first = base.withColumns({"rarity": F.lit("Holo Rare"), "finish": F.lit("Holofoil"), "edition": F.lit("1st"), "line": F.col("n") * 2})
    second = base.filter("n % 2 = 0").withColumns({"rarity": F.when(F.col("n") % 37 == 0, "mythic").otherwise("common"), "finish": F.lit("normal"), "edition": F.lit("first"), "line": F.col("n") * 2 + 1})
    if apart:
        second = second.withColumn("attack", F.when(F.col("n") % 43 == 0, "999").otherwise(F.col("attack")))
    third = base.filter("n % 41 = 0").withColumns({"rarity": F.lit("holo"), "finish": F.lit("foil"), "edition": F.lit("first"), "line": F.col("n") * 2 + 2})
    return first.unionByName(second).unionByName(third).withColumn("source_ref", F.concat_ws(":", "set_code", "line")).drop("n")


_FAULT = """CASE WHEN n % 13 = 0 THEN 'missing_required_field/name' WHEN n % 17 = 0 THEN 'missing_required_field/card_type' WHEN n % 19 = 0 THEN 'type_field_mismatch/element'
    WHEN n % 23 = 0 THEN 'type_field_mismatch/attack' WHEN n % 29 = 0 THEN 'invalid_spirit_cost/spirit_cost' WHEN n % 2 = 0 AND n % 37 = 0 THEN 'unknown_rarity/rarity'
    WHEN n % 41 = 0 THEN 'duplicate_printing_key/rarity' END"""


@query(f"SELECT collector_number, split_part(f, '/', 1) AS reason_code, split_part(f, '/', 2) AS field FROM (SELECT lpad(p_partkey::VARCHAR, 8, '0') AS collector_number, {_FAULT.replace('n %', 'p_partkey %')} AS f FROM part) WHERE f IS NOT NULL")
def normalise_rejections(d: Domain) -> DataFrame:
    return I.normalised(_raw(d))[1].select("collector_number", "reason_code", "field")


@query(f"""SELECT collector_number, name, 'elestral' AS card_type, 'fire' AS element, attack, CASE WHEN n % 31 = 0 THEN 2 END AS fire_cost, (1 + (n % 2 = 0)::INT) AS printings
    FROM (SELECT p_partkey AS n, lpad(p_partkey::VARCHAR, 8, '0') AS collector_number, p_name AS name, p_size AS attack FROM part) WHERE {_FAULT} IS NULL""")
def normalise_cards(d: Domain) -> DataFrame:
    cards = I.normalised(_raw(d))[0]
    return cards.select("collector_number", "name", "card_type", "element", "attack", F.col("spirit_cost")["fire"].cast("int").alias("fire_cost"), F.size("printings").alias("printings"))


@query(f"""WITH f AS (SELECT p_partkey AS n, p_brand AS b, p_name, p_size::VARCHAR AS size, CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 86 = 0 THEN 'conflicting_card_fields/attack' ELSE {_FAULT.replace('n %', 'p_partkey %')} END AS f FROM part),
    a AS (SELECT *, split_part(f, '/', 1) AS reason_code, split_part(f, '/', 2) AS field, 2 * n + CASE WHEN reason_code IN ('conflicting_card_fields', 'unknown_rarity') THEN 1 WHEN reason_code = 'duplicate_printing_key' THEN 2 ELSE 0 END AS line,
          CASE WHEN n % 23 = 0 THEN 'lots' ELSE size END AS first_attack, CASE WHEN n % 29 = 0 THEN '{{"fire": -1}}' WHEN n % 31 = 0 THEN '{{"Fire": 2}}' ELSE '' END AS cost FROM f WHERE f IS NOT NULL)
    SELECT reason_code, field, b || ':' || line AS source_ref,
        CASE WHEN reason_code = 'conflicting_card_fields' THEN '`attack` is "' || first_attack || '" at ' || b || ':' || 2 * n || ' and "999" at ' || b || ':' || line || '.' WHEN field = 'name' THEN 'A value for `name` must be given.' WHEN field = 'card_type' THEN 'Unrecognised card_type Gadget'
             WHEN field = 'element' THEN 'Unrecognised element plasma' WHEN field = 'attack' THEN '`attack` must be an integer.' WHEN field = 'spirit_cost' THEN 'Invalid cost ' || cost WHEN reason_code = 'unknown_rarity' THEN 'Unrecognised rarity mythic' ELSE 'Two rows give the same printing.' END AS message,
        to_json({{'collector_number': lpad(n::VARCHAR, 8, '0'), 'name': CASE WHEN n % 13 = 0 THEN '' ELSE p_name END, 'card_type': CASE WHEN n % 17 = 0 THEN 'Gadget' ELSE 'Elestrals' END, 'element': CASE WHEN n % 19 = 0 THEN 'plasma' ELSE 'Fire' END, 'rune_type': '', 'subtype': '',
            'attack': CASE WHEN reason_code = 'conflicting_card_fields' THEN '999' ELSE first_attack END, 'defence': '', 'spirit_cost': cost, 'rules_text': '', 'flavour_text': '', 'artist': '',
            'rarity': CASE WHEN line % 2 = 0 THEN CASE WHEN line > 2 * n THEN 'holo' ELSE 'Holo Rare' END WHEN n % 37 = 0 THEN 'mythic' ELSE 'common' END, 'finish': CASE WHEN line % 2 = 1 THEN 'normal' WHEN line > 2 * n THEN 'foil' ELSE 'Holofoil' END,
            'language': '', 'edition': CASE WHEN line = 2 * n THEN '1st' ELSE 'first' END, 'image_url': '', 'is_tracked_for_price': ''}})::VARCHAR AS raw_record FROM a""")
def normalise_messages(d: Domain) -> DataFrame:
    return I.normalised(_raw(d, apart=True))[1].drop("set_code", "collector_number")


@query("SELECT p_type, CASE WHEN p_type = 'PROMO' THEN 'promo' END AS rarity, count(*) AS rows FROM part GROUP BY ALL")
def vocabulary_fold(d: Domain) -> DataFrame:
    return d.table("part").groupBy("p_type", V.rarity(F.concat(F.lit(" "), "p_type", F.lit("-"))).alias("rarity")).agg(F.count("*").alias("rows"))


@query("SELECT CASE WHEN k < 0 THEN 'negative' WHEN k % 3 = 0 THEN 'unknown' ELSE 'good' END AS kind, k >= 0 AND k % 3 <> 0 AS valid, count(*) AS rows FROM (SELECT event_id % 10 - 2 AS k FROM events) GROUP BY ALL")
def spirit_cost_validate(d: Domain) -> DataFrame:
    k = F.col("k")
    rows = d.table("events").select((F.col("event_id") % 10 - 2).alias("k"))
    text = F.concat(F.lit('{"'), F.when((k >= 0) & (k % 3 == 0), "plasma").otherwise("Water"), F.lit('": '), k.cast("string"), F.lit("}"))
    kind = F.when(k < 0, "negative").when(k % 3 == 0, "unknown").otherwise("good")
    return rows.groupBy(kind.alias("kind"), S.spirit_cost(text)[1].alias("valid")).agg(F.count("*").alias("rows"))


@query("""SELECT p_brand AS set_code, count(*) AS rows, min(collector_number) AS first, max(line)::INT AS last_line, max(CASE WHEN line = 2 THEN p_brand || '.csv:2' END) AS source_ref FROM
    (SELECT p_brand, lpad(p_partkey::VARCHAR, 8, '0') AS collector_number, 1 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line FROM part WHERE substr(p_brand, 7, 1) IN ('1', '2')) GROUP BY p_brand""")
def seed_files(d: Domain) -> DataFrame:
    """Sets written as files, one a set, and some of them read back."""
    root = Scratch(d.spark, "seed").base
    rows = d.table("part").select(F.col("p_brand").alias("set_code"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("collector_number"), F.col("p_name").alias("name"))
    write_seed(rows, root)
    read = CsvSeed(d.spark, root).fetch([f"Brand#{i}{j}" for i in (1, 2) for j in ("", *range(10))])
    first = F.min(F.when(F.col("line") == 2, F.col("source_ref")))
    return read.groupBy("set_code").agg(F.count("*").alias("rows"), F.min("collector_number").alias("first"), F.max("line").alias("last_line"), first.alias("source_ref"))


# --- pricing ------------------------------------------------------------------------------------


@query("SELECT printing_id, day::VARCHAR AS day, min(price) AS low, round(median(price), 9) AS median, max(price) AS high, round(avg(price), 9) AS mean, count(*) AS n, count(DISTINCT source_id) AS sources FROM observations GROUP BY printing_id, observations.day")
def price_daily(d: Domain) -> DataFrame:
    rows = P.daily(d.observations).withColumn("day", F.col("day").cast("string"))
    return rows.withColumns({c: F.round(c, 9) for c in ("median", "mean")})


@query("""SELECT printing_id, count(*) AS n, round(median(price), 4) AS median FROM observations JOIN (SELECT printing_id, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM observations GROUP BY printing_id) USING (printing_id)
    WHERE price BETWEEN q1 - 0.3 * (q3 - q1) AND q3 + 0.3 * (q3 - q1) GROUP BY printing_id""")
def price_daily_iqr(d: Domain) -> DataFrame:
    kept = P.within_spread(d.observations, ["printing_id"], spread=0.3)
    return kept.groupBy("printing_id").agg(F.count("*").alias("n"), F.round(F.median("price"), 4).alias("median"))


@query("""SELECT printing_id, sold, sources, CASE WHEN sold >= 5 AND sources >= 2 THEN 'high' WHEN sold >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM
    (SELECT printing_id, count(*) FILTER (kind = 'sold') AS sold, count(DISTINCT source_id) FILTER (kind = 'sold') AS sources FROM observations GROUP BY printing_id)""")
def price_confidence(d: Domain) -> DataFrame:
    return P.rated(d.observations, ["printing_id"])


@query("""SELECT user_id, round(coalesce(sum(quantity * price), 0), 2) AS value, count(price) AS priced, count(*) - count(price) AS unpriced FROM adds a
    LEFT JOIN (SELECT p_partkey, p_retailprice AS price FROM part WHERE p_partkey % 5 <> 0) ON p_partkey = split_part(a.printing_id, '-', 1)::BIGINT GROUP BY user_id""")
def valuation_coverage(d: Domain) -> DataFrame:
    prices = d.table("part").filter("p_partkey % 5 != 0").select(F.col("p_partkey").alias("printing_id"), F.col("p_retailprice").alias("price"))
    held = d.adds.select("user_id", "quantity", F.substring_index("printing_id", "-", 1).cast("long").alias("printing_id"))
    return P.valued(held, prices).withColumn("value", F.round("value", 2))


@query("""SELECT printing_id, round(now / was - 1, 4) AS move FROM (SELECT printing_id, median(price) FILTER (year(day) = 1998) AS was, median(price) FILTER (year(day) = 1999) AS now, count(*) FILTER (year(day) = 1998) AS n1, count(*) FILTER (year(day) = 1999) AS n2
    FROM observations GROUP BY printing_id) WHERE n1 >= 3 AND n2 >= 3 ORDER BY round(abs(now / was - 1), 4) DESC, printing_id LIMIT 20""")
def top_movers(d: Domain) -> DataFrame:
    yearly = d.observations.withColumn("day", F.trunc("day", "year"))
    return P.movers(P.daily(yearly), "1998-01-01", "1999-01-01", 3, 20).select("printing_id", F.round("move", 4).alias("move"))


@query("SELECT printing_id, day::VARCHAR AS day, price * (1 + epoch(day) / 86400 % 7 / 10) AS price FROM observations WHERE source_id % 2 = 0 UNION ALL SELECT printing_id, day::VARCHAR, NULL FROM observations WHERE source_id % 2 = 1")
def price_converted(d: Domain) -> DataFrame:
    seen = d.observations.withColumn("currency", F.when(F.col("source_id") % 2 == 0, "EUR").otherwise("JPY"))
    rates = d.observations.select("day").distinct().select("day", F.lit("EUR").alias("base"), F.lit("USD").alias("quote"), (1 + F.datediff("day", F.lit("1970-01-01").cast("date")) % 7 / 10).alias("rate"))
    return P.converted(seen, rates, "USD").select("printing_id", F.col("day").cast("string").alias("day"), "price")


@query("SELECT printing_id, source_id, min(price) AS price FROM observations QUALIFY false GROUP BY ALL".replace(" QUALIFY false", ""))
def observation_dedupe(d: Domain) -> DataFrame:
    rows = d.observations.select("source_id", F.col("printing_id").alias("external_id"), F.lit(0).alias("at"), "price")
    return P.deduplicated(rows).select(F.col("external_id").alias("printing_id"), "source_id", "price")


@query("SELECT l_orderkey AS order_id, max(l_returnflag) AS status FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1 GROUP BY l_orderkey")
def order_status(d: Domain) -> DataFrame:
    events = d.table("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("event_id"), F.col("l_returnflag").alias("type"))
    return P.order_status(events).select("order_id", "status")


# --- streaming forms over a bounded table (an extension) ----------------------------------------


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def events_tumbling(d: Domain) -> DataFrame:
    rows = T.tumbling(d.table("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(_time("window_start"), "event_type", "events", F.round("value", 4).alias("value"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def events_dedupe_watermark(d: Domain) -> DataFrame:
    return T.deduplicated(d.table("events"), ["user_id", "event_type"], "1 hour").select("user_id", "event_type")


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def events_session(d: Domain) -> DataFrame:
    rows = T.sessions(d.table("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select("user_id", _time("session_start"), "events")
