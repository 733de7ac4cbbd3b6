"""The domain's tables as views of the synthetic star schema, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import spread

RANKED = ["N", "A", "R"]  #: rarities here, commonest first
CONDITIONS = ["N", "A", "R"]
RUNS_NOW, LOGS_NOW = "2001-08-05 00:00:00", "2024-01-25 00:00:00"
_STATUS = {"F": "success", "O": "partial", "P": "failed"}
_LEVEL = {"view": "debug", "click": "info", "signup": "warning", "error": "error", "purchase": "critical"}


def _case(column, table: dict):
    out = None
    for k, v in table.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out


class Domain:
    """Lazy views over a folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def sets(self) -> DataFrame:
        """One row a brand; the declared size is the mean number of parts, so some sets are short."""
        part = self.table("part")
        brands = part.groupBy("p_brand").agg(F.count("*").alias("n"))
        size = brands.agg(F.ceil(F.sum("n").cast("double") / F.count("*")).cast("int").alias("card_count"))
        number = F.substring("p_brand", 7, 9).cast("int")
        dated = F.when(number % 5 != 0, F.date_add(F.lit("2020-01-01").cast("date"), number % 4 * 100))
        return brands.join(F.broadcast(size)).select(
            F.col("p_brand").alias("set_code"), F.col("p_brand").alias("name"), F.concat(F.lit("S"), F.substring("p_brand", 7, 1)).alias("series"),
            dated.alias("released_on"), "card_count",
        )

    @property
    def cards(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("card_id"), F.col("p_brand").alias("set_code"), F.concat(F.lit("B"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("collector_number"),
            F.col("p_name").alias("name"), F.col("p_type").alias("card_type"), F.substring_index("p_name", " ", 1).alias("element"), F.col("p_size").alias("attack"),
        )

    @property
    def printings(self) -> DataFrame:
        # dealt first: a task that reads many rows would hold nearly as many distinct ones
        keys = spread(self.table("lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), "l_partkey", "l_suppkey").distinct()
        return keys.select(
            F.concat_ws("-", "l_partkey", "l_suppkey", "l_returnflag").alias("printing_id"), F.col("l_partkey").alias("card_id"),
            F.col("l_returnflag").alias("rarity"), F.when(F.col("l_suppkey") % 3 == 0, "foil").otherwise("normal").alias("finish"),
            F.when(F.col("l_suppkey") % 2 == 0, "first").otherwise("unlimited").alias("edition"),
        )

    @property
    def adds(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
        day, copies = F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_quantity").cast("int")
        item = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day, copies.cast("string"))
        rows = lines.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.select(
            item.alias("item_id"), F.col("o_custkey").alias("user_id"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_returnflag").alias("printing_id"),
            F.col("l_returnflag").alias("condition"), (F.col("l_linestatus") == "F").alias("is_graded"), copies.alias("quantity"),
            F.concat_ws("/", day, item).alias("seq"),
        )

    @property
    def runs(self) -> DataFrame:
        o = self.table("orders")
        started = F.col("o_orderdate").cast("timestamp")
        return o.select(
            F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("source"), _case(F.col("o_orderstatus"), _STATUS).alias("status"),
            started.alias("started_at"), (started + F.expr("INTERVAL 1 HOUR")).alias("finished_at"),
        )

    @property
    def rejections(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("import_id"), F.col("event_type").alias("reason_code"),
            F.concat(F.lit("F:"), F.col("event_id").cast("string")).alias("source_ref"), F.col("ts").cast("timestamp").alias("created_at"),
        )

    @property
    def logs(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("log_id"), F.col("ts").cast("timestamp").alias("at"), _case(F.col("event_type"), _LEVEL).alias("level"),
            F.when(F.col("user_id") % 10 == 0, "security").otherwise("http").alias("category"), (200 + F.col("event_id") % 5 * 100 + F.col("event_id") % 4).cast("int").alias("status_code"),
            F.concat(F.lit("/p/"), F.col("event_id").cast("string"), F.lit("?k="), F.col("user_id").cast("string")).alias("path"), F.col("value").alias("duration"), "props",
        )

    @property
    def observations(self) -> DataFrame:
        lines = self.table("lineitem")
        return lines.select(
            F.col("l_partkey").alias("printing_id"), F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("source_id"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.when(F.col("l_returnflag") == "N", "sold").otherwise("listed").alias("kind"),
        )


def _sql_case(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


VIEWS = {
    "sets": """SELECT p_brand AS set_code, p_brand AS name, 'S' || substr(p_brand, 7, 1) AS series,
        CASE WHEN CAST(substr(p_brand, 7) AS INT) % 5 <> 0 THEN DATE '2020-01-01' + CAST(substr(p_brand, 7) AS INT) % 4 * 100 END AS released_on,
        CAST(ceil((SELECT count(*) FROM part)::DOUBLE / (SELECT count(DISTINCT p_brand) FROM part)) AS INT) AS card_count
        FROM (SELECT DISTINCT p_brand FROM part)""",
    "cards": """SELECT p_partkey AS card_id, p_brand AS set_code, 'B' || lpad(p_partkey::VARCHAR, 8, '0') AS collector_number, p_name AS name,
        p_type AS card_type, split_part(p_name, ' ', 1) AS element, p_size AS attack FROM part""",
    "printings": """SELECT l_partkey || '-' || l_suppkey || '-' || l_returnflag AS printing_id, l_partkey AS card_id, l_returnflag AS rarity,
        CASE WHEN l_suppkey % 3 = 0 THEN 'foil' ELSE 'normal' END AS finish, CASE WHEN l_suppkey % 2 = 0 THEN 'first' ELSE 'unlimited' END AS edition
        FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem)""",
    "adds": """SELECT *, day || '/' || item_id AS seq FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'), l_quantity::INT) AS item_id,
        o_custkey AS user_id, l_partkey || '-' || l_suppkey || '-' || l_returnflag AS printing_id, l_returnflag AS condition, l_linestatus = 'F' AS is_graded,
        l_quantity::INT AS quantity, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "runs": f"""SELECT o_orderkey AS run_id, o_orderpriority AS source, {_sql_case('o_orderstatus', _STATUS)} AS status, o_orderdate AS started_at,
        o_orderdate + INTERVAL 1 HOUR AS finished_at FROM orders""",
    "rejections": "SELECT event_id AS id, user_id AS import_id, event_type AS reason_code, 'F:' || event_id AS source_ref, ts AS created_at FROM events",
    "logs": f"""SELECT event_id AS log_id, ts AS "at", {_sql_case('event_type', _LEVEL)} AS level, CASE WHEN user_id % 10 = 0 THEN 'security' ELSE 'http' END AS category,
        (200 + event_id % 5 * 100 + event_id % 4)::INT AS status_code, '/p/' || event_id || '?k=' || user_id AS path, value AS duration, props FROM events""",
    "observations": """SELECT l_partkey AS printing_id, l_shipdate::DATE AS day, l_suppkey AS source_id, l_extendedprice / l_quantity AS price,
        CASE WHEN l_returnflag = 'N' THEN 'sold' ELSE 'listed' END AS kind FROM lineitem""",
}


def with_views(sql: str) -> str:
    """SQL with the views that it names put before it."""
    import re

    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    own = sql.strip()
    if not names:
        return own
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if own[:4].upper() == "WITH":
        return f"WITH {views}, {own[4:]}"
    return f"WITH {views} {own}"
