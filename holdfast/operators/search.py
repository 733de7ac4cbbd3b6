"""Ranked catalog search, browsing and paging. Catalog sides are small by nature but join by size, never by hope."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..scratch import spread

KINDS = {1: "exact_name", 2: "name_prefix", 3: "word_prefix", 4: "collector_number", 5: "set_code", 6: "infix"}
MIN_TERM = 2
COLLATION = "UNICODE_CI_AI"
GRAM = 3  #: letters of a posting's key; a term of MIN_TERM letters has a key of its own length
BUCKETS, SALTS = 64, 16
NO_DATE = "1900-01-01"


@dataclass
class Search:
    term: str = ""
    set_codes: list[str] = field(default_factory=list)
    elements: list[str] = field(default_factory=list)
    card_types: list[str] = field(default_factory=list)
    rarities: list[str] = field(default_factory=list)
    limit: int = 25
    offset: int = 0
    any_accent: bool = False


def tier(term: str, any_accent: bool = False) -> Column:
    """How a card matches, best first; NULL if it does not. Wildcards in the term are literals. any_accent: letters count
    as equal whatever their case and accents."""
    fold = (lambda c: F.collate(c, COLLATION)) if any_accent else F.lower
    name, number, code = (fold(F.col(c)) for c in ("name", "collector_number", "set_code"))
    own = lambda t: F.collate(F.lit(t), COLLATION) if any_accent else F.lit(t)
    return (
        F.when(name == own(term), 1).when(F.startswith(name, own(term)), 2).when(F.contains(name, own(" " + term)), 3)
        .when(F.startswith(number, own(term)), 4).when(code == own(term), 5).when(F.contains(name, own(term)), 6)
    )


def filtered(cards: DataFrame, q: Search, printings: DataFrame | None = None) -> DataFrame:
    """Values OR within an attribute, attributes AND across; a rarity fits if any printing has it."""
    for column, values in (("set_code", q.set_codes), ("element", q.elements), ("card_type", q.card_types)):
        if values:
            cards = cards.filter(F.col(column).isin(values))
    if q.rarities:
        cards = cards.join(printings.filter(F.col("rarity").isin(q.rarities)).select("card_id"), "card_id", "left_semi")
    return cards


def matches(cards: DataFrame, sets: DataFrame, q: Search, printings: DataFrame | None = None) -> DataFrame:
    """Columns of cards, released_on, tier and match_kind. A term under two characters finds nothing."""
    term = q.term.strip().lower()
    dated = filtered(cards, q, printings).join(sets.select("set_code", "released_on"), "set_code")
    found = dated.withColumn("tier", tier(term, q.any_accent) if len(term) >= MIN_TERM else F.lit(None).cast("int"))
    return found.filter("tier IS NOT NULL").withColumn("match_kind", V.mapped(F.col("tier"), KINDS))


def _grams(c: Column) -> Column:
    """Each run of MIN_TERM to GRAM letters of a text, in lower case."""
    text = F.lower(c)

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(places, lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(n) for n in range(MIN_TERM, GRAM + 1)))


@dataclass
class GramIndex:
    """Postings of the runs of three letters in names, numbers and set codes, each with its card's columns, in buckets by
    the run. A search reads the postings of the term's rarest run and verifies the cards there: the catalog itself is not
    read. Results are those of a scan; with any_accent only a scan serves.
    """

    spark: SparkSession
    path: str

    def write(self, cards: DataFrame) -> GramIndex:
        rows = self.rows(cards)
        # a frequent run is dealt to several tasks; files are ordered by run, so that readers skip the others
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("card_id"), F.lit(SALTS))).sortWithinPartitions("bucket", "gram")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        self._postings().groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange(1, "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/grams")
        return self

    @classmethod
    def rows(cls, cards: DataFrame) -> DataFrame:
        """The cards, spread over tasks, once for each run that they hold, with its bucket."""
        texts = F.concat(*(F.coalesce(_grams(F.col(c)), F.array().cast("array<string>")) for c in ("name", "collector_number", "set_code")))
        return spread(cards, "card_id").withColumn("gram", F.explode(F.array_distinct(texts))).withColumn("bucket", cls._bucket(F.col("gram")))

    @staticmethod
    def _bucket(gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")

    def _postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def rarest(self, term: str) -> str | None:
        """The term's run with the fewest postings; None if one of them has none. As many rows as the term has runs."""
        runs = {term[i : i + GRAM] for i in range(max(1, len(term) - GRAM + 1))}
        known = self.spark.read.parquet(f"{self.path}/grams").filter(F.col("gram").isin(list(runs))).orderBy("n", "gram").collect()
        return known[0]["gram"] if len(known) == len(runs) else None

    def candidates(self, q: Search) -> DataFrame:
        """The cards that may match: ``cards`` for matches."""
        term = q.term.strip().lower()
        if q.any_accent:
            raise ValueError("the index has letters as they are; search the catalog itself for any accent")
        gram = self.rarest(term) if len(term) >= MIN_TERM else None
        if gram is None:
            return self._postings().limit(0).drop("gram", "bucket")
        bucket = self.spark.range(1).select(self._bucket(F.lit(gram))).first()[0]
        return self._postings().filter((F.col("bucket") == bucket) & (F.col("gram") == gram)).drop("gram", "bucket")


def page(found: DataFrame, q: Search) -> DataFrame:
    """A total order: tier, newest set, number, id. Sorts only what it returns (top-k)."""
    order = [F.asc("tier"), F.desc(F.coalesce("released_on", F.lit(NO_DATE).cast("date"))), F.asc("collector_number"), F.asc("card_id")]
    return found.orderBy(*order).offset(q.offset).limit(q.limit)


def total(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"))


def primary_printings(printings: DataFrame, ranked: list[str] = V.RARITIES) -> DataFrame:
    """Per card the printing of the lowest rarity rank, then finish, edition and id; combines map-side."""
    key = F.struct(V.rank(F.col("rarity"), ranked).alias("r"), "finish", "edition", "printing_id", "rarity")
    best = printings.groupBy("card_id").agg(F.min(key).alias("p"), F.count("*").alias("printing_count"))
    return best.select("card_id", F.col("p.printing_id").alias("printing_id"), F.col("p.rarity").alias("rarity"), "printing_count")


def hydrated(page_rows: DataFrame, printings: DataFrame, ranked: list[str] = V.RARITIES) -> DataFrame:
    """A page's cards with their primary printing and number of printings: one join, no look-ups."""
    held = printings.join(page_rows.select("card_id"), "card_id", "left_semi")
    return page_rows.join(primary_printings(held, ranked), "card_id", "left").fillna(0, ["printing_count"])


def display_order(printings: DataFrame, ranked: list[str] = V.RARITIES) -> DataFrame:
    """Printings with their place in the card: rarity rank, finish, edition, id."""
    w = Window.partitionBy("card_id").orderBy(V.rank(F.col("rarity"), ranked), "finish", "edition", "printing_id")
    return printings.withColumn("place", F.row_number().over(w))


def alphabetical_order(printings: DataFrame) -> DataFrame:
    """The listing order by rarity's name, with the id as tie-break."""
    w = Window.partitionBy("card_id").orderBy("rarity", "finish", "edition", "printing_id")
    return printings.withColumn("place", F.row_number().over(w))


def card_detail(cards: DataFrame, sets: DataFrame, printings: DataFrame, ranked: list[str] = V.RARITIES) -> DataFrame:
    """Cards with their printings nested in display order, each with an alternative text."""
    item = F.struct(V.rank(F.col("rarity"), ranked).alias("rank"), "finish", "edition", "printing_id", "rarity")
    nested = printings.groupBy("card_id").agg(F.array_sort(F.collect_list(item)).alias("printings"))
    named = cards.join(sets.select("set_code", F.col("name").alias("set_name")), "set_code").join(nested, "card_id", "left")
    text = lambda p: p.withField("alt_text", S.alt_text(F.col("name"), F.col("set_name"), p["rarity"]))
    return named.withColumn("printings", F.transform(F.coalesce("printings", F.array()), text))


def gallery(sets: DataFrame, cards: DataFrame, series: str | None = None) -> DataFrame:
    """Sets with the number of imported cards (0 for an empty set)."""
    counts = cards.groupBy("set_code").agg(F.count("card_id").alias("imported"))
    chosen = sets if series is None else sets.filter(F.col("series") == series)
    return chosen.join(counts, "set_code", "left").fillna(0, ["imported"])


def gallery_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc(F.coalesce("released_on", F.lit(NO_DATE).cast("date"))), F.asc("set_code"))


def shortfall(sets: DataFrame, cards: DataFrame) -> DataFrame:
    """Sets with fewer cards than declared."""
    below = gallery(sets, cards).filter((F.col("card_count") > 0) & (F.col("imported") < F.col("card_count")))
    return below.select("set_code", F.col("card_count").alias("expected"), "imported", (F.col("card_count") - F.col("imported")).alias("missing_count"))


def checklist(cards: DataFrame, set_code: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return cards.filter(F.col("set_code") == set_code).orderBy("collector_number", "card_id").offset(offset).limit(limit)


def keyset_page(rows: DataFrame, time: str, key: str, before: tuple | None, size: int) -> DataFrame:
    """Newest first by (time, key), strictly before a pair; filters come before the limit."""
    if before is not None:
        at, last = F.lit(before[0]).cast("timestamp"), F.lit(before[1])
        rows = rows.filter((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) < last)))
    return rows.orderBy(F.desc(time), F.desc(key)).limit(size)
