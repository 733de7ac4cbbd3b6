"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers, and names of a text become typed placeholders that keep their value beside them;
everything else is lower-cased words without punctuation. Windows of template words of benchmark and documents are
joined by hash and then compared in full with their slots: in its window each placeholder carries the place where its
value first stood, so two windows are equal only if their words are and if one benchmark value always stands for one
document value of the same type and the reverse. "Tom has 3 apples and Tom eats 3" meets "Ann has 7 apples and Ann eats
7", and not "Ann has 7 apples and Eve eats 7". Only DataFrame functions are used.

What is a name can't be told for sure, so windows are looked for in three modes, in one pass over the texts: without
names (finds verbatim copies and changed numbers, in any case and at any place), with capitalised words anywhere as names
(finds renamed questions), and, for windows with too few words beside their placeholders, with all values as words.

The benchmark's keys are broadcast behind a check of their number; beyond it the join shuffles keys (24 bytes each).
Of texts, only those with a hit are shuffled, each once with all its places. Equal windows of several items are one
class, and items meet documents only in the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, small_reads

WINDOW = 13  #: template words; a shorter item is one window of its own length
KEY = 8  #: first words of a window, by whose hash windows meet
MIN_WORDS = 4  #: different words of a window that are no placeholders, below which its values must agree; items of fewer tokens are looked for as whole sentences
BROADCAST_KEYS = 200_000  #: keys (8 bytes each) that may be broadcast
BROADCAST_MATCHES = 500_000  #: doc_ids of matches (8 bytes each) that may be broadcast

#: Units, as whole words after a number: fixed values.
UNITS = ["%", "percent", "km", "m", "cm", "mm", "kg", "g", "mg", "lb", "lbs", "oz", "l", "ml", "miles", "mile", "meters", "feet", "foot", "inches", "inch", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "cents", "euros", "euro", "pounds", "usd", "eur"]

# marks of placeholders at the start of a token, all below _MARKS in order; texts lose them first
_NUM, _NAME, _UNIT, _MARKS = "\u0001", "\u0002", "\u0003", "\u0004"

WITHOUT_NAMES, WITH_NAMES, PLAIN = MODES = range(3)


def tokens_of(text: Column) -> Column:
    """The whole text as lower-case tokens; placeholders carry their type's mark before their value.

    A text without words, and one that begins or ends with other characters, has empty tokens at its ends.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    marks = _NUM + _NAME + _UNIT
    t = F.when(F.contains(t, F.lit(_NUM)) | F.contains(t, F.lit(_NAME)) | F.contains(t, F.lit(_UNIT)), F.translate(t, marks, "   ")).otherwise(t)
    # each pattern begins with the class that most characters fail
    t = F.regexp_replace(t, r"(\p{Lu}(?<![\p{L}\p{N}]\p{Lu})(?=\p{Ll}))", _NAME + "$1")
    t = F.regexp_replace(t, r"(\p{N}(?<![\p{L}\p{N}]\p{N})\p{N}*(?:[.,]\p{N}+)*)", f" {_NUM}$1 ")
    t = F.regexp_replace(t, rf"({_NUM}\S+) *(%|(?i:{'|'.join(UNITS[1:])})\b)", f"$1 {_UNIT}$2 ")
    return F.split(F.lower(t), rf"(?:[^\p{{L}}\p{{N}}\p{{M}}{marks}%.,]|[.,](?!\p{{N}})|[.,](?<!\p{{N}}[.,]))+")


def _value(token: Column, mode: int) -> Column:
    """The token as a mode sees it, with its value: names are words but in WITH_NAMES."""
    return token if mode == WITH_NAMES else F.when(F.startswith(token, F.lit(_NAME)), F.substring(token, 2, 1 << 30)).otherwise(token)


def _word(token: Column, mode: int) -> Column:
    """The token's template word in a mode: placeholders without their values but in PLAIN."""
    bare = token if mode == PLAIN else F.substring(token, 1, 1)
    if mode != WITH_NAMES:
        bare = F.when(F.startswith(token, F.lit(_NAME)), F.substring(token, 2, 1 << 30)).otherwise(bare)
    return F.when(token < _MARKS, bare).otherwise(token)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value; the optimiser can't inline a lambda's variable, so value is computed once."""
    return F.transform(F.array(value), body)[0]


def _keys(tokens: Column, lengths: dict[int, list[int]]) -> Column:
    """For each mode and key length, the array of hashes of that many template words from each place on."""

    def of_mode(mode: int) -> Column:
        def runs(h: Column, n: int) -> Column:
            places = F.sequence(F.lit(0), F.size(h) - n)
            return F.when(F.size(h) >= n, F.transform(places, lambda i: F.xxhash64(F.lit(mode), F.lit(n), *(F.get(h, i + j) for j in range(n)))))

        words = F.transform(tokens, lambda w: F.xxhash64(_word(w, mode)))
        return _let(words, lambda h: F.array(*(runs(h, n) for n in lengths[mode])))

    return F.flatten(F.array(*(of_mode(m) for m in lengths)))


def _shaped(values: Column) -> Column:
    """A window with slots: placeholders as their type and the place where their value first stands."""
    slot = lambda w: F.concat(F.substring(w, 1, 1), F.array_position(values, w).cast("string"))
    return F.transform(values, lambda w: F.when((w < _MARKS) & (w != ""), slot(w)).otherwise(w))


def _window(tokens: str | Column, pos: Column, length: Column, mode: Column) -> Column:
    """The window of ``length`` tokens from ``pos`` (from 1) on as its mode compares it."""
    cut = F.slice(tokens, pos, length)
    plain = F.transform(cut, lambda w: _value(w, PLAIN))
    return _let(plain, lambda v: F.when(mode == WITH_NAMES, _let(cut, _shaped)).when(mode == WITHOUT_NAMES, _shaped(v)).otherwise(v))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, mode, length, h (of the first KEY words at most), window: all windows of all items to be looked for."""
    items = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.filter(tokens_of(F.col("text")), lambda w: w != "").alias("tokens"))
    items = items.filter(F.size("tokens") >= MIN_WORDS).withColumn("length", F.least(F.size("tokens"), F.lit(window)))
    places = items.withColumn("pos", F.explode(F.sequence(F.lit(1), F.size("tokens") - F.col("length") + 1)))
    held = places.withColumn("cut", F.slice("tokens", F.col("pos"), F.col("length")))
    literal = lambda mode: F.array_distinct(F.filter(F.transform("cut", lambda w: _word(w, mode)), lambda w: w >= _MARKS))
    enough = lambda mode: F.size(literal(mode)) >= MIN_WORDS
    named = F.exists("cut", lambda w: F.startswith(w, F.lit(_NAME)))
    of = F.array_compact(F.array(F.when(enough(WITHOUT_NAMES), WITHOUT_NAMES).otherwise(PLAIN), F.when(named & enough(WITH_NAMES), WITH_NAMES)))
    held = held.withColumn("mode", F.explode(of))
    key = None
    first = lambda mode: F.transform(F.slice("cut", 1, KEY), lambda w: F.xxhash64(_word(w, mode)))
    for mode in MODES:
        words = first(mode)
        for n in range(MIN_WORDS, KEY + 1):
            fits = (F.col("mode") == mode) & (F.least("length", F.lit(KEY)) == n)
            h = F.xxhash64(F.lit(mode), F.lit(n), *(F.get(words, F.lit(j)) for j in range(n)))
            key = F.when(fits, h) if key is None else key.when(fits, h)
    return held.select("item_id", "mode", "length", key.alias("h"), _window("tokens", F.col("pos"), F.col("length"), F.col("mode")).alias("window"))


def _plain(tokens: Column) -> Column:
    """Tokens without their marks, one blank between."""
    return F.translate(F.array_join(F.filter(tokens, lambda w: w != ""), " "), _NUM + _NAME + _UNIT, "")


def short_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """id, pos (below 0), item_id: sentences of the texts that are, as a whole, an item of fewer than MIN_WORDS tokens.

    Sentences end at a line's end and at full stops, question and exclamation marks before white space. docs: id, text.
    """
    items = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.filter(tokens_of(F.col("text")), lambda w: w != "").alias("tokens"))
    items = items.filter(F.size("tokens").between(1, MIN_WORDS - 1)).select("item_id", _plain(F.col("tokens")).alias("words")).distinct()
    if items.isEmpty():  # no text is looked at
        return docs.limit(0).select("id", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("item_id"))
    sentences = docs.select("id", F.posexplode(F.split("text", r"[.!?]+(?=\s|$)|[\r\n]+")).alias("at", "sentence"))
    # longer sentences can't be such an item; no words of theirs are compared
    brief = sentences.withColumn("words", _plain(tokens_of(F.col("sentence")))).filter(F.size(F.split("words", " ")) < MIN_WORDS)
    return brief.join(broadcast_if_small(items, BROADCAST_KEYS), "words").select("id", (-1 - F.col("at")).alias("pos"), "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per doc_id with a match: doc_id, item_ids (sorted), n_windows (matched places).

    Reads ``doc_id``/``text`` and ``item_id``/``text`` only. Null and empty texts match nothing, nor do rows with a
    null id; an item of fewer than MIN_WORDS tokens, numbers included, is found where a whole sentence is that item.
    Texts of any length are read whole. Repeated rows count once a place. An empty table on either side gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    own = scratch.save(item_windows(benchmark, window), "item-windows")
    classes = own.select("mode", "length", "h", "window").distinct()
    classes = scratch.save(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = scratch.save(own.join(classes, ["mode", "length", "h", "window"]).select("class", "item_id").distinct(), "members")
    # MODES times KEY rows at most
    lengths: dict[int, list[int]] = {}
    for r in classes.select("mode", F.least("length", F.lit(KEY)).alias("n")).distinct().orderBy("mode", "n").collect():
        lengths.setdefault(r["mode"], []).append(r["n"])
    with small_reads(docs.sparkSession):
        short = scratch.save(short_matches(docs, benchmark), "short")
        if not lengths:
            return _result(short.select("id", "pos"), short.select("id", "item_id"))
        shapes = scratch.save(classes.select("h", "mode", "length").distinct(), "shapes")
        keys = broadcast_if_small(shapes.select("h").distinct(), BROADCAST_KEYS)
        tokens = tokens_of(F.col("text"))
        hashes = docs.select("id", F.explode(_let(tokens, lambda t: _keys(t, lengths))).alias("keys")).select("id", F.posexplode("keys").alias("at", "h"))
        # written as found: an aggregation beside the texts would hold a page of up to 64 MB a task
        hits = scratch.save(hashes.join(keys, "h", "left_semi").select("id", (F.col("at") + 1).alias("pos"), "h"), "hits")
        ids = broadcast_if_small(hits.select("id").distinct(), BROADCAST_MATCHES)
        places = hits.join(broadcast_if_small(shapes, BROADCAST_KEYS), "h").select("id", F.struct("pos", "h", "mode", "length").alias("place")).distinct()
        gathered = scratch.save(places.groupBy("id").agg(F.collect_list("place").alias("places")), "gathered")
        # only texts with a hit are canonicalised again, to compare windows in full; a text is one row with all its
        # places, as a join gives its rows in copies, of which each would hold the whole text
        again = docs.join(ids, "id", "left_semi").join(gathered, "id")
        windows = _let(tokens, lambda t: F.transform("places", lambda p: p.withField("window", _window(t, p.pos, p.length, p.mode))))
        cut = again.select("id", F.explode(windows).alias("cut")).select("id", "cut.*")
        same = scratch.save(cut.join(classes, ["h", "mode", "length", "window"]).select("id", "pos", "class").distinct(), "same")
    places = same.select("id", "pos").unionByName(short.select("id", "pos"))
    pairs = same.select("id", "class").distinct().join(broadcast_if_small(members, BROADCAST_KEYS), "class").select("id", "item_id")
    return _result(places, pairs.unionByName(short.select("id", "item_id")))


def _result(places: DataFrame, pairs: DataFrame) -> DataFrame:
    counted = places.groupBy("id").agg(F.count_distinct("pos").alias("n_windows"))
    found = pairs.groupBy("id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return found.join(counted, "id").select(F.col("id").alias("doc_id"), "item_ids", "n_windows")
