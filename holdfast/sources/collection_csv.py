"""A collector's own CSV: reading with a detected delimiter, matching rows to printings, and a dry run of the import."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..operators import holdings as H
from ..scratch import Scratch

COLUMNS = ["printing_id", "set_code", "collector_number", "name", "rarity", "finish", "language", "edition", "condition", "quantity"]
DELIMITERS = [",", ";", "\t", "|"]
MAX_DISTANCE = 2  #: letters that a name may be off
LONG = 32  #: letters of a name up to which it has hashes of its deletions


def delimiter_of(header: str) -> str:
    """The delimiter that occurs most often in the header; a comma if none does."""
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d)))


# Byte order marks in hexadecimal, and the encoding that each one names.
MARKS = {"EFBBBF": "UTF-8", "FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}
FALLBACK = "ISO-8859-1"  #: what else there is; control characters are read as the ones that Windows puts in their place
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def encoding_of(spark: SparkSession, path: str) -> str:
    """The encoding that a byte order mark names; else UTF-8 if every line is valid UTF-8, else the fallback."""
    lines = spark.read.text(path)
    first = lines.select(F.hex(F.substring(F.col("value").cast("binary"), 1, 3))).first()
    for mark, name in MARKS.items():
        if first and first[0].startswith(mark):
            return name
    return FALLBACK if lines.filter(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"


def read(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """line and COLUMNS as text; the encoding is detected if none is given. Header names count in any case; columns that
    are missing are NULL.

    Lines stay one record each, so a file of any size is read in splits; ``line`` ascends with the file's records.
    """
    encoding = encoding or encoding_of(spark, path)
    wide = {"lineSep": "\n"} if encoding.startswith("UTF-16") else {}  # a line feed is two bytes there
    read_csv = lambda **options: spark.read.options(encoding=encoding, **wide).csv(path, **options)
    first = read_csv(schema="value string", sep="\u0001", quote="").first()
    header = (first[0] if first and first[0] else "").lstrip("\ufeff").strip().lower()
    mark = delimiter_of(header)
    names = [n.strip().strip('"') for n in header.split(mark)]
    schema = ", ".join(f"`c{i}` string" for i in range(len(names))) + ", `_bad` string"
    rows = read_csv(schema=schema, header=True, sep=mark, escape='"', columnNameOfCorruptRecord="_bad", enforceSchema=True)
    at = {n: f"c{i}" for i, n in enumerate(names)}
    rows = rows.withColumn("line", F.monotonically_increasing_id() + 2)
    text = lambda c: F.translate(c, _CONTROLS, _WINDOWS) if encoding == FALLBACK else F.col(c)
    return rows.select("line", *(V.blank_to_null(text(at[c])).alias(c) if c in at else F.lit(None).cast("string").alias(c) for c in COLUMNS))


def _shorter(names: Column) -> Column:
    """Each of an array's texts without any one of its letters."""
    return F.flatten(F.transform(names, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))))


def _deletions(name: Column) -> Column:
    """Hashes of a name with up to MAX_DISTANCE letters deleted: two names that far apart at most have one in common."""
    level, found = F.array(name), F.array(name)
    for _ in range(MAX_DISTANCE):
        level = F.array_distinct(_shorter(level))
        found = F.concat(found, level)
    return F.array_distinct(F.transform(found, lambda s: F.xxhash64(s)))


def _pieces(name: Column, own: bool) -> Column:
    """Hashes of a long name's MAX_DISTANCE + 1 pieces, of which one is left whole by as many edits; with own False of all
    texts in the name that can be a piece of a name so far away."""
    n, d = F.length(name), MAX_DISTANCE
    lengths = F.array(n) if own else F.transform(F.sequence(F.lit(-d), F.lit(d)), lambda e: n + e)
    shifts = F.array(F.lit(0)) if own else F.sequence(F.lit(-d), F.lit(d))
    begin = lambda length, j: F.floor(length * j / (d + 1)).cast("int")

    def piece(length: Column, j: Column) -> Column:
        size = begin(length, j + 1) - begin(length, j)
        return F.transform(shifts, lambda s: F.xxhash64(length, j, F.substr(name, F.greatest(begin(length, j) + s, F.lit(0)) + 1, size)))

    return F.array_distinct(F.flatten(F.transform(lengths, lambda length: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(d)), lambda j: piece(length, j))))))


def near_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """set_code, name, found: pairs of names of one set that are MAX_DISTANCE edits apart at most.

    Both have set_code and name, distinct. Names meet by hashes of their deletions, long ones by hashes of their pieces,
    never by the set alone; what meets is verified.
    """
    n, none = F.length("name"), F.array().cast("array<long>")
    short = lambda longest: F.when(n <= longest, _deletions(F.col("name"))).otherwise(none)
    long = lambda least, own: F.when(n >= least, _pieces(F.col("name"), own)).otherwise(none)
    keyed = lambda df, keys: df.filter("name IS NOT NULL AND set_code IS NOT NULL").select("set_code", "name", F.explode(keys).alias("key"))
    left = keyed(asked, F.concat(short(LONG + MAX_DISTANCE), long(LONG + 1 - MAX_DISTANCE, False)))
    right = keyed(known, F.concat(short(LONG), long(LONG + 1, True))).withColumnRenamed("name", "found")
    pairs = left.join(right, ["set_code", "key"]).filter(F.levenshtein("name", "found", MAX_DISTANCE) >= 0)
    return pairs.select("set_code", "name", "found").distinct()


def matched(rows: DataFrame, printings: DataFrame) -> DataFrame:
    """rows and match, rung: the printing by its id (1), by set, number and all printing columns (2), by set and number
    if one printing alone fits what is given (3), or by set and a name that is a little off (4); else NULL.

    printings: printing_id, set_code, collector_number, name, rarity, finish, language, edition. All rungs look at the
    same rows, written once; the first that gives a line one printing counts. Only names that the others left are
    compared.
    """
    parts = ("rarity", "finish", "language", "edition")
    keep, scratch = rows.columns, Scratch(rows.sparkSession, "match")
    folded = {"_rarity": V.rarity(F.col("rarity")), "_finish": V.finish(F.col("finish")), "_edition": V.edition(F.col("edition")), "_language": F.lower("language"), "_name": F.lower("name")}
    rows = scratch.save(rows.withColumns(folded), "rows")
    p = printings.select(*(F.col(c).alias(f"p_{c}") for c in COLUMNS[:8]))
    by_id = rows.join(p.select("p_printing_id"), F.col("printing_id") == F.col("p_printing_id")).select("line", F.lit(1).alias("rung"), "p_printing_id")
    same = rows.join(p, (F.col("set_code") == F.col("p_set_code")) & (F.col("collector_number") == F.col("p_collector_number")))
    full = reduce(and_, (F.col(f"_{c}") == F.col(f"p_{c}") for c in parts))
    fits = reduce(and_, (F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(f"p_{c}")) for c in parts))
    rungs = F.array_compact(F.array(F.when(full, 2), F.when(fits, 3)))
    by_number = same.select("line", F.explode(rungs).alias("rung"), "p_printing_id")
    found = by_id.unionByName(by_number).groupBy("line", "rung").agg(F.min("p_printing_id").alias("match"), F.count_distinct("p_printing_id").alias("n"))
    found = found.filter("n = 1").groupBy("line").agg(F.min(F.struct("rung", "match")).alias("m"))
    tried = scratch.save(rows.join(found, "line", "left"), "tried")

    names = p.groupBy(F.col("p_set_code").alias("set_code"), F.lower("p_name").alias("name")).agg(F.min("p_printing_id").alias("match"), F.count_distinct("p_printing_id").alias("n"))
    asked = tried.filter("m IS NULL").select("set_code", F.col("_name").alias("name")).distinct()
    pairs = near_names(asked, names.select("set_code", "name"))
    near = pairs.join(names.withColumnRenamed("name", "found"), ["set_code", "found"]).groupBy("set_code", F.col("name").alias("_name")).agg(F.min("match").alias("_match"), F.sum("n").alias("n")).filter("n = 1")
    out = tried.filter("m IS NULL").join(near, ["set_code", "_name"], "left").select(*keep, F.col("_match").alias("match"), F.when(F.col("_match").isNotNull(), 4).alias("rung"))
    return tried.filter("m IS NOT NULL").select(*keep, "m.match", "m.rung").unionByName(out)


def dry_run(matches: DataFrame, state: DataFrame, user_id) -> DataFrame:
    """What an import would do, one row for each outcome: outcome (add, update, reject), rows and copies. Rows for one
    printing and condition are one net change; nothing is written."""
    quantity = S.as_int(F.col("quantity"))
    rows = matches.withColumns({"quantity": F.coalesce(quantity, F.when(F.col("quantity").isNull(), 1)), "condition": F.coalesce(V.fold(F.col("condition"), V.CONDITIONS), F.when(F.col("condition").isNull(), "near_mint"))})
    ok = F.col("match").isNotNull() & F.col("condition").isNotNull() & F.coalesce(F.col("quantity").between(1, H.MAX_QUANTITY), F.lit(False))
    net = rows.filter(ok).groupBy(F.col("match").alias("printing_id"), "condition").agg(F.sum("quantity").cast("long").alias("copies"))
    held = H.owned_by(state, user_id).filter("NOT is_graded").select("printing_id", "condition", F.lit(True).alias("_held")).distinct()
    judged = net.join(held, ["printing_id", "condition"], "left").select(F.when(F.col("_held"), "update").otherwise("add").alias("outcome"), "copies")
    bad = rows.filter(~ok).select(F.lit("reject").alias("outcome"), F.coalesce(F.col("quantity").cast("long"), F.lit(0)).alias("copies"))
    return judged.unionByName(bad).groupBy("outcome").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies"))
