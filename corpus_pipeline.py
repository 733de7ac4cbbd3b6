"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents, but for the last one, which returns what it reads back from the files it wrote.

In all stages null and empty texts are no toxic, duplicate or contaminated ones and stay; repeated rows are judged alike;
texts of any length are read whole; an empty table gives no rows; columns of any name pass through. What else a stage
does with nulls is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import Scratch, broadcast_if_small, read
from holdfast.llm.decontaminate import contaminated
from holdfast.llm.minhash import near_duplicates
from holdfast.llm.mixing import mix
from holdfast.llm.queries import encoded
from holdfast.llm.toxicity import held_out, scored, train

BROADCAST_ROWS = 1_000_000  #: keys of rows (16 bytes each) that may be broadcast


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row in a struct: no name of a stage's own clashes with the columns of docs."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier calls toxic go. Labels of held-out rows are not learned from; rows without doc_id are
    judged, not learned from."""
    model = train(docs.filter(~held_out("doc_id")), read(spark, sf_dir, "labels"))
    return scored(docs, model, docs.columns).filter("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at five-word shingles and Jaccard 0.8 one row stays: the one with the smallest doc_id, of several
    under that id the one with the smallest hash of its text, and of repeated rows any one. A row without doc_id stays
    only if its group has no other; texts without words all stay."""
    scratch, key = Scratch(spark, "stage-near"), ["doc_id", "text_key"]
    judged = near_duplicates(docs, k=5, percent=80).filter("group IS NOT NULL").select("group", *key)
    judged = scratch.save(judged, "judged")
    order = F.struct(F.col("doc_id").isNull().alias("none"), *key)
    groups = judged.groupBy("group").agg(F.count("*").alias("n"), F.min(order).alias("stays")).filter("n > 1")
    groups = scratch.save(groups.select("group", "stays"), "groups")
    rows = judged.join(groups, "group").withColumn("stays", order == F.col("stays"))
    rows = scratch.save(rows.groupBy(*key, "stays").agg(F.count("*").alias("n")), "rows")

    # only keys of rows in groups of two and more are looked at; others have no match and stay
    docs = _wrapped(docs).withColumn("text_key", F.xxhash64("text"))
    known = broadcast_if_small(rows.filter("NOT stays OR n > 1").select(*(F.col(c).alias(f"_{c}") for c in key), "stays"), BROADCAST_ROWS)
    same = (F.col("text_key") == F.col("_text_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    marked = docs.select("row", *key).join(known, same, "left").select("row", *key, "stays")
    one = F.row_number().over(Window.partitionBy(*key).orderBy("text_key"))
    repeated = marked.filter("stays").withColumn("i", one).filter("i = 1")
    return marked.filter("stays IS NULL").select("row.*").unionByName(repeated.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a passage of the benchmark go; rows are told apart by doc_id and text. Rows without doc_id are
    looked at like others."""
    scratch = Scratch(spark, "stage-benchmark")
    keyed = _wrapped(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    found = contaminated(keyed.select(F.col("key").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    found = scratch.save(found.select(F.col("doc_id").alias("key")), "found")
    return keyed.join(broadcast_if_small(found, BROADCAST_ROWS), "key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, sources at the weights of the tempered mix; a text appears once for each use, and
    texts beyond a source's budget don't appear. Rows without source or doc_id are used like others."""
    return mix(docs, budget=1.0, entropy_gain=0.5, max_repeats=4.0).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all rows in ascending doc_id order, rows without doc_id first, written and read back. A null text
    counts as empty and has its end id."""
    return encoded(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", token_output),
]

#: SQL can't express the trained classifier, the similarity join and the encoding; tests/llm/test_pipeline.py holds the
#: stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
