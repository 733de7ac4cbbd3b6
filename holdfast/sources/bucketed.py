"""Catalog tables bucketed by their key: joins and upserts on it read them as they lie, without a shuffle.

What changes is shuffled to the buckets instead, or broadcast if it is small. The next version of a table is written in
the same buckets, so the one after it needs no shuffle either.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import ingest as I
from ..scratch import Scratch

BUCKETS = 64  #: at least; a table has no fewer than the session has shuffle partitions, else Spark would shuffle it for more


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session may be gone when the process ends
        return


def bucketed(rows: DataFrame, label: str, key: list[str], buckets: int | None = None) -> DataFrame:
    """rows as a table in buckets by key, sorted in each. It stands in the shared folder until the process ends.

    Rows are dealt to the buckets first, so each bucket is one file, however many tasks made the rows.
    """
    spark = rows.sparkSession
    buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{Scratch(spark, label).base}/table"
    dealt = rows.repartition(buckets, *key)
    dealt.write.bucketBy(buckets, *key).sortBy(*key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def upserted(incoming: DataFrame, existing: DataFrame, label: str, key: list[str] = I.CARD_KEY) -> DataFrame:
    """The next version of a bucketed table, in as many buckets."""
    return bucketed(I.upserted(incoming, existing, key), label, key)
