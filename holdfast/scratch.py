"""Tables in the folder that all executors share, to cut lineage, and broadcasts behind a check of the size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a folder of our own only where it is unset and the
    executors are threads of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="holdfast-")
    return _own_roots[app]


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder; they survive lost executors.

    What a returned DataFrame still reads stays until the Python process ends; ``drop`` frees a
    table earlier once nothing lazy refers to it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.options(**options).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.base}/{name}")

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            delete(self.spark, self.base)
        except Exception:  # the session may be gone when the process ends
            return


def small(df: DataFrame, rows: int) -> bool:
    """True if df has at most ``rows`` rows; looks at one row more than that, never at all of them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint behind a check of the size; beyond it the join shuffles."""
    return F.broadcast(df) if small(df, rows) else df


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt by key to as many tasks as the session shuffles to: a file of few row groups is read by few tasks, which
    would else do all the costly work that follows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
