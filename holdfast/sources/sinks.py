"""Sinks: snapshots that are written only when something changed, appends, and CSV for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import csv_safe


def save_snapshot(snapshot: DataFrame, changes: DataFrame, path: str) -> bool:
    """Writes the next snapshot to a new path, unless there are no changes. True if it wrote."""
    if changes.isEmpty():
        return False
    snapshot.write.mode("overwrite").parquet(path)
    return True


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV with a header; texts that look like formulas are made harmless."""
    safe = [csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*safe).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
