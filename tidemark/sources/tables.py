"""Stored records as parquet tables: append, delete by id, read back, newest file."""

from __future__ import annotations

import glob
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import CheckpointError


def append_records(records: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Appends records to a table; nothing that is there is rewritten."""
    writer = records.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def without_records(spark: SparkSession, path: str, ids: DataFrame, key: str = "recipe_id") -> DataFrame:
    """The table without the given ids; ids that are not there are no error."""
    return spark.read.parquet(path).join(ids.select(key).distinct(), key, "left_anti")


def save_checkpoint(spark: SparkSession, path: str, book_path: str, book_hash: str, stage: str, done: list[int]) -> None:
    """One more state of a book's run; the latest row of a book counts."""
    row = [(1, book_path, book_hash, stage, done)]
    spark.createDataFrame(row, "version int, book_path string, book_hash string, stage string, completed_segments array<int>").withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def load_checkpoint(spark: SparkSession, path: str, book_path: str, book_hash: str, version: int = 1) -> dict | None:
    """The latest state of a book if its version and hash still hold; None without one."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException:  # nothing there, or no table yet
        return None
    if missing := {"version", "book_path", "book_hash", "stage", "completed_segments"} - set(table.columns):
        raise CheckpointError(f"no columns {sorted(missing)}")
    last = table.where(F.col("book_path") == book_path).orderBy(F.desc("saved_at")).first()
    return last.asDict() if last and last["version"] == version and last["book_hash"] == book_hash else None


def delete_checkpoint(spark: SparkSession, path: str, book_path: str) -> None:
    """Forgets a book: a last state without a hash, which no run matches; what others saved stays."""
    save_checkpoint(spark, path, book_path, "", "DELETED", [])


def newest_file(patterns: list[str]) -> str | None:
    """The most recently changed file that matches; the smallest name of equals; None without any."""
    found = {p for pattern in patterns for p in glob.glob(os.path.expanduser(pattern))}
    return min(found, key=lambda p: (-os.path.getmtime(p), p), default=None)
