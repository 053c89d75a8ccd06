"""First-wins deduplication, merging of archives, reconciliation of expected and found titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import match_key


def first_wins(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of every key by ``order``, which must be total within a key.

    An aggregate of whole rows instead of a window: it combines on the map side, so a key that
    holds a third of all rows costs one row per task.
    """
    row = F.struct(*df.columns)
    return df.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def merge_archives(archives: list[DataFrame], key: Column) -> DataFrame:
    """Union of archives in order, the first of every key kept; adds ``archive_no``. Rows need ``member_no``."""
    if not archives:
        raise ValueError("no archives to merge")
    both = archives[0].withColumn("archive_no", F.lit(0))
    for i, archive in enumerate(archives[1:], 1):
        both = both.unionByName(archive.withColumn("archive_no", F.lit(i)))
    return first_wins(both, key, "archive_no", "member_no")


def reconcile(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(source_id, status, title, pos) from expected and found (source_id, pos, title).

    Titles match in lower case with whitespace collapsed; blank ones are ignored. A key that repeats
    keeps its first position and its last spelling. Matched and missing titles are spelled and placed
    as expected, extra ones as found.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("key", match_key(F.col("title"))).where(F.col("key") != "").groupBy("source_id", "key").agg(
            F.min("pos").alias("pos"), F.max_by("title", "pos").alias("title")
        )

    a, b = keyed(expected).alias("a"), keyed(found).alias("b")
    both = a.join(b, ["source_id", "key"], "full")
    status = F.when(F.col("a.title").isNull(), "extra").when(F.col("b.title").isNull(), "missing").otherwise("matched")
    return both.select(
        "source_id", status.alias("status"), F.coalesce("a.title", "b.title").alias("title"), F.coalesce("a.pos", "b.pos").alias("pos")
    )


def match_ratio(reconciled: DataFrame) -> DataFrame:
    """(source_id, ratio): matched over expected titles, 0 without any."""
    return reconciled.groupBy("source_id").agg(
        F.coalesce(F.try_divide(F.count_if(F.col("status") == "matched").cast("double"), F.count_if(F.col("status") != "extra")), F.lit(0.0)).alias("ratio")
    )
