"""Tables of contents: where they come from, which entries are recipes, how many names look like some."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def front_text(chunks: DataFrame, first: int = 2, limit: int = 20_000, marker: str = "\n[TRUNCATED]") -> DataFrame:
    """(source_id, text): the first chunks of every book joined by blank lines, cut at ``limit`` with a marker."""
    early = chunks.where(F.col("chunk_no") < first).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    return early.select("source_id", F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text).alias("text"))


def or_fallback(own: DataFrame, fallback: DataFrame, least: int = 2) -> DataFrame:
    """The own entries of the books that have ``least`` or more, the fallback's for all other books."""
    enough = own.groupBy("source_id").count().where(F.col("count") >= least).select("source_id")
    return own.join(enough, "source_id", "left_semi").unionByName(fallback.join(enough, "source_id", "left_anti"))


def pick_entries(toc: DataFrame, picks: DataFrame) -> DataFrame:
    """Entries (source_id, pos, title) at the picked positions (source_id, index), repeats included.

    Positions outside the table are dropped; books without picks keep all their entries.
    """
    chosen = toc.join(picks.select("source_id", F.col("index").alias("pos")), ["source_id", "pos"])
    return chosen.unionByName(toc.join(picks.select("source_id").distinct(), "source_id", "left_anti").select(chosen.columns))


def recipe_ratio(toc: DataFrame, picks: DataFrame) -> DataFrame:
    """(source_id, ratio): picked over all entries, 0 without picks."""
    picked = picks.groupBy("source_id").agg(F.count_distinct("index").alias("n"))
    return toc.groupBy("source_id").agg(F.count(F.lit(1)).alias("total")).join(picked, "source_id", "left").select(
        "source_id", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("ratio")
    )


def book_text(chapters: DataFrame) -> DataFrame:
    """(source_id, text): all chapters of a book in order, joined by blank lines."""
    return chapters.groupBy("source_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda p: p["text"]), "\n\n").alias("text")
    )
