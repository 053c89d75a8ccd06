"""Predicates over chunks: recipe candidates, tables to normalise, pages fit to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The keywords that make a text a recipe candidate, as substrings of its lower case.
QUANTITY_WORDS = "tbsp tablespoon tsp teaspoon cup ounce oz gram lb pound ml litre liter".split()
STRUCTURE_WORDS = "ingredients directions instructions method preheat bake simmer sauté saute stir whisk fold roast boil".split()


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the text, anywhere and in any case."""
    low = F.lower(text)
    return sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def is_candidate(text: Column, quantity: list[str] = QUANTITY_WORDS, structure: list[str] = STRUCTURE_WORDS) -> Column:
    """At least two quantity words and one structure word."""
    return (keyword_hits(text, quantity) >= 2) & (keyword_hits(text, structure) >= 1)


def keep_candidates(chunks: DataFrame, book: str = "source_id", text: str = "text") -> DataFrame:
    """The candidates of every book; all chunks of a book that has none.

    Only the books that have candidates are shuffled, and they join back as one row each.
    """
    marked = chunks.withColumn("_candidate", F.coalesce(is_candidate(F.col(text)), F.lit(False)))
    some = marked.where("_candidate").select(F.col(book).alias("_book")).distinct().withColumn("_any", F.lit(True))
    joined = marked.join(some, F.col(book).eqNullSafe(F.col("_book")), "left")
    return joined.where(F.col("_candidate") | F.col("_any").isNull()).drop("_candidate", "_book", "_any")


def needs_table_normalisation(text: Column) -> Column:
    """Whether a text has a table of baker's percentages; any character may stand for the apostrophe."""
    return F.upper(text).rlike("BAKER.S (%|PERCENTAGE)")


def large_images(images: DataFrame, least: int = 20_000) -> DataFrame:
    """(name, content) of images worth keeping, by file name without folders."""
    return images.where(F.length("content") >= least).select(F.substring_index("path", "/", -1).alias("name"), "content")


def preflight(pages: DataFrame, first: int = 5, least_chars: int = 100, most_pages: int = 2000) -> DataFrame:
    """(source_id, pages, avg_chars, verdict) from pages(source_id, page_no, text) and optionally encrypted.

    The average runs over the pages among the first ``first`` by page number.
    """
    # lengths instead of texts: what is ranked and shuffled is narrow, and only the first pages of a book reach its task
    encrypted = F.col("encrypted").cast("int") if "encrypted" in pages.columns else F.lit(0)
    sizes = pages.select("source_id", "page_no", F.length(F.coalesce("text", F.lit(""))).alias("_chars"), encrypted.alias("_locked"))
    position = F.row_number().over(Window.partitionBy("source_id").orderBy("page_no", "_chars"))
    early = sizes.withColumn("_place", position).where(F.col("_place") <= first).groupBy(F.col("source_id").alias("_source")).agg(F.avg("_chars").alias("avg_chars"))
    whole = sizes.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages"), F.max("_locked").alias("_locked"))
    stats = whole.join(early, F.col("source_id").eqNullSafe(F.col("_source")))
    verdict = (
        F.when(F.col("_locked") == 1, "encrypted").when(F.col("pages") > most_pages, "too long")
        .when(F.col("avg_chars") < least_chars, "scanned").otherwise("ok")
    )
    return stats.select("source_id", "pages", "avg_chars", verdict.alias("verdict"))


def select_reader(name: Column, mime: Column) -> Column:
    """pdf, epub or archive by extension or MIME type, in this order; null for anything else. Archives go by
    their extension alone: other ZIP files are none."""
    extension, kind = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1)), F.coalesce(F.lower(mime), F.lit(""))
    return (
        F.when((extension == ".pdf") | (kind == "application/pdf"), "pdf")
        .when((extension == ".epub") | (kind == "application/epub+zip"), "epub")
        .when(extension == ".paprikarecipes", "archive")
    )
