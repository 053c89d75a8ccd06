"""Categories of finished records: classification into leaf names, the fallback, dual units, contents in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import normalise_links, resolve_hierarchy

# Fixed value: the category of a record that no other fits.
FALLBACK = "EPUB Imports"


def chosen_or_fallback(chosen: Column, known: Column) -> Column:
    """The chosen names that the taxonomy has, in their order; the fallback alone without any."""
    kept = F.filter(F.coalesce(chosen, F.array().cast("array<string>")), lambda c: F.array_contains(known, c))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(FALLBACK)))


def first_ingredients(ingredients: Column, first: int = 10) -> Column:
    """The ingredient lines a classifier is shown."""
    return F.slice(F.coalesce(ingredients, F.array().cast("array<string>")), 1, first)


def leaf_choice(name: Column, ingredients: Column, leaves: list[str], most: int = 3) -> Column:
    """The rule-based choice: the first ``most`` leaf names that occur in the name or the first ingredients, whatever the case."""
    text = F.lower(F.concat_ws("\n", F.array(F.coalesce(name, F.lit(""))), first_ingredients(ingredients)))
    every = F.array(*(F.lit(leaf) for leaf in leaves)) if leaves else F.array().cast("array<string>")
    return F.slice(F.filter(every, lambda leaf: F.contains(text, F.lower(leaf))), 1, most)


def categorise(recipes: DataFrame, leaves: list[str], name: str = "name", ingredients: str = "ingredients") -> DataFrame:
    """``recipes`` with ``leaf_categories``: one to three leaf names, or the fallback (also for an empty taxonomy)."""
    known = F.array(*(F.lit(leaf) for leaf in leaves)) if leaves else F.array().cast("array<string>")
    return recipes.withColumn("leaf_categories", chosen_or_fallback(leaf_choice(F.col(name), F.col(ingredients), leaves), known))


_METRIC = r"\d+(?:[.,]\d+)?\s*(?:kg|g|grams?|ml|cl|dl|l|litres?|liters?)\b"
_DUAL = rf"(?i)^(\s*[^/\n]*?[a-z][^/\n]*?)\s*/\s*({_METRIC})"


def keep_units(line: Column, system: Column) -> Column:
    """A line with two measures ('2 cups/250g flour') with one: metric and imperial keep the second, us the first; book keeps both."""
    metric, us = F.regexp_replace(line, _DUAL, "$2"), F.regexp_replace(line, _DUAL, "$1")
    return F.when(system.isin("metric", "imperial"), metric).when(system == "us", us).otherwise(line)


def preorder(toc: DataFrame) -> DataFrame:
    """toc(source_id, entry_id, parent_id, pos, title) with ``place``, the entry's number in reading order from 0:
    each entry before its children, siblings by position, then id. Entries on circles are left out.

    Orders by the path of (position, id) from the root; the number is counted by a window within a book,
    which holds keys only.
    """
    from pyspark.sql import Window

    links = normalise_links(toc.select(F.lit("toc").alias("src"), F.col("source_id").alias("owner"), F.col("entry_id").alias("node_id"), "parent_id"))
    paths = resolve_hierarchy(links, with_path=True).where(~F.col("in_cycle")).select(F.col("owner").alias("source_id"), F.col("node_id").alias("entry_id"), F.posexplode("path").alias("i", "step"))
    steps = paths.join(toc.select("source_id", F.col("entry_id").alias("step"), "pos"), ["source_id", "step"])
    keys = steps.groupBy("source_id", "entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "pos", "step"))), lambda s: F.struct(s["pos"].alias("pos"), s["step"].alias("step"))).alias("key"))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("key")) - 1
    return toc.join(keys.select("source_id", "entry_id", place.alias("place")), ["source_id", "entry_id"])


def contents_from_text(text: Column) -> Column:
    """The contents a text lists itself: lines that end in a page number after dots or wide space, as (title, page)."""
    line = r"(?m)^[ \t]*(\S.*?)(?:[ \t]*\.{2,}[ \t]*|[ \t]{2,}|\t)(\d{1,9})[ \t]*$"
    titles, pages = F.regexp_extract_all(text, F.lit(line), F.lit(1)), F.regexp_extract_all(text, F.lit(line), F.lit(2))
    return F.zip_with(titles, pages, lambda t, p: F.struct(t.alias("title"), p.cast("int").alias("page")))
