"""Texts into chunks: packing paragraphs, segments by titles, images that head the next chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import match_key, strip_space


def pack_paragraphs(text: Column, limit: int = 30_000, separator: str = "\n\n") -> Column:
    """Parts of a text, packed greedily from whole paragraphs up to ``limit`` characters.

    A paragraph counts its length and the separator's; one that is over the limit stays whole. A text
    within the limit is one part.
    """
    gap = len(separator)
    state = "struct<parts:array<string>,open:array<string>,size:int>"
    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size")
    ).cast(state)

    def add(acc: Column, paragraph: Column) -> Column:
        cost = F.length(paragraph) + gap
        full = (acc["size"] + cost > limit) & (F.size(acc["open"]) > 0)
        return F.struct(
            F.when(full, F.array_append(acc["parts"], F.array_join(acc["open"], separator))).otherwise(acc["parts"]).alias("parts"),
            F.when(full, F.array(paragraph)).otherwise(F.array_append(acc["open"], paragraph)).alias("open"),
            F.when(full, cost).otherwise(acc["size"] + cost).cast("int").alias("size"),
        ).cast(state)

    packed = F.aggregate(
        F.split(text, separator), start, add,
        lambda acc: F.when(F.size(acc["open"]) > 0, F.array_append(acc["parts"], F.array_join(acc["open"], separator))).otherwise(acc["parts"]),
    )
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def split_chunks(chunks: DataFrame, text: str = "text", limit: int = 30_000, separator: str = "\n\n") -> DataFrame:
    """One row per part, with ``part_no`` from 0 in place of the whole text."""
    other = [c for c in chunks.columns if c != text]
    return chunks.select(*other, F.posexplode(pack_paragraphs(F.col(text), limit, separator)).alias("part_no", text))


def find_titles(text: Column, titles: Column) -> Column:
    """Start positions (from 0) of the titles found in order: each after the start of the one before.

    A title that is missing moves nothing; blank titles are passed over. Titles are compared in lower
    case with whitespace collapsed, the text in lower case as it is.
    """
    low = F.lower(text)
    state = "struct<next:int,found:array<int>>"
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("found")).cast(state)

    def look(acc: Column, title: Column) -> Column:
        at = F.when(title != "", F.call_function("locate", title, low, acc["next"])).otherwise(F.lit(0))
        return F.when(at > 0, F.struct((at + 1).alias("next"), F.array_append(acc["found"], at - 1).alias("found")).cast(state)).otherwise(acc)

    return F.aggregate(F.transform(titles, lambda t: F.coalesce(match_key(t), F.lit(""))), start, look, lambda acc: acc["found"])


def segment_by_titles(books: DataFrame, limit: int = 30_000) -> DataFrame:
    """(source_id, segment_no, start, segment, match_ratio) from books(source_id, text, titles).

    A segment reaches from one found title to the next, or to the end; blank ones are dropped and
    oversized ones packed by paragraphs. ``match_ratio`` is found titles over all titles.
    """
    found = books.withColumn("starts", find_titles(F.col("text"), F.col("titles")))
    ratio = F.when(F.size("titles") > 0, F.size("starts") / F.size("titles")).otherwise(0.0)
    # cut inside the row: each piece of the text leaves it once, not the whole text once a title
    cuts = F.transform(
        "starts",
        lambda s, i: F.struct(s.alias("start"), strip_space(F.substring("text", s + 1, F.coalesce(F.get("starts", i + 1), F.length("text")) - s)).alias("segment")),
    )
    rows = found.select("source_id", ratio.alias("match_ratio"), F.posexplode(cuts).alias("title_no", "p"))
    whole = rows.select("source_id", "match_ratio", "title_no", F.col("p.start").alias("start"), F.col("p.segment").alias("segment")).where(F.col("segment") != "")
    parts = whole.select("source_id", "match_ratio", "title_no", "start", F.posexplode(pack_paragraphs(F.col("segment"), limit)).alias("part_no", "segment"))
    order = F.row_number().over(Window.partitionBy("source_id").orderBy("title_no", "part_no")) - 1
    return parts.select("source_id", order.alias("segment_no"), "start", "segment", "match_ratio")


def leaf_entries(toc: DataFrame) -> DataFrame:
    """The leaves of toc(source_id, entry_id, parent_id, pos, title); all entries of a book with under two leaves."""
    parents = toc.where(F.col("parent_id").isNotNull()).select("source_id", F.col("parent_id").alias("entry_id")).distinct()
    leaves = toc.join(parents, ["source_id", "entry_id"], "left_anti")
    many = leaves.groupBy("source_id").count().where("count >= 2").select("source_id")
    return leaves.join(many, "source_id", "left_semi").unionByName(toc.join(many, "source_id", "left_anti"))


def carry_hero_images(chunks: DataFrame, short: int = 120) -> DataFrame:
    """Chunks(source_id, chunk_no, text): one that is only an image and a few words heads the next with its image."""
    name = F.regexp_extract("text", r"\[IMAGE: ([^\]]+)\]", 1)
    rest = F.length(strip_space(F.regexp_replace("text", r"\[IMAGE: [^\]]+\]", "")))
    hero = F.when((name != "") & (rest < short), name)
    # the window sees names only; whole texts meet the few names that head them
    marks = chunks.select(F.col("source_id").alias("_source"), F.col("chunk_no").alias("_no"), hero.alias("_hero"))
    before = F.lag("_hero").over(Window.partitionBy("_source").orderBy("_no"))
    heads = marks.withColumn("_before", before).where("_before is not null").groupBy("_source", "_no").agg(F.min("_before").alias("_before"))
    joined = chunks.join(heads, F.col("source_id").eqNullSafe(F.col("_source")) & (F.col("chunk_no") == F.col("_no")), "left")
    text = F.when(F.col("_before").isNotNull(), F.concat(F.lit("[HERO IMAGE: "), "_before", F.lit("]\n"), "text")).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*chunks.columns)
