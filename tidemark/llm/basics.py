"""Queries of problems 1, 4 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.canonical import collapse, find_copies, fingerprint_records
from tidemark.llm.leak import find_leaks
from tidemark.llm.split import split_oversized
from tidemark.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes that are formatted copies of a recipe with a smaller id."""
    return find_copies(read_table(spark, sf_dir, "recipe_extractions"), "extraction_id", "name", "ingredients")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per recipe with its number of copies."""
    prints = fingerprint_records(read_table(spark, sf_dir, "recipe_extractions"), "extraction_id", "name", "ingredients")
    return collapse(prints).select("keep_id", "copies")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized texts with the strongest kind of boundary that suffices to cut them."""
    pieces = split_oversized(read_table(spark, sf_dir, "chunks"), "chunk_id", "text")
    return pieces.where("piece_no = 0").select(F.col("id").alias("chunk_id"), "cut_at")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized text: where it begins and ends, and the kind of its last cut."""
    pieces = split_oversized(read_table(spark, sf_dir, "chunks"), "chunk_id", "text")
    return pieces.select(F.col("id").alias("chunk_id"), "piece_no", "start", "end", "cut", "piece")


def p4_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of every oversized text: they reach from its first to its last character that is no
    whitespace, none is over the limit, and each is the text between its ends and begins inside the one before."""
    texts = read_table(spark, sf_dir, "chunks").select("chunk_id", "text").dropDuplicates(["chunk_id"])
    pieces = p4_pieces(spark, sf_dir).join(texts, "chunk_id")
    before = F.lag("end").over(Window.partitionBy("chunk_id").orderBy("piece_no"))
    checked = pieces.withColumn("joined", F.coalesce((F.col("start") < before) & (F.col("start") >= before - 500), F.lit(True))).withColumn(
        "same", F.col("piece") == F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    )
    return checked.groupBy("chunk_id").agg(
        F.min("start").cast("bigint").alias("first"), F.max("end").cast("bigint").alias("last"), F.every(F.length("piece") <= 30_000).alias("fits"), F.every("joined").alias("joined"), F.every("same").alias("same")
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items and the documents that share at least 12 consecutive words with them."""
    return find_leaks(
        read_table(spark, sf_dir, "documents"), "doc_id", "text", read_table(spark, sf_dir, "eval_items"), "item_id", "text"
    )


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_cover": p4_cover, "p8_found": p8_found}

_GRAMS = """
  SELECT {id} AS id, w[i:i + 11] AS gram
  FROM (SELECT {id}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}) t,
       unnest(range(1, len(w) - 10)) AS r(i)
"""

_SPACES = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TOKENS = "regexp_extract_all(regexp_replace(regexp_replace(lower(upper(nfc_normalize({t}))), '[\\x{{FE00}}-\\x{{FE0F}}\\x{{034F}}]', '', 'g'), '" + _SPACES.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'), '[\\p{{L}}\\p{{N}}\\p{{Mn}}\\p{{Mc}}]+|[^\\p{{L}}\\p{{N}}\\p{{Mn}}\\p{{Mc}}]+')"
_KEY = r"array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN regexp_matches(left(w[i], 1), '[\p{L}\p{N}\p{Mn}\p{Mc}]') THEN w[i] WHEN i > 1 AND i < len(w) AND regexp_matches(right(w[i - 1], 1), '\p{N}') AND regexp_matches(left(w[i + 1], 1), '\p{N}') THEN w[i] ELSE '' END), '')"
_GROUPS = f"""
r AS (SELECT extraction_id, any_value(name) AS name, any_value(ingredients) AS ingredients FROM recipe_extractions WHERE name IS NOT NULL AND ingredients IS NOT NULL GROUP BY extraction_id),
l AS (SELECT extraction_id, {_KEY} AS k FROM (SELECT extraction_id, {_TOKENS.format(t='line')} AS w FROM (SELECT extraction_id, unnest(ingredients) AS line FROM r) WHERE line IS NOT NULL)),
k AS (SELECT r.extraction_id, n.k AS name, list(l.k ORDER BY l.k) AS lines FROM r JOIN l USING (extraction_id)
  JOIN (SELECT extraction_id, {_KEY} AS k FROM (SELECT extraction_id, {_TOKENS.format(t='name')} AS w FROM r)) n USING (extraction_id) WHERE l.k <> '' AND n.k <> '' GROUP BY ALL)
"""

ORACLE_SQL = {
    "p1_found": f"""WITH {_GROUPS}, g AS (SELECT *, min(extraction_id) OVER (PARTITION BY name, lines) AS keep_id FROM k)
SELECT keep_id, extraction_id AS copy_id FROM g WHERE extraction_id <> keep_id""",
    "p1_counts": f"""WITH {_GROUPS} SELECT min(extraction_id) AS keep_id, count(*) AS copies FROM k GROUP BY name, lines""",
    "p4_found": r"""
WITH big AS (SELECT chunk_id, any_value(trim(text)) AS text FROM chunks WHERE length(text) > 30000 GROUP BY chunk_id),
longest AS (
  SELECT chunk_id,
    list_max([length(x) for x in regexp_split_to_array(text, '(\r\n|\n|\r)\s*(\n|\r)\s*')]) AS paragraph,
    list_max([length(x) for x in regexp_split_to_array(text, '\s*(\n|\r)\s*')]) AS line,
    list_max([length(x) for x in regexp_split_to_array(regexp_replace(text, '([.!?])\s+', E'\\1\n', 'g'), '\s*(\n|\r)\s*')]) AS sentence,
    list_max([length(x) for x in regexp_split_to_array(text, '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+')]) AS word
  FROM big)
SELECT chunk_id, CASE WHEN paragraph <= 30000 THEN 'paragraph' WHEN line <= 30000 THEN 'line'
  WHEN sentence <= 30000 THEN 'sentence' WHEN word <= 30000 THEN 'word' ELSE 'none' END AS cut_at FROM longest""",
    "p4_cover": r"""
SELECT chunk_id, length(text) - length(ltrim(text, E' \t\r\n')) AS first, length(rtrim(text, E' \t\r\n')) AS last, true AS fits, true AS joined, true AS same
FROM (SELECT chunk_id, any_value(text) AS text FROM chunks WHERE length(text) > 30000 GROUP BY chunk_id)""",
    "p8_found": f"""
WITH item AS ({_GRAMS.format(id='item_id', table='eval_items')}),
doc AS ({_GRAMS.format(id='doc_id', table='documents')})
SELECT DISTINCT item.id AS item_id, doc.id AS doc_id FROM item JOIN doc USING (gram)""",
}
