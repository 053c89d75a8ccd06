"""Queries of problems 7 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.lookalike import letter_bigrams, record_texts, unify
from tidemark.llm.residue import exclude_residue
from tidemark.session import read_table


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_table(spark, sf_dir, "recipe_extractions")
    texts = record_texts(records, "extraction_id", "name", "ingredients")
    return unify(texts, "text", letter_bigrams(texts, "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and ingredient lines with characters that stand for others or cannot be seen."""
    return _unified(spark, sf_dir).where("odd").select(F.col("id").alias("extraction_id"), "field", "pos").distinct()


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one consistent form of every name and ingredient line."""
    return _unified(spark, sf_dir).select(F.col("id").alias("extraction_id"), "field", "pos", "form").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold template residue, filler, error pages or script notices instead of content."""
    found = exclude_residue(read_table(spark, sf_dir, "documents"), "doc_id", "text", "url")
    return found.select(F.col("id").alias("doc_id"))


def p10_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents to exclude, each with the reason."""
    found = exclude_residue(read_table(spark, sf_dir, "documents"), "doc_id", "text", "url")
    return found.select(F.col("id").alias("doc_id"), "reason")


QUERIES = {"p7_found": p7_found, "p7_forms": p7_forms, "p10_found": p10_found, "p10_reasons": p10_reasons}
#: For these data: characters by range, composition, and words of two scripts; no joiners of other scripts occur.
ORACLE_SQL = {
    "p7_found": r"""
WITH r AS (SELECT extraction_id, any_value(name) AS name, any_value(ingredients) AS ingredients FROM recipe_extractions GROUP BY extraction_id),
t AS (SELECT extraction_id, 'name' AS field, 0 AS pos, name AS text FROM r
  UNION ALL SELECT extraction_id, 'ingredients', CAST(i AS INTEGER), ingredients[i] FROM (SELECT *, unnest(range(1, len(ingredients) + 1)) AS i FROM r))
SELECT extraction_id, field, pos FROM t WHERE regexp_matches(text, '[\x{00AD}\x{00A0}\x{1680}\x{2000}-\x{200F}\x{202F}\x{205F}\x{2060}-\x{2064}\x{3000}\x{FEFF}\x{FF01}-\x{FF5E}\x{FB00}-\x{FB06}\x{1D400}-\x{1D7FF}\x{2044}\x{2215}]')
  OR nfc_normalize(text) <> text OR regexp_matches(text, '\p{Latin}\p{L}*[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{L}*\p{Latin}')""",
}
