"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.scan import find_noise, repair
from tidemark.session import read_table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noisy lines of scanned pages and what is wrong with them."""
    return find_noise(read_table(spark, sf_dir, "chunks"))[0]


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned pages as continuous paragraphs."""
    return repair(read_table(spark, sf_dir, "chunks"))


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired}
ORACLE_SQL: dict[str, str] = {}
