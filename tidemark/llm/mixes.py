"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.mixing import Mix, count_tokens, mix_sources
from tidemark.session import read_table


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    sized = count_tokens(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mix_sources(sized, read_table(spark, sf_dir, "mix_targets"))


def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return _mix(spark, sf_dir).uses.select(F.col("id").alias("doc_id"), "source", "tokens", "uses")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target source's tokens and actual share."""
    return _mix(spark, sf_dir).shares


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any mix: no document is used more often than its source allows, and each source has its share
    but for less than two of its longest documents (copies are whole), where sources without documents leave theirs to the others."""
    mix = _mix(spark, sf_dir)
    caps = F.broadcast(read_table(spark, sf_dir, "mix_targets").select("source", "max_repeats"))
    over = mix.uses.join(caps, "source").groupBy("source").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("over"), F.max(F.col("tokens")).alias("longest"))
    present = F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(Window.partitionBy())  # one row a source
    wanted = F.when(F.col("tokens") > 0, F.col("target_share") / present).otherwise(0.0)
    whole = F.sum("used_tokens").over(Window.partitionBy())
    off = mix.shares.select("source", F.abs(F.col("used_tokens") - wanted * whole).alias("off"))
    return off.join(over, "source", "left").select(
        "source", F.coalesce("over", F.lit(0)).cast("bigint").alias("over_cap"), (F.col("off") <= 2 * F.coalesce("longest", F.lit(0))).alias("met")
    )


QUERIES = {"p9_uses": p9_uses, "p9_shares": p9_shares, "p9_checks": p9_checks}
ORACLE_SQL = {"p9_checks": "SELECT source, CAST(0 AS BIGINT) AS over_cap, true AS met FROM mix_targets"}
