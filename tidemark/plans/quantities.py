"""Queries over the ingredient rows (problem 5): quantities in base units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.units import convert_quantities
from tidemark.session import read_table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mass in mg and every volume in ul."""
    return convert_quantities(read_table(spark, sf_dir, "structured_ingredients"), read_table(spark, sf_dir, "unit_factors"))


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of quantities and their sum by measure and base unit."""
    return p5_found(spark, sf_dir).groupBy("measure", "base_unit").agg(
        F.count(F.lit(1)).alias("quantities"), F.sum("qty").alias("total")
    )


QUERIES = {"p5_found": p5_found, "p5_totals": p5_totals}
ORACLE_SQL: dict[str, str] = {}
