"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.neighbours import build_graph, greedy_search, nearest_ids
from tidemark.session import cut, read_table

DIMS = 1536


def all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding) of both tables."""
    return read_table(spark, sf_dir, "cayenne_recipes").select("vec_id", "embedding").unionByName(
        read_table(spark, sf_dir, "embed_responses").select("vec_id", "embedding")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the other's five nearest."""
    near = nearest_ids(build_graph(all_vectors(spark, sf_dir), "vec_id", "embedding", DIMS), 5)
    return near.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


def p2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50, found by walking the graph.

    Copies of one vector are one answer, under their smallest id; the query's own vector is left out.
    """
    graph = build_graph(all_vectors(spark, sf_dir), "vec_id", "embedding", DIMS)
    members = graph.members.select("id", "hash").where("id % 50 = 0").distinct()
    codes = graph.codes().withColumnRenamed("id", "node")
    # the code of a vector is that of its node
    queries = cut(members.join(graph.light, "hash").join(codes, "node").select(F.col("id").alias("q"), "code", "sketch", "cells", "node"))
    # the query's own node is found first: one more place is asked for and itself left out
    found = greedy_search(graph, queries, 6).join(queries.select("q", F.col("node").alias("own")), "q").where("node <> own")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "node"))
    return found.withColumn("place", rank).where("place <= 5").select(F.col("q").alias("vec_id"), F.col("node").alias("nearest"), F.round("sim", 6).alias("sim"), "place")


QUERIES = {"p2_found": p2_found, "p2_search": p2_search}
#: Exact, so only for small tables; the operator compares all pairs there too, as one cell holds them.
ORACLE_SQL = {
    "p2_found": """
WITH v AS (SELECT vec_id, any_value(embedding) AS e FROM (SELECT vec_id, embedding FROM cayenne_recipes UNION ALL SELECT vec_id, embedding FROM embed_responses) GROUP BY vec_id),
u AS (SELECT vec_id, CAST(e AS DOUBLE[]) AS e FROM v WHERE len(e) = 1536 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 11) DESC, b.vec_id) AS r FROM u a JOIN u b ON a.vec_id <> b.vec_id)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM p WHERE r <= 5""",
}
