"""Queries over the category tables (problem 3): hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import category_links, descendants, resolve_hierarchy


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every node of the three tables."""
    return resolve_hierarchy(category_links(spark, sf_dir)).select("src", "owner", "node_id", "root_id", "depth")


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full path of every node, from root to node, joined by '/'; nodes on circles have themselves only."""
    return resolve_hierarchy(category_links(spark, sf_dir), with_path=True).select(
        "src", "owner", "node_id", F.array_join("path", "/").alias("path")
    )


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (node, descendant) pair with its distance."""
    return descendants(resolve_hierarchy(category_links(spark, sf_dir), with_path=True)).select(
        "src", "owner", "node_id", "descendant_id", F.col("distance").cast("int").alias("distance")
    )


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants}

_LINKS = r"""
raw AS (
  SELECT 'categories' AS src, user_id AS owner, id AS node_id, parent_id FROM categories
  UNION ALL
  SELECT 'recipe_categories', db_id, upper(trim(uid, E' \t\r\n')), upper(trim(parent_uid, E' \t\r\n'))
  FROM recipe_categories WHERE coalesce(lower(trim(status)), '') <> 'deleted'
  UNION ALL
  SELECT 'zcategory', db_id, CAST(z_pk AS VARCHAR), CAST(zparent AS VARCHAR) FROM zcategory
),
nodes AS (
  SELECT src, owner, node_id, min(CASE WHEN trim(parent_id) <> '' THEN parent_id END) AS parent_id
  FROM raw WHERE node_id <> '' GROUP BY ALL
),
links AS (
  SELECT n.src, n.owner, n.node_id, k.node_id AS parent_id
  FROM nodes n LEFT JOIN nodes k ON n.src = k.src AND n.owner = k.owner AND n.parent_id = k.node_id
),
tree AS (
  SELECT src, owner, node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM links WHERE parent_id IS NULL
  UNION ALL
  SELECT l.src, l.owner, l.node_id, t.root_id, t.depth + 1, t.path || '/' || l.node_id
  FROM links l JOIN tree t ON l.src = t.src AND l.owner = t.owner AND l.parent_id = t.node_id
)
"""

ORACLE_SQL = {
    "p3_found": f"""
WITH RECURSIVE {_LINKS}
SELECT l.src, l.owner, l.node_id, coalesce(t.root_id, 'CYCLE') AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth
FROM links l LEFT JOIN tree t ON l.src = t.src AND l.owner = t.owner AND l.node_id = t.node_id""",
    "p3_paths": f"""
WITH RECURSIVE {_LINKS}
SELECT l.src, l.owner, l.node_id, coalesce(t.path, l.node_id) AS path
FROM links l LEFT JOIN tree t ON l.src = t.src AND l.owner = t.owner AND l.node_id = t.node_id""",
    "p3_descendants": f"""
WITH RECURSIVE {_LINKS},
up AS (
  SELECT src, owner, parent_id AS node_id, node_id AS descendant_id, 1 AS distance
  FROM links WHERE parent_id IS NOT NULL AND (src, owner, node_id) IN (SELECT (src, owner, node_id) FROM tree)
  UNION ALL
  SELECT u.src, u.owner, l.parent_id, u.descendant_id, u.distance + 1
  FROM up u JOIN links l ON u.src = l.src AND u.owner = l.owner AND u.node_id = l.node_id WHERE l.parent_id IS NOT NULL
)
SELECT src, owner, node_id, descendant_id, CAST(distance AS INTEGER) AS distance FROM up""",
}
