"""Parent-child rows to full hierarchies by pointer doubling.

``resolve_hierarchy`` never recurses level by level: every round replaces each node's pointer by
its pointer's pointer, so trees of depth d take about log2(d) joins, each on (owner, node).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, read_table

CYCLE = "CYCLE"


def normalise_links(df: DataFrame) -> DataFrame:
    """One row (src, owner, node_id, parent_id) per node; unknown, blank and absent parents become null.

    Input needs these four columns. Nodes without an id are dropped. Where repeated rows of a node
    disagree, a row with a parent wins over one without, then the smallest parent.
    """
    blank = F.regexp_replace(F.col("parent_id"), r"(?U)\s", "") == ""
    nodes = (
        df.where(F.col("node_id").isNotNull())
        .select("src", "owner", "node_id", F.when(~blank, F.col("parent_id")).alias("parent_id"))
        .groupBy("src", "owner", "node_id")
        .agg(F.min("parent_id").alias("parent_id"))
    )
    known = nodes.select(
        F.col("src").alias("k_src"), F.col("owner").alias("k_owner"), F.col("node_id").alias("k_id")
    )
    joined = nodes.join(
        known,
        F.col("src").eqNullSafe(F.col("k_src"))
        & F.col("owner").eqNullSafe(F.col("k_owner"))
        & (F.col("parent_id") == F.col("k_id")),
        "left",
    )
    return joined.select("src", "owner", "node_id", F.col("k_id").alias("parent_id"))


def resolve_hierarchy(links: DataFrame, with_path: bool = False, broadcast_limit: int = 200_000) -> DataFrame:
    """Root, depth and (with ``with_path``) the ids from the root down to each node.

    Input: the output of :func:`normalise_links`. Output: src, owner, node_id, root_id, depth,
    in_cycle and optionally path ARRAY<STRING>. Defined results: a node without parent is its own
    root at depth 0; a node on a circle, or below one, has root_id 'CYCLE', depth -1 and a path of
    itself only; an empty input gives an empty result.

    After k rounds exactly the nodes of depth <= 2^k have reached their root, so while some
    unresolved node is outside every circle each round resolves at least one: the first round that
    resolves none proves that all the rest hang on circles. Only pending nodes are joined; what is
    resolved is written once and lends its pointers to those that ask for them: the keys asked for
    are broadcast while at most ``broadcast_limit`` nodes are pending, and joined beyond that. Children
    of one hot parent only skew the side of the pending nodes, which adaptive execution splits; the
    other side is unique by key.
    """
    has_parent = F.col("parent_id").isNotNull()
    columns: list[Column] = [
        F.col("src"), F.col("owner"), F.col("node_id"),
        F.coalesce("parent_id", "node_id").alias("anc"),
        F.when(has_parent, 1).otherwise(0).alias("dist"),
        (~has_parent).alias("done"),
    ]
    if with_path:
        # ids strictly below the pointer's target, top to bottom
        columns.append(F.when(has_parent, F.array("node_id")).otherwise(F.array().cast("array<string>")).alias("tail"))
    start = cut(links.select(*columns))
    resolved = start.where("done")
    pending = start.where(~F.col("done"))
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = pending.count()
    while count:
        jump = resolved.unionByName(pending).select(
            F.col("src").alias("j_src"), F.col("owner").alias("j_owner"), F.col("node_id").alias("j_id"),
            F.col("anc").alias("j_anc"), F.col("dist").alias("j_dist"), F.col("done").alias("j_done"),
            *([F.col("tail").alias("j_tail")] if with_path else []),
        )
        same = F.col("src").eqNullSafe(F.col("j_src")) & F.col("owner").eqNullSafe(F.col("j_owner")) & (F.col("anc") == F.col("j_id"))
        if count <= broadcast_limit:
            asked = pending.select("src", "owner", "anc").distinct()
            # as many partitions as any shuffle has: those of all rounds would add up
            jump = jump.join(F.broadcast(asked), same, "left_semi").coalesce(parts)
        moved = cut(
            pending.join(jump, same).select(
                "src", "owner", "node_id", F.col("j_anc").alias("anc"),
                (F.col("dist") + F.col("j_dist")).alias("dist"), F.col("j_done").alias("done"),
                *([F.concat("j_tail", "tail").alias("tail")] if with_path else []),
            )
        )
        resolved, pending = resolved.unionByName(moved.where("done")), moved.where(~F.col("done"))
        left = pending.count()
        if left == count:
            break
        count = left
    state = resolved.unionByName(pending)
    out = state.select(
        "src", "owner", "node_id",
        F.when(F.col("done"), F.col("anc")).otherwise(F.lit(CYCLE)).alias("root_id"),
        F.when(F.col("done"), F.col("dist")).otherwise(F.lit(-1)).cast("int").alias("depth"),
        (~F.col("done")).alias("in_cycle"),
        *([F.when(F.col("done"), F.concat(F.array("anc"), "tail")).otherwise(F.array("node_id")).alias("path")] if with_path else []),
    )
    return out


def descendants(resolved: DataFrame) -> DataFrame:
    """(src, owner, node_id, descendant_id, distance): every node below every node, from resolved paths.

    One row per ancestor of each node, so the size is the sum of depths; nodes on circles have none.
    """
    exploded = resolved.where(~F.col("in_cycle")).select(
        "src", "owner", F.col("node_id").alias("descendant_id"), F.size("path").alias("n"),
        F.posexplode("path").alias("pos", "node_id"),
    )
    return exploded.where(F.col("pos") < F.col("n") - 1).select(
        "src", "owner", "node_id", "descendant_id", (F.col("n") - 1 - F.col("pos")).alias("distance")
    )


def category_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the three category tables in one shape; deleted desktop rows are left out."""
    flat = read_table(spark, sf_dir, "categories").select(
        F.lit("categories").alias("src"), F.col("user_id").alias("owner"),
        F.col("id").alias("node_id"), F.col("parent_id"),
    )
    clean = lambda c: F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    desk = (
        read_table(spark, sf_dir, "recipe_categories")
        .where(F.coalesce(F.lower(F.trim("status")), F.lit("")) != "deleted")
        .select(
            F.lit("recipe_categories").alias("src"), F.col("db_id").alias("owner"),
            clean(F.col("uid")).alias("node_id"), clean(F.col("parent_uid")).alias("parent_id"),
        )
        .where(F.col("node_id") != "")
    )
    core = read_table(spark, sf_dir, "zcategory").select(
        F.lit("zcategory").alias("src"), F.col("db_id").alias("owner"),
        F.col("z_pk").cast("string").alias("node_id"), F.col("zparent").cast("string").alias("parent_id"),
    )
    return normalise_links(flat.unionByName(desk).unionByName(core))
