"""Taxonomies from category rows: three semantics, kept apart, each for many owners at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import normalise_links, resolve_hierarchy


def axes_all_levels(categories: DataFrame) -> DataFrame:
    """(owner, axis, tag): every descendant of a parentless row is a tag of its axis.

    Input: owner, id, name, parent_id. Rows with a blank id or name are dropped first; a row whose
    parent is unknown belongs to no axis, and neither do the rows below it; an axis without
    descendants is its own only tag. Names are not made distinct, repeated rows of an id are.
    """
    rows = categories.where(
        F.col("id").isNotNull() & (F.trim("id") != "") & F.col("name").isNotNull() & (F.trim("name") != "")
    ).dropDuplicates(["owner", "id"])
    links = normalise_links(rows.select(F.lit("t").alias("src"), "owner", F.col("id").alias("node_id"), "parent_id"))
    members = resolve_hierarchy(links).where(~F.col("in_cycle")).select("owner", F.col("node_id").alias("id"), "root_id", "depth")
    axes = rows.where(F.col("parent_id").isNull()).select("owner", F.col("id").alias("root_id"), F.col("name").alias("axis"))
    # rows whose parent is missing are roots of the forest, but no axes: the join leaves them out
    tags = members.where("depth > 0").join(axes, ["owner", "root_id"]).join(rows.select("owner", "id", F.col("name").alias("tag")), ["owner", "id"])
    alone = axes.join(tags.select("owner", "root_id").distinct(), ["owner", "root_id"], "left_anti")
    return tags.select("owner", "axis", "tag").unionByName(alone.select("owner", "axis", F.col("axis").alias("tag")))


def axes_two_levels(categories: DataFrame) -> DataFrame:
    """(owner, axis, tag) from direct children only.

    Grandchildren and rows with an unknown parent are dropped; a childless axis is its own tag.
    """
    axes = categories.where(F.col("parent_id").isNull()).select("owner", F.col("id").alias("parent_id"), F.col("name").alias("axis"))
    children = categories.where(F.col("parent_id").isNotNull()).select("owner", "parent_id", F.col("name").alias("tag"))
    return axes.join(children, ["owner", "parent_id"], "left").select("owner", "axis", F.coalesce("tag", "axis").alias("tag"))


def live_rows(categories: DataFrame) -> DataFrame:
    """Rows that are not deleted and have a name."""
    return categories.where((F.col("status").isNull() | (F.col("status") != "deleted")) & F.col("name").isNotNull() & (F.col("name") != ""))


def parents_with_children(categories: DataFrame) -> DataFrame:
    """(owner, name, pos, children): top-level names by their first position, with distinct direct children.

    Input: owner, id, name, parent_id, pos, status. Orphans become top level, grandchildren are
    dropped, top-level rows of the same name merge. Children come in order of position, then name.
    """
    rows = live_rows(categories).select("owner", "id", "name", "parent_id", "pos")
    parents = rows.select(F.col("owner").alias("p_owner"), F.col("id").alias("p_id"), F.col("parent_id").alias("p_parent"), F.col("name").alias("p_name")).dropDuplicates(["p_owner", "p_id"])
    joined = rows.join(parents, (F.col("owner") == F.col("p_owner")) & (F.col("parent_id") == F.col("p_id")), "left").drop("p_owner")
    known = parents.select(F.col("p_owner").alias("g_owner"), F.col("p_id").alias("g_id"))
    top = F.col("parent_id").isNull() | (F.col("parent_id") == "") | F.col("p_id").isNull()
    tops = joined.where(top).groupBy("owner", "name").agg(F.min("pos").alias("pos"))
    # a row whose parent has a known parent itself is a grandchild
    grand = joined.where(~top).join(known, (F.col("owner") == F.col("g_owner")) & (F.col("p_parent") == F.col("g_id")), "left_anti")
    children = (
        grand.groupBy("owner", F.col("p_name").alias("parent"), F.col("name").alias("child")).agg(F.min("pos").alias("pos"))
        .groupBy("owner", F.col("parent").alias("name"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(2**31 - 1)).alias("pos"), "child"))), lambda s: s["child"]).alias("children"))
    )
    return tops.join(children, ["owner", "name"], "left").select("owner", "name", "pos", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def ids_by_name(categories: DataFrame) -> DataFrame:
    """(owner, name, id): one id a name; where names repeat the last by creation, then by id, wins."""
    return categories.where(F.col("name").isNotNull()).groupBy("owner", "name").agg(
        F.max_by("id", F.struct(F.coalesce(F.col("created_at").cast("string"), F.lit("")), "id")).alias("id")
    )


def sync_summary(parents: DataFrame) -> DataFrame:
    """(owner, parents, children) from (owner, name, pos, children): what a category sync reports."""
    return parents.groupBy("owner").agg(F.count(F.lit(1)).alias("parents"), F.sum(F.size("children")).cast("bigint").alias("children"))


def owner_categories(categories: DataFrame, user: str) -> DataFrame:
    """(id, name, parent_id) of one user in order of name; ties by id."""
    return categories.where(F.col("user_id") == user).select("id", "name", "parent_id").orderBy("name", "id")


def sorted_axes(axes: DataFrame) -> DataFrame:
    """(owner, axis, tags): the tags of each axis in code-point order, repeats included."""
    return axes.groupBy("owner", "axis").agg(F.sort_array(F.collect_list("tag")).alias("tags"))


def axes_text(axes: dict[str, list[str]]) -> str:
    """One line an axis: its name and its tags."""
    return "\n".join(f"{axis}: {', '.join(tags)}" for axis, tags in axes.items())
