import random

from pyspark.sql import functions as F

from tidemark.operators.hierarchy import descendants, normalise_links, resolve_hierarchy
from tidemark.operators.taxonomy import axes_all_levels, axes_two_levels, ids_by_name, parents_with_children

LINKS = "src string, owner string, node_id string, parent_id string"


def resolved(spark, rows, **kw):
    return {r["node_id"]: r for r in resolve_hierarchy(normalise_links(spark.createDataFrame(rows, LINKS)), **kw).collect()}


def test_roots_orphans_blanks_and_circles(spark):
    rows = [
        ("t", "u", "a", None), ("t", "u", "b", "a"), ("t", "u", "c", "b"), ("t", "u", "d", "gone"), ("t", "u", "e", "  "),
        ("t", "u", "x", "y"), ("t", "u", "y", "x"), ("t", "u", "z", "x"), ("t", "u", "self", "self"), ("t", "u", "b", "a"), ("t", "u", None, "a"),
    ]
    got = resolved(spark, rows, with_path=True)
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == {
        "a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0), "e": ("e", 0),
        "x": ("CYCLE", -1), "y": ("CYCLE", -1), "z": ("CYCLE", -1), "self": ("CYCLE", -1),
    }
    assert got["c"]["path"] == ["a", "b", "c"] and got["x"]["path"] == ["x"]


def test_owners_are_kept_apart_null_owner_included(spark):
    rows = [("t", "u", "a", None), ("t", "v", "b", "a"), ("t", None, "c", None), ("t", None, "d", "c")]
    got = resolved(spark, rows)
    assert got["b"]["depth"] == 0 and got["d"]["root_id"] == "c"


def test_deep_chain_and_random_forest_match_brute_force(spark):
    rng = random.Random(5)
    parent = {f"n{i}": (f"n{rng.randrange(i)}" if i and rng.random() < 0.95 else None) for i in range(300)}
    parent |= {f"c{i}": f"c{i - 1}" if i else None for i in range(100)}
    rows = [("t", "u", n, p) for n, p in parent.items()]
    rng.shuffle(rows)
    got = resolved(spark, rows, with_path=True)
    for n in parent:
        path = [n]
        while parent[path[-1]]:
            path.append(parent[path[-1]])
        assert got[n]["path"] == path[::-1] and got[n]["root_id"] == path[-1] and got[n]["depth"] == len(path) - 1


def test_descendants_and_empty_table(spark):
    df = spark.createDataFrame([("t", "u", "a", None), ("t", "u", "b", "a"), ("t", "u", "c", "b")], LINKS)
    got = descendants(resolve_hierarchy(normalise_links(df), with_path=True)).select("node_id", "descendant_id", "distance").collect()
    assert sorted(map(tuple, got)) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert resolve_hierarchy(normalise_links(df.limit(0))).count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("t", "u", "a", None)], LINKS).withColumn("anc", F.lit(1)).withColumn("dist", F.lit(2)).withColumn("k_id", F.lit("x"))
    assert resolve_hierarchy(normalise_links(df)).count() == 1


CATS = "owner string, id string, name string, parent_id string, pos int, status string"


def test_taxonomies(spark):
    rows = [
        ("u", "1", "Meal", None, 1, None), ("u", "2", "Soup", "1", 2, None), ("u", "3", "Cold", "2", 3, None), ("u", "4", "Lone", None, 4, None),
        ("u", "5", "Orphan", "9", 5, None), ("u", "6", "Below", "5", 6, None), ("u", "7", None, None, 7, None), ("u", "8", "Gone", None, 8, "deleted"),
    ]
    df = spark.createDataFrame(rows, CATS)
    live = df.where("status is null")
    assert sorted(map(tuple, axes_all_levels(live).select("axis", "tag").collect())) == [("Lone", "Lone"), ("Meal", "Cold"), ("Meal", "Soup")]
    two = sorted((r["axis"] or "", r["tag"] or "") for r in axes_two_levels(live).collect())
    assert two == [("", ""), ("Lone", "Lone"), ("Meal", "Soup")]
    flat = {r["name"]: r["children"] for r in parents_with_children(df).collect()}
    assert flat == {"Meal": ["Soup"], "Lone": [], "Orphan": ["Below"]}


def test_last_id_of_a_name_wins(spark):
    df = spark.createDataFrame([("u", "1", "A", "2024"), ("u", "2", "A", "2025"), ("u", "3", "B", None)], "owner string, id string, name string, created_at string")
    assert {r["name"]: r["id"] for r in ids_by_name(df).collect()} == {"A": "2", "B": "3"}
