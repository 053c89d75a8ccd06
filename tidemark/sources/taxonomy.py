"""Taxonomies from YAML files and SQLite databases; small, read on the driver into DataFrames."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession

AXES = "owner string, axis string, tag string, pos int"
CATEGORIES = "owner string, id string, name string, parent_id string, pos int, status string"


def parse_axes(document: object) -> dict[str, list[str]]:
    """The ``axes`` mapping: values that are no lists are skipped, null tags dropped, empty axes dropped."""
    axes = document.get("axes") if isinstance(document, dict) else None
    if not isinstance(axes, dict):
        return {}
    read = {str(a): [str(t) for t in tags if t is not None] for a, tags in axes.items() if isinstance(tags, list)}
    return {a: tags for a, tags in read.items() if tags}


def load_axes(path: str) -> dict[str, list[str]]:
    """Axes of a YAML file; any failure gives none."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            return parse_axes(yaml.safe_load(f))
    except Exception:  # noqa: BLE001 - no taxonomy is a valid taxonomy
        return {}


def axes_frame(spark: SparkSession, axes: dict[str, list[str]], owner: str = "") -> DataFrame:
    return spark.createDataFrame([(owner, a, t, i) for a, tags in axes.items() for i, t in enumerate(tags)], AXES)


def parse_categories(document: object) -> list[tuple[str, str | None]]:
    """(leaf, parent) in order from a ``categories`` list of names and one-key mappings; parents are rows too."""
    rows: list[tuple[str, str | None]] = []
    listed = document.get("categories") if isinstance(document, dict) else None
    for item in listed if isinstance(listed, list) else []:
        if isinstance(item, dict):
            for parent, children in item.items():
                rows.append((str(parent), None))
                rows.extend((str(c), str(parent)) for c in children or [] if c is not None)
        elif item is not None:
            rows.append((str(item), None))
    return rows


def leaf_names(rows: list[tuple[str, str | None]]) -> list[str]:
    """Distinct names in order of first sight."""
    return list(dict.fromkeys(name for name, _ in rows))


def hierarchy_text(rows: list[tuple[str, str | None]]) -> str:
    """One line a category, children as 'parent > child'."""
    return "\n".join(f"{parent} > {leaf}" if parent else leaf for leaf, parent in rows)


def categories_yaml(parents: list[tuple[str, list[str]]]) -> str:
    """A ``categories`` document from (name, children); names without children are plain entries."""
    import yaml

    return yaml.safe_dump({"categories": [{name: children} if children else name for name, children in parents]}, allow_unicode=True, sort_keys=False)


def read_database(spark: SparkSession, path: str) -> DataFrame:
    """Category rows of a desktop database, opened read-only; the newer schema is preferred.

    Raises ValueError when the file has neither table.
    """
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        tables = {r[0].lower() for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        if "recipe_categories" in tables:
            found = con.execute("SELECT uid, name, parent_uid, order_flag, status FROM recipe_categories").fetchall()
        elif "zcategory" in tables:
            found = [(str(a), b, None if c is None else str(c), a, None) for a, b, c in con.execute("SELECT Z_PK, ZNAME, ZPARENT FROM ZCATEGORY")]
        else:
            raise ValueError("no category table")
    return spark.createDataFrame([(path, r[0], r[1], r[2], r[3], r[4]) for r in found], CATEGORIES)
