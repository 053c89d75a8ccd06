"""Records: reference checks, tag whitelists, junction rows, routing, assembly, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import dangling_tokens, first_given, stable_uid, strip_tokens

DIMENSIONS = 1536
# The 21 keys of an exported archive entry, in order.
ENTRY_KEYS = [
    "uid", "name", "directions", "ingredients", "prep_time", "cook_time", "total_time", "servings", "notes", "description",
    "nutritional_info", "difficulty", "rating", "source", "source_url", "image_url", "categories", "created", "hash", "photo_hash", "photo_large",
]


def dangling_references(recipes: DataFrame) -> DataFrame:
    """(recipe_id, dangling): ids that directions refer to but ingredients lack; only recipes that have some.

    Input: recipe_id, ingredients ARRAY<STRUCT<id,...>>, directions ARRAY<STRUCT<step,text>>.
    """
    known = F.transform("ingredients", lambda i: i["id"])
    missing = F.array_distinct(F.flatten(F.transform("directions", lambda d: dangling_tokens(d["text"], known))))
    return recipes.select("recipe_id", missing.alias("dangling")).where(F.size("dangling") > 0)


def keep_allowed_tags(grid: Column, allowed: dict[str, list[str]]) -> Column:
    """Of a map axis -> tags, the allowed tags in their order, repeats included; empty axes go.

    ``allowed`` is a taxonomy on the driver; axes come in its order. Without one the map is empty.
    """
    empty = F.from_json(F.lit("{}"), "map<string,array<string>>")
    if not allowed:
        return empty

    def chosen(axis: str, tags: list[str]) -> Column:
        picked = F.coalesce(F.try_element_at(grid, F.lit(axis)), F.array().cast("array<string>"))
        return F.struct(F.lit(axis).alias("key"), F.filter(picked, lambda t: t.isin(*tags) if tags else F.lit(False)).alias("value"))

    parts = [chosen(axis, tags) for axis, tags in allowed.items()]
    return F.map_filter(F.map_from_entries(F.array(*parts)), lambda _, v: F.size(v) > 0)


def tags_of(recipes: DataFrame, grid: str = "grid_categories") -> DataFrame:
    """(recipe_id, axis, pos, tag): one row per selected tag."""
    return recipes.select("recipe_id", F.explode(grid).alias("axis", "tags")).select("recipe_id", "axis", F.posexplode("tags").alias("pos", "tag"))


def keep_allowed_rows(tags: DataFrame, allowed: DataFrame) -> DataFrame:
    """The tag rows allowed by (axis, tag) rows: the same whitelist for taxonomies too large for a literal."""
    return tags.join(allowed.select("axis", "tag").distinct(), ["axis", "tag"], "left_semi")


def flat_tags(grid: Column) -> Column:
    """All tags of a map axis -> tags, axis after axis, repeats included."""
    return F.flatten(F.map_values(grid))


def junction_rows(tags: DataFrame, ids: DataFrame) -> DataFrame:
    """(recipe_id, category_id, user_id): distinct tags of each recipe that have a category id (user_id, name, id)."""
    return (
        tags.select("recipe_id", "user_id", "tag").distinct()
        .join(ids.select("user_id", F.col("name").alias("tag"), F.col("id").alias("category_id")), ["user_id", "tag"])
        .select("recipe_id", "category_id", "user_id").distinct()
    )


def route(input_type: Column, embedding: Column) -> Column:
    """The stages a chunk goes through: restored recipes skip what they have already."""
    restored = input_type == "ARCHIVE_RECORD"
    return F.when(restored & embedding.isNotNull(), "ASSEMBLE").when(restored, "EMBED,ASSEMBLE").otherwise("EXTRACT,REFINE,CATEGORIZE,EMBED,ASSEMBLE")


def provider_calls(stages: Column, recipes: Column, table: Column) -> Column:
    """Calls to a language model: extraction, one more for a table, two a recipe; one to embed; none to assemble."""
    return F.when(stages == "ASSEMBLE", 0).when(stages == "EMBED,ASSEMBLE", 1).otherwise(1 + 2 * recipes + F.when(table, 1).otherwise(0))


def embedding_errors(embedding: Column, dimensions: int = DIMENSIONS) -> Column:
    """What is wrong with a vector, or null."""
    return F.when(embedding.isNull(), "missing").when(F.size(embedding) != dimensions, F.concat(F.lit("length "), F.size(embedding).cast("string")))


def verify_rows(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """(recipe_id, errors): for each expected (recipe_id, title, ingredients) what a stored row (recipe_id, title,
    ingredients, embedding) gets wrong; an empty list when nothing."""
    s, e = stored.alias("s"), expected.alias("e")
    joined = e.join(s, F.col("e.recipe_id") == F.col("s.recipe_id"), "left")
    errors = F.array_compact(F.array(
        F.when(F.col("s.recipe_id").isNull(), "not found"),
        F.when(F.col("s.recipe_id").isNotNull() & ~F.col("s.title").eqNullSafe(F.col("e.title")), "title"),
        F.when(F.col("s.recipe_id").isNotNull() & (F.coalesce("s.ingredients", F.lit(0)) != F.col("e.ingredients")), "ingredient count"),
        F.when(F.col("s.recipe_id").isNotNull() & F.col("s.embedding").isNull(), "embedding missing"),
        F.when(F.size("s.embedding") != DIMENSIONS, "embedding length"),
    ))
    return joined.select(F.col("e.recipe_id").alias("recipe_id"), errors.alias("errors"))


def ordered_directions(directions: Column) -> Column:
    """Directions by step, equal steps as they came."""
    placed = F.transform(directions, lambda d, i: F.struct(d["step"].alias("step"), i.alias("i"), d["text"].alias("text")))
    return F.transform(F.array_sort(placed), lambda d: d["text"])


def export_rows(recipes: DataFrame, created: str, *carried: str) -> DataFrame:
    """Archive entries of final records: plain ingredients and directions, tokens shown as text, ids from the keys;
    ``carried`` columns of the records stand before them."""
    uid = stable_uid(F.col("recipe_id"))
    values = {
        "uid": uid, "name": F.col("title"),
        "directions": F.array_join(F.transform(ordered_directions(F.col("directions")), strip_tokens), "\n"),
        "ingredients": F.array_join(F.transform("ingredients", lambda i: i["fallback_string"]), "\n"),
        "prep_time": F.coalesce("prep_time", F.lit("")), "cook_time": F.coalesce("cook_time", F.lit("")),
        "servings": F.coalesce(F.col("base_servings").cast("string"), F.lit("")), "rating": F.lit(0),
        "source_url": F.coalesce("source_url", F.lit("")), "image_url": F.coalesce("image_url", F.lit("")),
        "categories": F.coalesce("categories", F.array().cast("array<string>")), "created": F.lit(created),
        "hash": F.sha2(uid, 256), "photo_large": F.lit(None).cast("string"),
    }
    return recipes.select(*carried, *(values.get(k, F.lit("")).alias(k) for k in ENTRY_KEYS))


def book_title(title: Column, author: Column, fallback: Column, author_alone: bool = False) -> Column:
    """'Title — Author', the title alone, with ``author_alone`` the author alone, else the fallback."""
    t, a = F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(author), F.lit(""))
    return F.coalesce(F.concat(t, F.lit(" — "), a), t, *([a] if author_alone else []), first_given(fallback, F.lit("Auto-Import")))
