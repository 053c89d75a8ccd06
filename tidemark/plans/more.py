"""Queries of runs, leaf categories, contents and archives, each with the SQL that checks it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar, text
from tidemark.operators import chunking, leaves, records, taxonomy, toc
from tidemark.plans import runs
from tidemark.plans.catalogue import _CATS, _CHUNKS, _INGREDIENTS, _categories, _recipe_arrays, chunks_once, extractions_once, ingredients_once, recipes_once
from tidemark.session import ensure_checkpoint_dir, read_table, store
from tidemark.sources import archives

QUERIES, ORACLE_SQL = {}, {}
LEAVES = ["Soup", "Salad", "Cake", "Curry", "Butter", "Lemon", "Rice", "Bean"]
_EXTRACTIONS = "(SELECT extraction_id, any_value(name) AS name, any_value(ingredients) AS ingredients, any_value(directions) AS directions, any_value(photo_filename) AS photo, any_value(servings) AS servings, any_value(notes) AS notes, any_value(categories) AS categories, any_value(prep_time) AS prep, any_value(cook_time) AS cook, any_value(source_id) AS source_id FROM recipe_extractions GROUP BY extraction_id)"


def query(sql: str):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_LEAF_LIST = "['" + "','".join(LEAVES) + "']"


@query(f"""SELECT extraction_id, coalesce(nullif(array_to_string(list_filter({_LEAF_LIST}, lambda c: contains(lower(concat_ws(chr(10), coalesce(name, ''), array_to_string(list_filter(coalesce(ingredients, [])[1:10], lambda x: x IS NOT NULL), chr(10)))), lower(c)))[1:3], ','), ''), 'EPUB Imports') AS leaf_categories FROM {_EXTRACTIONS}""")
def leaf_categories(spark: SparkSession, d: str) -> DataFrame:
    """One to three leaf categories of every recipe by its name and first ten ingredients, or the fallback."""
    return leaves.categorise(extractions_once(spark, d), LEAVES).select("extraction_id", F.array_join("leaf_categories", ",").alias("leaf_categories"))


@query(f"""SELECT c.source_id, count(*) AS total, count(*) FILTER (WHERE NOT bad) AS completed, count(*) FILTER (WHERE bad) AS failed, coalesce(any_value(e.n), 0) AS recipes
FROM (SELECT source_id, text IS NULL OR trim(text, E' \\t\\r\\n') = '' AS bad FROM (SELECT source_id, chunk_no, any_value(text) AS text FROM {_CHUNKS} GROUP BY ALL)) c
LEFT JOIN (SELECT source_id, count(*) AS n FROM {_EXTRACTIONS} GROUP BY source_id) e USING (source_id) GROUP BY c.source_id""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, blank chunks as the failed ones, and extracted recipes of every source."""
    chunks = chunks_once(spark, d).groupBy("source_id", "chunk_no").agg(F.min("text").alias("text"))
    errors = chunks.where(F.coalesce(text.strip_space(F.col("text")), F.lit("")) == "").select("source_id", "chunk_no")
    return runs.run_counters(chunks, extractions_once(spark, d).select("source_id"), errors)


@query("""SELECT user_id AS source_id, event_id AS chunk_no, number, CAST(floor(number * 100 / total) AS INTEGER) AS percent FROM
  (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number, count(*) OVER (PARTITION BY user_id) AS total FROM events)""")
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far a user's run was at each of its events."""
    done = read_table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("chunk_no"), F.col("ts").alias("finished_at"))
    return runs.progress(done).select("source_id", "chunk_no", "number", "percent")


@query("""SELECT o_orderpriority AS folder, count(*) AS books, count(*) FILTER (WHERE o_orderstatus = 'O') AS errors FROM orders GROUP BY o_orderpriority""")
def folder_errors(spark: SparkSession, d: str) -> DataFrame:
    """Orders as books of a folder for each priority, open ones as failed."""
    results = read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("folder"), F.col("o_orderkey").alias("book"), F.when(F.col("o_orderstatus") == "O", "open").alias("error"))
    return runs.folder_errors(results)


@query("""SELECT event_id, epoch_us(ts) + 43200000000 AS resume_us FROM (SELECT *, sum(e) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM
  (SELECT *, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS e, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)) WHERE run = 3 AND e = 1""")
def auto_pauses(spark: SparkSession, d: str) -> DataFrame:
    """Three clicks in a row as refusals: when each user's run pauses and may go on."""
    events = read_table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "click").alias("is_error"))
    return runs.auto_pauses(events).select(F.col("id").alias("event_id"), F.unix_micros(F.col("resume_at").cast("timestamp")).alias("resume_us"))


@query(f"""SELECT recipe_id, ing_id, '250g ' || name AS metric, '2 cups ' || name AS us, '2 cups/250g ' || name AS book FROM {_INGREDIENTS} WHERE name IS NOT NULL""")
def dual_units(spark: SparkSession, d: str) -> DataFrame:
    """Every ingredient name behind two measures, kept by each system."""
    line = F.concat(F.lit("2 cups/250g "), "name")
    kept = {s: leaves.keep_units(line, F.lit(s)).alias(s) for s in ("metric", "us", "book")}
    return ingredients_once(spark, d).where("name is not null").select("recipe_id", "ing_id", *kept.values())


@query(f"""WITH RECURSIVE c AS (SELECT owner, id, parent_id, coalesce(name, '') AS title FROM {_CATS}),
l AS (SELECT c.owner, c.id, p.id AS parent_id FROM c LEFT JOIN c p ON p.owner = c.owner AND p.id = c.parent_id),
t AS (SELECT owner, id, [id] AS path FROM l WHERE parent_id IS NULL UNION ALL SELECT l.owner, l.id, list_append(t.path, l.id) FROM l JOIN t ON l.owner = t.owner AND l.parent_id = t.id)
SELECT owner AS source_id, id AS entry_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY path) - 1 AS INTEGER) AS place FROM t""")
def toc_preorder(spark: SparkSession, d: str) -> DataFrame:
    """The categories of every user as a table of contents, in reading order."""
    rows = _categories(spark, d).groupBy("owner", "id").agg(F.min("parent_id").alias("parent_id"))
    toc_rows = rows.select(F.col("owner").alias("source_id"), F.col("id").alias("entry_id"), "parent_id", F.lit(0).alias("pos"), F.lit("").alias("title"))
    return leaves.preorder(toc_rows).select("source_id", "entry_id", F.col("place").cast("int").alias("place"))


@query("""SELECT p_partkey, p_name AS title, CAST(p_size AS INTEGER) AS page FROM part""")
def contents_text(spark: SparkSession, d: str) -> DataFrame:
    """A listed contents line for every part, read back."""
    listed = F.concat(F.lit("Contents\n"), "p_name", F.lit(" ..... "), F.col("p_size").cast("string"), F.lit("\nThe end"))
    return read_table(spark, d, "part").select("p_partkey", F.inline(leaves.contents_from_text(listed)))


@query("""WITH c AS (SELECT db_id AS owner, trim(uid) AS id, min(name) AS name, min(trim(parent_uid)) AS parent_id FROM recipe_categories WHERE status IS DISTINCT FROM 'deleted' AND name <> '' GROUP BY ALL),
j AS (SELECT c.*, p.id AS p_id, p.name AS p_name, p.parent_id AS p_parent FROM c LEFT JOIN c p ON p.owner = c.owner AND p.id = c.parent_id),
top AS (SELECT DISTINCT owner, name FROM j WHERE parent_id IS NULL OR parent_id = '' OR p_id IS NULL),
kid AS (SELECT DISTINCT j.owner, j.p_name AS name, j.name AS child FROM j WHERE j.p_id IS NOT NULL AND j.parent_id <> '' AND NOT EXISTS (SELECT 1 FROM c g WHERE g.owner = j.owner AND g.id = j.p_parent))
SELECT top.owner, count(DISTINCT top.name) AS parents, count(kid.child) AS children FROM top LEFT JOIN kid ON kid.owner = top.owner AND kid.name = top.name GROUP BY top.owner""")
def sync_summary(spark: SparkSession, d: str) -> DataFrame:
    """Top-level and second-level categories of every desktop database."""
    rows = taxonomy.live_rows(read_table(spark, d, "recipe_categories")).groupBy(F.col("db_id").alias("owner"), F.trim("uid").alias("id")).agg(
        F.min("name").alias("name"), F.min(F.trim("parent_uid")).alias("parent_id"), F.min("order_flag").alias("pos"), F.lit(None).cast("string").alias("status")
    )
    return taxonomy.sync_summary(taxonomy.parents_with_children(rows))


@query(f"""SELECT owner, axis, string_agg(tag, '|' ORDER BY encode(tag)) AS tags FROM (SELECT a.owner, a.name AS axis, coalesce(c.name, a.name) AS tag FROM {_CATS} a LEFT JOIN {_CATS} c ON c.owner = a.owner AND c.parent_id = a.id WHERE a.parent_id IS NULL) WHERE tag IS NOT NULL AND axis IS NOT NULL GROUP BY owner, axis""")
def sorted_axes(spark: SparkSession, d: str) -> DataFrame:
    """The tags of every two-level axis in code-point order."""
    axes = taxonomy.axes_two_levels(_categories(spark, d)).where("tag is not null and axis is not null")
    return taxonomy.sorted_axes(axes).select("owner", "axis", F.array_join("tags", "|").alias("tags"))


@query(f"""SELECT extraction_id, coalesce(array_to_string(directions, chr(10)), '') AS directions, coalesce(array_to_string(ingredients, chr(10)), '') AS ingredients, coalesce(servings, '') AS servings, coalesce(notes, '') AS notes,
  CASE WHEN extraction_id % 2 = 0 THEN photo END AS photo, CASE WHEN extraction_id % 2 = 0 AND photo IS NOT NULL THEN to_base64(encode('img ' || photo)) END AS photo_data,
  array_to_string(coalesce(categories, []), ',') AS categories, 'Kitchen Notes' AS source, len(uid_length) AS uid_length FROM (SELECT *, range(36) AS uid_length FROM {_EXTRACTIONS})""")
def older_export(spark: SparkSession, d: str) -> DataFrame:
    """Export rows of the older form; the even extractions' photos exist."""
    rows = extractions_once(spark, d)
    given = rows.withColumn("photo_filename", F.concat(F.when(F.col("extraction_id") % 2 == 0, "").otherwise("missing "), "photo_filename"))
    images = rows.where("extraction_id % 2 = 0").select(F.col("photo_filename").alias("name")).where("name is not null").distinct().withColumn("content", F.concat(F.lit("img "), "name").cast("binary"))
    made = runs.older_export(given, images, "kitchen notes", "2026-01-01 00:00:00")
    return made.select(
        "extraction_id", F.coalesce("directions", F.lit("")).alias("directions"), F.coalesce("ingredients", F.lit("")).alias("ingredients"), "servings", "notes", "photo", "photo_data",
        F.array_join("categories", ",").alias("categories"), "source", F.length("uid").cast("bigint").alias("uid_length"),
    )


def _written(spark: SparkSession, d: str) -> str:
    """All stored recipes as one archive in the shared folder, with their full records."""
    heads = read_table(spark, d, "cayenne_recipes").groupBy("recipe_id").agg(
        F.min("title").alias("title"), F.min("prep_time").alias("prep_time"), F.min("cook_time").alias("cook_time"), F.min("base_servings").alias("base_servings"),
        F.min("source_url").alias("source_url"), F.min("image_url").alias("image_url"), F.min("categories").alias("categories"), F.min_by("embedding", F.size("embedding")).alias("embedding"),
    )
    whole = heads.join(_recipe_arrays(spark, d), "recipe_id").withColumn("grid_categories", F.create_map(F.lit("Meal"), F.array(F.lit("Soup"))))
    wide = F.transform("ingredients", lambda i: F.struct(
        i["id"].alias("id"), i["amount"].alias("amount"), i["unit"].alias("unit"), i["name"].alias("name"), i["fallback_string"].alias("fallback_string"),
        F.lit(None).cast("double").alias("converted_amount"), F.lit(None).cast("string").alias("converted_unit"), F.lit(False).alias("is_ai_converted"),
    ))
    stored = archives.record_json(whole.withColumn("ingredients", wide))
    rows = records.export_rows(stored, "2026-01-01 00:00:00", "meta")
    folder = ensure_checkpoint_dir(spark).removeprefix("file://").replace("file:", "")
    path = str(Path(folder) / f"whole{archives.ARCHIVE_SUFFIX}")
    archives.write_archive(rows, path, meta_col="meta", order=["uid"])
    return path


_STORED = f"""(SELECT r.recipe_id, r.title, r.base_servings, list(coalesce(i.fallback_string, '') ORDER BY i.ing_id) AS ing FROM (SELECT recipe_id, min(title) AS title, min(base_servings) AS base_servings FROM cayenne_recipes GROUP BY recipe_id) r JOIN {_INGREDIENTS} i USING (recipe_id) GROUP BY ALL)"""
_UID = "upper(substr(md5(recipe_id), 1, 8)) || '-' || upper(substr(md5(recipe_id), 9, 4)) || '-' || upper(substr(md5(recipe_id), 13, 4)) || '-' || upper(substr(md5(recipe_id), 17, 4)) || '-' || upper(substr(md5(recipe_id), 21, 12))"


@query(f"""SELECT {_UID} AS uid, title AS name, coalesce(CAST(base_servings AS VARCHAR), '') AS servings, array_to_string(ing, chr(10)) AS ingredients, sha256({_UID}) AS hash, title IS NOT NULL AS whole FROM {_STORED}""")
def archive_entries(spark: SparkSession, d: str) -> DataFrame:
    """All stored recipes written to an archive and read back; whole ones carry their record."""
    parsed = archives.parse_entries(archives.read_entries(spark, _written(spark, d)))
    return parsed.select("uid", "name", "servings", "ingredients", "hash", F.col("meta").isNotNull().alias("whole"))


@query(f"""SELECT title, base_servings, len(ing) AS ingredients, CAST(len(ing) + CASE WHEN CAST('0x' || substr(md5(recipe_id), 1, 2) AS INTEGER) % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS directions, 'Soup' AS categories
FROM (SELECT s.* FROM {_STORED} s JOIN (SELECT recipe_id, count(embedding) AS n FROM cayenne_recipes GROUP BY recipe_id) e USING (recipe_id) WHERE e.n > 0 AND s.title IS NOT NULL)""")
def restored_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that an archive carries whole, restored without any provider call."""
    from tidemark.plans.pipeline import restore

    whole, _ = restore(archives.entry_chunks(archives.parse_entries(archives.read_entries(spark, _written(spark, d)))))
    return whole.select("title", "base_servings", F.size("structured_ingredients").cast("bigint").alias("ingredients"), F.size("tokenized_directions").cast("bigint").alias("directions"), F.array_join("categories", ",").alias("categories"))


@query(f"""SELECT source_id, count(*) AS chapters, sum(length(text)) + 2 * (count(text) - 1) AS chars FROM {_CHUNKS} WHERE input_type = 'EPUB' AND text IS NOT NULL GROUP BY source_id""")
def book_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every EPUB source as one text: its chapters and length."""
    chapters = chunks_once(spark, d).where("input_type = 'EPUB' and text is not null")
    whole = toc.book_text(chapters.select("source_id", F.struct("chunk_no", "chunk_id").alias("chunk_no"), "text"))
    return whole.join(chapters.groupBy("source_id").agg(F.count(F.lit(1)).alias("chapters")), "source_id").select("source_id", "chapters", F.length("text").cast("bigint").alias("chars"))


@query(f"""WITH c AS (SELECT owner AS source_id, id AS entry_id, any_value(parent_id) AS parent_id FROM {_CATS} GROUP BY ALL), l AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c k WHERE k.source_id = c.source_id AND k.parent_id = c.entry_id)),
m AS (SELECT source_id FROM l GROUP BY source_id HAVING count(*) >= 2) SELECT source_id, entry_id FROM l WHERE source_id IN (SELECT source_id FROM m) UNION ALL SELECT source_id, entry_id FROM c WHERE source_id NOT IN (SELECT source_id FROM m)""")
def leaf_entries(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of every user's category tree as contents; all entries where there are fewer than two."""
    rows = _categories(spark, d).select(F.col("owner").alias("source_id"), F.col("id").alias("entry_id"), "parent_id", F.lit(0).alias("pos"), F.col("name").alias("title"))
    return chunking.leaf_entries(rows).select("source_id", "entry_id")


@query("""WITH t AS (SELECT p_brand AS source_id, p_partkey AS pos FROM part) SELECT source_id, count(*) FILTER (WHERE pos % 3 = 0) / count(*) AS ratio FROM t GROUP BY source_id""")
def recipe_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Every third part as a picked entry of its brand's contents."""
    rows = read_table(spark, d, "part").select(F.col("p_brand").alias("source_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"))
    return toc.recipe_ratio(rows, rows.where("pos % 3 = 0").select("source_id", F.col("pos").alias("index")))


@query("""WITH t AS (SELECT p_brand AS source_id, p_partkey AS pos, p_name AS title FROM part), p AS (SELECT DISTINCT source_id FROM t WHERE pos % 50 = 0)
SELECT * FROM t WHERE pos % 50 = 0 UNION ALL SELECT * FROM t WHERE source_id NOT IN (SELECT source_id FROM p)""")
def picked_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth part as a picked entry; brands without one keep all."""
    rows = read_table(spark, d, "part").select(F.col("p_brand").alias("source_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"))
    return toc.pick_entries(rows, rows.where("pos % 50 = 0").select("source_id", F.col("pos").alias("index")))


@query("""WITH g AS (SELECT vec_id, any_value(embedding) AS e FROM cayenne_recipes GROUP BY vec_id) SELECT vec_id, len(e) IS NOT DISTINCT FROM 1536 AS embedding_ok FROM g""")
def embedding_ok(spark: SparkSession, d: str) -> DataFrame:
    return archives.check_embedding(recipes_once(spark, d)).select("vec_id", "embedding_ok")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 5 END AS rpm, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE greatest(1, least(10, event_id % 25)) END AS INTEGER) AS workers,
  CASE event_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'svg+xml' ELSE 'jpg' END AS extension, coalesce(nullif(CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END, ''), 'none') AS given, '{"a": ' || event_id || '}' AS json FROM events""")
def small_rules(spark: SparkSession, d: str) -> DataFrame:
    """Run limits, image extensions, first given values and fenced JSON, over all events."""
    free, workers = F.col("event_id") % 2 == 0, (F.col("event_id") % 25).cast("int")
    mime = F.element_at(F.array(F.lit("image/png"), F.lit("image/svg+xml; charset=utf-8"), F.lit("jpeg")), (F.col("event_id") % 3 + 1).cast("int"))
    limits = scalar.run_limits(free, workers)
    fenced = F.concat(F.lit("```json\n{\"a\": "), F.col("event_id").cast("string"), F.lit("}\n```"))
    return read_table(spark, d, "events").select(
        "event_id", limits["rpm"].alias("rpm"), limits["workers"].cast("int").alias("workers"), scalar.image_extension(mime).alias("extension"),
        scalar.first_given(F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")), F.lit("none")).alias("given"), scalar.strip_fence(fenced).alias("json"),
    )


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)""")
def deleted_records(spark: SparkSession, d: str) -> DataFrame:
    """A stored table without the ids that are divisible by seven."""
    kept = store(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"))
    from tidemark.sources.tables import without_records

    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    return without_records(spark, folder, kept.where("o_orderkey % 7 = 0"), "o_orderkey")
